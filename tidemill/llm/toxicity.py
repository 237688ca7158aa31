"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a sequence of token classes by five transducers run as
one: *insult* weighs insulting words, *threat* wants a threatening verb and
then somebody it is aimed at, *target* raises what is aimed at a person,
*negation* lowers what follows within a few words, and *reported speech*
lowers what a clause only quotes.  They are composed into one table of (state,
class) -> (state, factor, added weight) before any text is read.  A document's
score sums its clauses' weights: 1 - exp(-sum / FULL).

Which words insult, and how much, is learned from labelled documents: words
and word beginnings that toxic documents hold and others don't.  Candidates
are counted over the sample by Spark; a greedy cover then takes those that
explain toxic documents not explained twice yet, so rare words that copies of
one toxic document merely share are not taken.  Copies count once: documents
of which one of four minimum shingle hashes agrees are one class.  Candidates
are as bounded as the sample: each needs several words of its toxic documents.

Clauses are read whole, from the sign that ends the one before to the sign
that ends them, however long they are; those without a word of the lexicon or
a threat weigh nothing and are passed over.  An Aho-Corasick automaton finds
the others in whole texts of any length.

Defined cases: null and empty texts score 0; a text of any length is read
whole, and one without ends of clauses is one clause; without toxic labels the
lexicon is empty and only threats score; where labels repeat an id its lowest
label counts; labels of null ids and null labels don't count, and a null id is
in no fold; of rows that repeat a labelled id the one whose text has the
smallest hash is learned from; repeated rows stay repeated and score alike; an
empty table gives no rows; columns named like the results are replaced, others
are left alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, each_text, forget, slices
from .quality import labelled, one_each

#: Labelled documents that a fit takes at most.
SAMPLE = 16_000
FOLDS, HELD_OUT = 4, 2
#: At this score and above a document is toxic.
LEVEL = 0.3
FULL = 6.0
#: Words of toxic documents that a candidate pattern must have in the sample.
LEAST = 6
#: Share of a pattern's words that must stand in toxic documents.
PURE = 0.75
#: Lengths of word beginnings that may become patterns.
STEMS = (4, 5, 6, 7, 8)

# Function words of four languages.  Fixed values.
TARGETS = frozenset("you your u he she they him her them his their du dich dir ihr euch er sie ihn tu te toi vous il elle ils lui leur usted ustedes ti vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never nobody isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun aucune nunca jamás ni tampoco".split())
REPORTS = frozenset("said says say wrote claims claimed called calling quoted quote alleged sagte schrieb nannte behauptet dit disait écrit appelé prétend dijo dice escribió llamó".split())
# Threatening verbs as stem and endings; "-" is the stem alone.  Fixed values.
VERBS = """kill - s ing ed; murder - s ing ed; hurt - s ing; destroy - s ing ed; stab - s bing bed; shoot - s ing; shot -; beat - s ing en; strangl e es ing ed;
töt e est et en ete eten; getötet -; umbring e st t en; umgebracht -; umzubringen -; verletz e t en te ten;
tu er es ent erai era erons eront é; frapp er e es ent erai era é; détrui re s t sent rai ra; mat ar o an aré ará arán ado ando; golpe ar o a an aré ará ado ando; destru ir yo ye yen iré irá ido yendo"""
THREATS = frozenset(stem + ending.strip("-") for verb in VERBS.split(";") for stem, *endings in [verb.split()] for ending in endings)

INSULT, THREAT, TARGET, NEGATION, REPORT, WORD = range(6)
CLASSES = range(6)
#: state, class -> (state, factor, added weight)
Step = Callable[[int, int], tuple[int, float, float]]


def _insult(state: int, cls: int) -> tuple[int, float, float]:
    return 0, 1.0 if cls == INSULT else 0.0, 0.0


def _threat(state: int, cls: int) -> tuple[int, float, float]:
    """After a threatening verb, up to three words on, a target."""
    if cls == THREAT:
        return 3, 1.0, 0.0
    if cls == TARGET and state:
        return 0, 1.0, 4.0
    return max(0, state - 1), 1.0, 0.0


def _target(state: int, cls: int) -> tuple[int, float, float]:
    """Within four words of a target insults weigh more."""
    if cls == TARGET:
        return 4, 1.0, 0.0
    return max(0, state - 1), 1.5 if state and cls == INSULT else 1.0, 0.0


def _negation(state: int, cls: int) -> tuple[int, float, float]:
    if cls == NEGATION:
        return 3, 1.0, 0.0
    return max(0, state - 1), 0.35 if state else 1.0, 0.0


def _report(state: int, cls: int) -> tuple[int, float, float]:
    """What follows a verb of saying, to the end of the clause."""
    return int(state or cls == REPORT), 0.5 if state else 1.0, 0.0


def compose(*machines: tuple[Step, int]) -> dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], float, float]]:
    """One table for machines (step, number of states) that read the same classes.

    Factors multiply, added weights add up and take the factors of the others.
    """
    out = {}
    for states in product(*(range(n) for _, n in machines)):
        for cls in CLASSES:
            steps = [step(s, cls) for (step, _), s in zip(machines, states, strict=True)]
            factor = math.prod(f for _, f, _ in steps)
            added = sum(a * math.prod(f for j, (_, f, _) in enumerate(steps) if j != i and (j or cls == INSULT)) for i, (_, _, a) in enumerate(steps))
            out[states, cls] = tuple(s for s, _, _ in steps), factor, added
    return out


GRAMMAR = compose((_insult, 1), (_threat, 4), (_target, 5), (_negation, 4), (_report, 2))
START = (0, 0, 0, 0, 0)

_CLAUSE_END = re.compile(r"[.!?;:|\n]")
_WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


class Lexicon:
    """Learned insults: whole words and word beginnings, each with a weight."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.words, self.stems = words, stems
        self.lengths = sorted({len(x) for x in stems})
        self.automaton = ahocorasick.Automaton()
        for x in {*words, *stems, *THREATS}:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths if len(word) >= n)])

    def clauses(self, text: str) -> Iterator[str]:
        """Clauses of a lower-cased text in which a pattern begins a word."""
        ends: list[int] = []
        done = 0
        for end, x in self.automaton.iter(text):
            at = end - len(x) + 1
            if at < done or (at and text[at - 1].isalnum()) or (x not in self.stems and end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            if not ends:
                ends = [m.start() for m in _CLAUSE_END.finditer(text)]
            nth = bisect_right(ends, at)
            done = ends[nth] if nth < len(ends) else len(text)
            yield text[ends[nth - 1] + 1 if nth else 0 : done]

    def clause_weight(self, clause: str) -> float:
        state, total = START, 0.0
        for word in _WORDS.findall(clause):
            w = self.weight(word)
            cls = INSULT if w else THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else WORD
            state, factor, added = GRAMMAR[state, cls]
            total += w * factor + added
        return total

    def score(self, text: str | None) -> float:
        return 1 - math.exp(-sum(map(self.clause_weight, self.clauses(text.lower()))) / FULL) if text else 0.0


def patterns(text: str | None) -> Counter[str]:
    """What may become a pattern: ``word`` for whole words, ``stem*`` for beginnings.

    A beginning counts once for each different word that has it.
    """
    words = set(_WORDS.findall((text or "").lower()))
    return Counter([*words, *(f"{w[:n]}*" for w in words for n in STEMS if len(w) > n)])


def sketch(text: str | None) -> list[int]:
    """Minimum hashes of word triples by four seeds."""
    words = (text or "").lower().split()
    triples = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return [min(xxhash.xxh32_intdigest(t, seed) for t in triples) for seed in range(4)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def out() -> pa.RecordBatch:
        rows = [(k, a, b) for k, (a, b) in counts.items() if a]
        clean = [(k, a, b) for k, (a, b) in counts.items() if not a]
        rows += clean
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["pattern", "toxic", "clean"])

    for b in slices(batches):
        for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
            for x, n in patterns(text).items():
                counts[x][0 if y else 1] += n
        if len(counts) > 60_000:
            yield out()
    yield out()


def cover(held: list[tuple[frozenset[int], int]], stats: list[tuple[str, int, int]], times: int = 2) -> list[str]:
    """Patterns taken greedily until every class of toxic documents holds ``times`` of them.

    ``held``: the candidates of each toxic document, and its class.  A class
    holds what half its documents hold.  Whatever many classes hold is taken
    besides.
    """
    classes: dict[int, list[frozenset[int]]] = defaultdict(list)
    for found, cls in held:
        classes[cls].append(found)
    docs_of: dict[int, set[int]] = defaultdict(set)
    for d, sets in enumerate(classes.values()):
        for x, k in Counter(x for s in sets for x in s).items():
            if 2 * k >= len(sets):
                docs_of[x].add(d)
    need, taken, least = [times] * len(classes), [], max(2, math.ceil(0.002 * len(classes)))
    many = max(4, math.ceil(0.03 * len(classes)))
    open_ = {x for x, ds in docs_of.items() if len(ds) >= least}
    while open_:
        gain = {x: sum(1 for d in docs_of[x] if need[d]) for x in open_}
        open_ = {x for x in open_ if gain[x] >= least or len(docs_of[x]) >= many}
        if not open_:
            break
        best = max(open_, key=lambda x: (gain[x], len(docs_of[x]), stats[x][1] - 5 * stats[x][2], stats[x][0][-1] != "*", len(stats[x][0]), stats[x][0]))
        name = stats[best][0]
        taken.append(name)
        # what the pattern holds, or what holds it, says nothing more
        stem, is_stem = name.rstrip("*"), name[-1] == "*"
        open_ = {x for x in open_ if x != best and not (is_stem and stats[x][0].startswith(stem)) and not (stats[x][0][-1] == "*" and stem.startswith(stats[x][0][:-1]))}
        for d in docs_of[best]:
            need[d] = max(0, need[d] - 1)
    return taken


def _classes(sketches: list[list[int]]) -> list[int]:
    parent = list(range(len(sketches)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict[tuple[int, int], int] = {}
    for k, s in enumerate(sketches):
        for key in enumerate(s):
            parent[root(k)] = root(first.setdefault(key, k))
    return [root(k) for k in range(len(sketches))]


def _weight(toxic: int, clean: int, toxic_docs: int, clean_docs: int) -> float:
    """Log odds ratio, less three standard errors."""
    ratio = math.log((toxic + 0.5) / (toxic_docs + 1)) - math.log((clean + 0.5) / (clean_docs + 1))
    return min(FULL, max(1.5, ratio - 3 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with weights, from at most ``bound`` labelled documents."""
    some = checkpoint(one_each(labelled(docs, labels, column, folds, held_out, bound, doc_id, text), F.col("text")))
    totals = some.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not totals[0]:
        return {}, {}
    counted = some.select("text", "y").mapInArrow(_count, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    allowed = max(3, totals[1] // 2000)
    pure = counted.filter((F.col("toxic") >= LEAST) & (F.col("clean") <= allowed) & (F.col("toxic") >= PURE * (F.col("toxic") + F.col("clean"))))
    stats = sorted(((r["pattern"], r["toxic"], r["clean"]) for r in pure.collect()), key=lambda r: (5 * r[2] - r[1], len(r[0]), r[0]))
    number = {x: k for k, (x, _, _) in enumerate(stats)}

    @F.arrow_udf("struct<found: array<int>, sketch: array<long>>")
    def held(texts: pa.Array) -> pa.Array:
        told = [{"found": sorted(number[x] for x in patterns(t) if x in number), "sketch": sketch(t)} for t in each_text(texts)]
        return pa.array(told, pa.struct([("found", pa.list_(pa.int32())), ("sketch", pa.list_(pa.int64()))]))

    toxic = sorted(some.filter("y = 1").select("__id", held("text").alias("h")).collect(), key=lambda r: r["__id"])
    classes = _classes([r["h"]["sketch"] for r in toxic])
    taken = cover([(frozenset(r["h"]["found"]), c) for r, c in zip(toxic, classes, strict=True)], stats)
    weight = {x: _weight(t, c, *totals) for x, t, c in stats}
    return {x: weight[x] for x in taken if x[-1] != "*"}, {x[:-1]: weight[x] for x in taken if x[-1] == "*"}


_LEXICONS: dict[tuple, Lexicon] = {}


def score(model: tuple[dict[str, float], dict[str, float]], text: Column) -> Column:
    key = tuple(tuple(sorted(x.items())) for x in model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        forget()
        if key not in _LEXICONS:
            _LEXICONS[key] = Lexicon(dict(key[0]), dict(key[1]))
        return pa.array([_LEXICONS[key].score(x) for x in each_text(texts)], pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1: toxic); columns of these names are replaced."""
    model = fit(docs, labels, doc_id=doc_id, text=text, **how)
    return docs.withColumn("score", score(model, F.col(text))).withColumn("predicted", (F.col("score") >= LEVEL).cast("int"))
