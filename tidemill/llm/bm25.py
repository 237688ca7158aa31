"""Exact top-k search by BM25: an inverted index in shards, pruned by block-max WAND.

Every partition of the documents builds shards of bounded size; a shard is one
row that holds its postings, sorted by term and document, as packed arrays.
Document counts, total length and document frequencies are summed over all
shards, so scores don't depend on how documents fell into shards.

Documents of a shard stand in blocks of 256, alike ones together.  Where a
term is in one of 16 documents of a block or more, its contributions there are
a *row* of a matrix, beside the largest of them.  All other postings are *thin*:
a list for each term, beside its largest contribution in the shard.  Queries
meet a shard in batches of 256, those alike together, so that one product of
matrices reads a block's rows for a batch.

WAND's rule with block maxima (Broder et al., 2003; Ding and Suel, 2011) runs
from terms that give much and name few documents to those that give little and
name many: thin postings, then a block's rows in steps, the fullest last.  What
is still to come in a block can add its summed maxima at most.  While that sum
reaches the query's k-th best score so far, any document of the block may be
among the best.  From the *pivot* on, where it no longer does, only documents
whose partial scores and that sum reach the threshold together may be: if there
are none, the block's other rows are not read for this query; if there are few,
these documents are scored one by one; else the next step is read.  A query
whose maxima in a shard don't reach its threshold reads nothing there.  A query
that brings no threshold takes blocks from the most promising down, in rounds,
and its threshold rises with each round.  All queries of a batch are advanced
at once instead of cursor by cursor.

Sums over rows are of single precision and decide only who is passed over: all
products are positive, so a sum of n errs by n / 2**24 of itself at most, in any
order, and thresholds are lowered by twice that.  Documents that reach them are
scored again in double precision, term by term in one order, so that results
don't depend on batches, blocks or steps.  No document that belongs to the top
k is passed over, so merging the lists of shards gives the exact top k.

A task holds one block of up to QUERY_BLOCK queries, packed, and lets the
shards of one group pass by, one at a time; a query's k-th best score so far
goes with it from shard to shard.  There are as many groups and blocks as keep
the cluster busy, and as keep what a task reads below TASK_BYTES: fewer groups
mean fewer copies of the queries and fewer partial results.

Terms are runs of letters and digits, lower-cased, named by 64-bit hashes.  A
term that a query repeats counts as often.  Documents of one score are ordered
by id.

Defined cases: null and empty texts have no terms, match nothing and as
queries return nothing; a text of any length is indexed whole, and closes its
shard early; each row of a repeated id is a document and a query of its own;
null ids come last among equal scores; an empty table of either kind gives no
rows; of the columns only id and text are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, forget, one_thread, slices, trim

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS = 8192
SHARD_CHARS = 32 << 20
BLOCK = 256
#: Queries that one task holds; about 5 kB each.
QUERY_BLOCK = 16_384
#: Bytes of shards that pass through one task on the average, so that tasks stay short enough to be run again.
TASK_BYTES = 512 << 20
#: Tasks for each core, so that uneven ones even out.
TASKS_A_CORE = 2
#: Blocks of a shard's first round; each further round takes so many times more.
FIRST_BLOCKS, MORE = 8, 8
#: Queries that meet a shard together.
BATCH = 256
#: A term is a row in a block where it is in one of so many documents at least.
DENSE = 16
#: Rows of a shard, 1 kB each; what stands in other blocks than the fullest is read posting by posting.
ROWS = 1 << 16
#: Steps in which the rows of a block are read.
STEPS = 2
#: Documents of a block that are scored one by one rather than with their block.
FEW = 4
#: Postings that are added up at once, so that they stay in the processor's cache.
POSTINGS = 1 << 17
NO_ID = -(1 << 63)
#: Far above rounding in a sum, far below a difference of scores that matters.
SLACK = 1e-9

_WORD = re.compile(r"[^\W_]+").findall


Terms = tuple[np.ndarray, np.ndarray]


def terms(text: str | None) -> Terms:
    """(names, counts), names ascending; packed, as a task holds those of a whole shard."""
    words = Counter(_WORD(text.lower())) if text else Counter()
    digest = xxhash.xxh64_intdigest
    names = np.fromiter((digest(w.encode()) for w in words), dtype="<u8", count=len(words))
    order = np.argsort(names)
    return names[order], np.fromiter(words.values(), dtype="<i4", count=len(words))[order]


def _commonest(t: Terms) -> int:
    return int(t[0][t[1].argmax()]) if len(t[0]) else 0


def build(docs: list[tuple[int | None, Terms]]) -> dict:
    """One shard.  Documents alike in their commonest term stand together, which tightens block maxima."""
    docs = sorted(docs, key=lambda d: (_commonest(d[1]), d[0] is None, d[0] or 0, int(d[1][1].sum())))
    slot = np.repeat(np.arange(len(docs), dtype="<u2"), [len(t[0]) for _, t in docs])
    term = np.concatenate([np.zeros(0, "<u8"), *(t[0] for _, t in docs)])
    tf = np.concatenate([np.zeros(0, "<i4"), *(t[1] for _, t in docs)])
    order = np.argsort(term, kind="stable")  # slots ascend already
    names, starts = np.unique(term[order], return_index=True)
    return {
        "ids": np.array([NO_ID if k is None else k for k, _ in docs], dtype="<i8").tobytes(),
        "lengths": np.array([int(t[1].sum()) for _, t in docs], dtype="<i8").tobytes(),
        "terms": names.astype("<u8").tobytes(),
        "starts": starts.astype("<i4").tobytes(),
        "slots": slot[order].tobytes(),
        "tf": tf[order].tobytes(),
    }


SHARD = ("ids", "lengths", "terms", "starts", "slots", "tf")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    trim()
    docs: list[tuple[int | None, Terms]] = []
    chars = 0

    def out() -> pa.RecordBatch:
        s = build(docs)
        total = int(np.frombuffer(s["lengths"], "<i8").sum())
        return pa.RecordBatch.from_arrays([pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64()), *(pa.array([s[c]], pa.binary()) for c in SHARD)], ["n_docs", "n_terms", *SHARD])

    for b in slices(batches):
        for k, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            docs.append((k, terms(text)))
            chars += len(text or "")
            if len(docs) == SHARD_DOCS or chars > SHARD_CHARS:
                yield out()
                docs, chars = [], 0
                trim()
    if docs:
        yield out()
        docs = []
    trim()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for names, starts, slots in zip(*(b[c].to_pylist() for c in ("terms", "starts", "slots")), strict=True):
            term, first = np.frombuffer(names, "<u8").view("<i8"), np.frombuffer(starts, "<i4")
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.diff(first, append=len(slots) // 2).astype(np.int64))], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        q, t, n = [], [], []
        for k, text in zip(b["query"].to_pylist(), b["text"].to_pylist(), strict=True):
            names, counts = terms(text)
            q.append(np.full(len(names), k, dtype=np.int64))
            t.append(names.view("<i8"))
            n.append(counts.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (q, t, n)], ["query", "term", "n"])


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges first[i]..last[i]-1, one after the other."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def gains(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What occurrences of terms give to a score, but for the terms' weights."""
    return tf * (K1 + 1) / (tf + norm)


class Batch:
    """Queries that meet a shard together; their terms are named once."""

    def __init__(self, queries: list[Terms]):
        self.size = len(queries)
        self.names, at = np.unique(np.concatenate([np.zeros(0, "<u8"), *(n for n, _ in queries)]), return_inverse=True)
        self.name_of = at.astype(np.int32)
        self.weights = np.concatenate([np.zeros(0), *(w for _, w in queries)])
        self.owner = np.repeat(np.arange(len(queries), dtype=np.int32), [len(n) for n, _ in queries])


class Shard:
    """A shard opened for scoring with the corpus's mean length."""

    def __init__(self, packed: dict, mean_length: float):
        get = lambda c, kind: np.frombuffer(packed[c], kind)
        self.ids, length = get("ids", "<i8"), get("lengths", "<i8")
        self.terms, slots, tf = get("terms", "<u8"), get("slots", "<u2"), get("tf", "<i4")
        self.starts = np.append(get("starts", "<i4").astype(np.int64), len(tf))
        self.norm = K1 * (1 - B + B * length / mean_length)
        # The postings by document.
        order = np.argsort(slots, kind="stable")
        self.doc_first = np.searchsorted(slots[order], np.arange(len(self.ids) + 1))
        self.doc_tf = tf[order]
        self.doc_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))[order]
        del order
        impact = np.empty(len(tf), dtype=np.float32)
        for a in range(0, len(tf), POSTINGS):
            part = slice(a, a + POSTINGS)
            impact[part] = gains(tf[part], self.norm[slots[part]])
        self.n_blocks = len(self.ids) // BLOCK + 1
        block = slots // BLOCK
        new = np.ones(len(tf), dtype=bool)
        new[1:] = block[1:] != block[:-1]
        new[self.starts[:-1]] = True
        entry = np.flatnonzero(new)  # one for each term and block
        self.block, self.entries = block[entry], np.searchsorted(entry, self.starts)
        self.most = np.maximum.reduceat(impact, entry) if len(entry) else np.zeros(0, dtype=np.float32)
        del block, new
        thin = self._rows(np.append(entry, len(tf)), slots, impact)
        self.thin_first = np.searchsorted(thin, self.starts)
        self.thin_slots, self.thin_impact = slots[thin], impact[thin]
        #: The most that a term gives outside rows.
        self.thin_most = np.zeros(len(self.terms))
        some = np.flatnonzero(np.diff(self.thin_first))
        if len(some):
            self.thin_most[some] = np.maximum.reduceat(self.thin_impact, self.thin_first[some])
        #: Postings of the queries' terms, those that were read, and those of them that were added up one by one.
        self.held = self.read = self.single = 0

    def _rows(self, first: np.ndarray, slots: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Make entries that hold a good part of their block rows of a matrix, block by block, the fullest of a block last; the numbers of all other postings."""
        held = np.diff(first)
        full = np.flatnonzero(held * DENSE >= BLOCK)
        if len(full) > ROWS:
            full = full[np.argpartition(-held[full], ROWS)[:ROWS]]
        inside = np.zeros(len(held), dtype=bool)
        inside[full] = True
        full = full[np.lexsort((full, held[full], self.block[full]))]
        self.row_first = np.searchsorted(self.block[full], np.arange(self.n_blocks + 1))
        terms, self.row_column = np.unique(np.searchsorted(self.entries, full, side="right") - 1, return_inverse=True)
        self.column = np.full(len(self.terms), -1, dtype=np.int32)
        self.column[terms] = np.arange(len(terms))
        self.n_columns = len(terms)
        size = np.diff(self.row_first)
        step = ((np.arange(len(full)) - np.repeat(self.row_first[:-1], size)) * STEPS) // np.repeat(size, size)
        self.cuts, self.rows = [], np.zeros((len(full), BLOCK), dtype=np.float32)
        for a, b in zip(self.row_first[:-1], self.row_first[1:], strict=True):
            self.cuts.append([a + np.flatnonzero(step[a:b] == i) for i in range(STEPS)])
            posting = _ranges(first[full[a:b]], first[full[a:b] + 1])
            self.rows[np.repeat(np.arange(a, b), held[full[a:b]]), slots[posting] % BLOCK] = impact[posting]
        at = step, self.block[full], self.row_column
        self.row_most, self.row_held = (np.zeros((STEPS, self.n_blocks, len(terms)), dtype=np.float32) for _ in range(2))
        self.row_most[at], self.row_held[at] = self.most[full], held[full]
        #: Relative error of a sum of single-precision products, none of them negative, whatever their order; twice the bound.
        self.error = (int(size.max(initial=0)) + 16) * 2.0**-23
        return np.flatnonzero(np.repeat(~inside, held))

    def top(self, names: np.ndarray, weights: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents, best first, unless below ``least``."""
        return self.tops(Batch([(names, weights)]), k, np.array([least])).get(0, (np.zeros(0, np.int64), np.zeros(0)))

    def tops(self, asked: Batch, k: int, least: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For queries of the batch that have any, (ids, scores) of the k best documents, best first, unless below the query's ``least``."""
        at = np.searchsorted(self.terms, asked.names)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == asked.names[known]
        at[~known] = -1
        term = at[asked.name_of]
        has = term >= 0
        term, weight, query = term[has], asked.weights[has], asked.owner[has].astype(np.int64)
        n, blocks = asked.size, self.n_blocks
        self.held += int((self.starts[term + 1] - self.starts[term]).sum())
        wide = np.zeros((self.n_columns, n), dtype=np.float32)
        columns = self.column[term]
        in_rows = columns >= 0
        wide[columns[in_rows], query[in_rows]] = weight[in_rows]
        used = wide.any(1)
        most = [(step @ wide).T for step in self.row_most]
        held = [(step @ (wide > 0)).T for step in self.row_held]
        # Sums of block maxima of a step's rows and later ones.
        rest = np.cumsum(most[::-1], axis=0)[::-1] * np.float32(1 + 2 * self.error)
        least = least.astype(float)
        bar = self._bar(least)
        scores = np.zeros((n, blocks * BLOCK), dtype=np.float32)
        thin = np.bincount(query, weight * self.thin_most[term], n)
        open_ = rest[0].max(1) + thin * (1 + self.error) >= bar
        wanted = open_[query]
        self._read_thin(scores, term[wanted], weight[wanted], query[wanted])
        whole = rest[0] + scores.reshape(n, blocks, BLOCK).max(2)
        whole[~open_] = 0.0
        cold, begun, size = least <= 0, 0, FIRST_BLOCKS
        rank = np.zeros((n, blocks), dtype=np.int64)
        rank[cold] = np.argsort(np.argsort(-whole[cold], axis=1, kind="stable"), axis=1)
        done = np.zeros((n, blocks), dtype=bool)
        sought: list[tuple[np.ndarray, np.ndarray]] = []
        while begun < blocks:
            some = (whole > 0) & (whole >= bar[:, None]) & ~done & ((rank < begun + size) | ~cold[:, None])
            for b in np.flatnonzero(some.any(0)):
                self._read_rows(scores, b, np.flatnonzero(some[:, b]), bar, rest[:, :, b], [x[:, b] for x in held], used, wide, sought)
            done |= some
            for q in np.flatnonzero(cold & some.any(1)):
                reached = scores[q].reshape(blocks, BLOCK)[done[q]].ravel()
                if len(reached) >= k:
                    least[q] = max(least[q], float(np.partition(reached, -k)[-k]) * (1 - self.error))
            bar = self._bar(least)
            if not cold.any():
                break
            begun, size = begun + size, size * MORE
        scores.reshape(n, blocks, BLOCK)[~done] = 0.0
        found = np.nonzero((scores > 0) & (scores >= bar[:, None]))
        q, slot = (np.concatenate([x, *more]) for x, more in zip(found, zip(*sought, strict=True) if sought else ((), ()), strict=True))
        return self._exact(q, slot, term, weight, query, k, least)

    def _bar(self, least: np.ndarray) -> np.ndarray:
        """What a sum in single precision surely reaches if the exact one reaches ``least``."""
        return (np.maximum(least - SLACK, 0.0) * (1 - self.error)).astype(np.float32) * np.float32(1 - 2.0**-22)

    def _read_thin(self, scores: np.ndarray, term: np.ndarray, weight: np.ndarray, query: np.ndarray) -> None:
        """Put what thin postings give into ``scores``."""
        first, last = self.thin_first[term], self.thin_first[term + 1]
        some = last > first
        first, last, weight, query = first[some], last[some], weight[some], query[some]
        count = last - first
        upto = np.append(0, np.cumsum(count))
        self.read += int(upto[-1])
        self.single += int(upto[-1])
        ends = np.searchsorted(query, np.arange(len(scores) + 1))
        width, a = scores.shape[1], 0
        while a < len(scores):
            # as many queries as read POSTINGS together, one at least
            b = max(a + 1, int(np.searchsorted(upto[ends], upto[ends[a]] + POSTINGS, side="right")) - 1)
            part = slice(ends[a], ends[b])
            if ends[b] > ends[a]:
                posting = _ranges(first[part], last[part])
                to = np.repeat((query[part] - a) * width, count[part])
                to += self.thin_slots[posting]
                gain = np.repeat(weight[part], count[part])
                gain *= self.thin_impact[posting]
                scores[a:b] = np.bincount(to, gain, (b - a) * width).reshape(b - a, width)
            a = b

    def _read_rows(self, scores: np.ndarray, b: int, some: np.ndarray, bar: np.ndarray, rest: list[np.ndarray], held: list[np.ndarray], used: np.ndarray, wide: np.ndarray, sought: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Read block ``b`` for queries ``some``, step by step; documents left to be scored one by one go to ``sought``."""
        part = slice(b * BLOCK, (b + 1) * BLOCK)
        got, bar = scores[some, part], bar[some]
        for to_come, postings, rows in zip(rest, held, self.cuts[b], strict=True):
            # Beyond the pivot only documents that have enough already are left.
            more = to_come[some]
            beyond = np.flatnonzero(more < bar)
            if len(beyond):
                left = got[beyond] >= (bar[beyond] - more[beyond])[:, None]
                few = (left.sum(1) <= FEW) & (more[beyond] > 0)
                if few.any():
                    q, d = np.nonzero(left[few])
                    sought.append((some[beyond[few]][q], b * BLOCK + d))
                    scores[some[beyond[few]], part] = 0.0
                    stay = np.ones(len(some), dtype=bool)
                    stay[beyond[few]] = False
                    some, got, bar = some[stay], got[stay], bar[stay]
            if not len(some):
                return
            rows = rows[used[self.row_column[rows]]]
            if len(rows):
                w = wide[self.row_column[rows]]
                got += (w if len(some) == w.shape[1] else w[:, some]).T @ self.rows[rows]
                self.read += int(postings[some].sum())
        scores[some, part] = got

    def _exact(self, q: np.ndarray, slot: np.ndarray, term: np.ndarray, weight: np.ndarray, query: np.ndarray, k: int, least: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The lists of queries ``q``, whose ``slot`` documents are scored in double precision, each in the order of its terms."""
        found = {}
        order = np.argsort(q, kind="stable")
        q, slot = q[order], slot[order]
        asked = np.zeros(len(self.terms), dtype=bool)
        weight_of = np.zeros(len(self.terms))
        which, begin = np.unique(q, return_index=True)
        own = np.searchsorted(query, np.append(which, len(least))).tolist() if len(which) else []
        ends = np.searchsorted(query, which, side="right").tolist()
        for i, (a, b) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(q)], strict=False)):
            terms, docs = term[own[i] : ends[i]], slot[a:b]
            asked[terms], weight_of[terms] = True, weight[own[i] : ends[i]]
            first, last = self.doc_first[docs], self.doc_first[docs + 1]
            held = np.concatenate([self.doc_term[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)])
            hit = np.flatnonzero(asked[held])
            upto = np.cumsum(last - first)
            doc = np.searchsorted(upto, hit, side="right")
            gain = weight_of[held[hit]] * gains(self.doc_tf[hit + (last - upto)[doc]], self.norm[docs[doc]])
            scores = np.bincount(doc, gain, len(docs))
            asked[terms] = False
            good = (scores > 0) & (scores >= least[which[i]] - SLACK)
            if good.any():
                found[int(which[i])] = best(self.ids[docs[good]], scores[good], k)
        return found


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, best first; equal scores by id, null ids last."""
    order = np.lexsort((ids, ids == NO_ID, -np.round(scores, 9)))[:k]
    return ids[order], scores[order]


def _search(k: int, mean_length: float):
    """Over rows sorted by (task, kind, place): a task's queries come before its shards, queries alike one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int] = []
        waiting: list[Terms] = []
        asked: list[Batch] = []
        least: list[np.ndarray] = []
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        task = None

        def gather() -> None:
            if waiting:
                asked.append(Batch(waiting))
                least.append(np.zeros(len(waiting)))
                waiting.clear()

        def out() -> pa.RecordBatch:
            n = [len(ids) for ids, _ in found.values()]
            query = np.repeat(np.fromiter((names[i] for i in found), dtype=np.int64, count=len(found)), n)
            ids = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found.values())])
            scores = np.concatenate([np.zeros(0), *(x for _, x in found.values())])
            return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], ["query", "doc_id", "score"])

        for b in batches:
            for row in range(b.num_rows):
                if b["task"][row].as_py() != task:
                    if found:
                        yield out()
                    names, waiting, asked, least, found, task = [], [], [], [], {}, b["task"][row].as_py()
                get = lambda c: b[c][row].as_buffer()  # noqa: B023, E731
                if not b["kind"][row].as_py():
                    names.append(b["seq"][row].as_py())
                    waiting.append((np.frombuffer(get("terms"), "<u8").copy(), np.frombuffer(get("weights"), "<f8").copy()))
                    if len(waiting) == BATCH:
                        gather()
                    continue
                gather()
                shard = Shard({c: get(c) for c in SHARD}, mean_length)
                for i, batch in enumerate(asked):
                    with one_thread():
                        new = shard.tops(batch, k, least[i])
                    for q, (ids, scores) in new.items():
                        before = found.get(i * BATCH + q)
                        if before:
                            ids, scores = best(np.concatenate([before[0], ids]), np.concatenate([before[1], scores]), k)
                        found[i * BATCH + q] = ids, scores
                        if len(scores) == k:
                            least[i][q] = scores[-1]
                del shard
                trim()
        if found:
            yield out()
        names, waiting, asked, least, found = [], [], [], [], {}
        trim()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [[x.values.to_numpy(zero_copy_only=False).tobytes() for x in b[c]] for c in ("terms", "weights")]
        yield pa.RecordBatch.from_arrays([b["query"], b["common"], *(pa.array(x, pa.binary()) for x in packed)], ["query", "common", "terms", "weights"])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each shard; ``at`` names it."""
    kinds = ", ".join(f"{c} binary" for c in SHARD)
    built = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_shards, f"n_docs long, n_terms long, {kinds}")
    return checkpoint(built.withColumn("at", F.monotonically_increasing_id()))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", query_id: str = "doc_id", query_text: str = "text") -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the k best documents for each row of ``queries``."""
    spark = docs.sparkSession
    shards = index(docs, doc_id, text)
    held_bytes = sum((F.octet_length(c) for c in SHARD), F.lit(0))
    n_shards, n_docs, n_terms, n_bytes = shards.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_terms", held_bytes)]).first()
    mean_length = max(1.0, n_terms / max(1, n_docs))
    df = shards.select("terms", "starts", "slots").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = checkpoint(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_id).cast("long").alias("query_id"), F.col(query_text).alias("text")))
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.select("query", "text").mapInArrow(_query_terms, "query long, term long, n long").join(df, "term").select("query", "term", "n", (F.col("n") * idf).alias("weight"))
    known = weighed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"), F.max(F.struct("n", "term")).getField("term").alias("common"))
    known = known.select("query", "common", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    known = checkpoint(known.mapInArrow(_pack, "query long, common long, terms binary, weights binary"))
    blocks = max(1, -(-known.count() // QUERY_BLOCK))
    groups = max(1, -(-n_bytes // TASK_BYTES), min(n_shards, -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // blocks)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    binary = lambda c: F.lit(None).cast("binary").alias(c)
    task = F.col("part") * groups + F.col("group")
    sent = known.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("group", each(groups))
    sent = sent.select(task.alias("task"), F.lit(0).alias("kind"), F.col("common").alias("place"), F.col("query").alias("seq"), "weights", *["terms" if c == "terms" else binary(c) for c in SHARD])
    # A partition's shards are dealt on from its own number, so groups are even and nothing is numbered globally.
    dealt_to = F.shiftright("at", 33) + F.col("at").bitwiseAND((1 << 33) - 1) * 7919
    held = shards.withColumn("group", F.pmod(dealt_to, F.lit(groups)).cast("int")).withColumn("part", each(blocks))
    held = held.select(task.alias("task"), F.lit(1).alias("kind"), F.col("at").alias("place"), F.col("at").alias("seq"), binary("weights"), *SHARD)
    dealt = sent.union(held).repartitionById(blocks * groups, "task").sortWithinPartitions("task", "kind", "place", "seq")
    # A row may be a whole shard.
    found = checkpoint(dealt.mapInArrow(_search(k, mean_length), "query long, doc_id long, score double"), rows=4)
    named: Column = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    by_score = W.partitionBy("query").orderBy(F.round("score", 9).desc(), F.col("doc_id").asc_nulls_last())
    merged = found.withColumn("doc_id", named).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return merged.join(asked.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score")
