"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` together with the
literal tokens every matching URL must hold.  The rule is filed under the one
of them that fewest URLs of the table hold; a URL's tokens fetch the rules
filed under them, and only those run their expression.  The index is a hash
table: for few rules a constant array of buckets, so that a token costs one
look into one bucket; for many a table joined by token.  Everything is a
DataFrame expression.

Two kinds of rule exist.  A *site rule* ``host/path`` fits its host and all
subdomains where the URL's path starts with the rule's; of all that fit, the
longest wins.  A *pattern rule* is a free expression; it decides only where no
site rule fits, and blocks.  A URL that nothing fits is allowed.

Defined cases: a null URL and one without ``://`` have an empty host and path,
fit no rule and are allowed; host letters A-Z are lower-cased, paths are
compared as they are; repeated rows stay repeated; rules of equal length that
fit the same URL are settled by the order of their text; a URL of any length is
read whole; an empty table gives no rows, and without rules all are allowed;
columns named like the results are replaced, others are left alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Up to so many rules are looked up within the row; more are joined by token.
INLINE_RULES = 1024
#: Up to so many tokens are counted by an aggregate each; more by a group each.
COUNTED_TOKENS = 128
#: An index of up to so many rules is broadcast; a larger one is shuffled.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``rule``: its name, ``host/path`` for a site rule; ``verdict``: allow or block."""

    rule: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool = True

    @property
    def order(self) -> str:
        """Compares like (site before pattern, longer before shorter, text)."""
        return f"{int(self.site)}{len(self.rule):06d}{self.rule}"


def site_rule(verdict: str, rule: str) -> Rule:
    """``host/path``; tokens that the URL may continue aren't literal and aren't used."""
    host, slash, path = rule.partition("/")
    if not slash or not host:
        raise ValueError(f"not host/path: {rule!r}")
    host = host.lower()
    inner = path[: max((m.end() for m in re.finditer(r"[^A-Za-z0-9]", path)), default=0)]
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(TOKEN.findall(host) + TOKEN.findall(inner)))


def pattern_rule(name: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    if not tokens:
        raise ValueError(f"{name}: a pattern rule needs a literal token to be filed under")
    return Rule(name, "block", regex, tokens, site=False)


#: The rules of the registered query.  Fixed values.
SITE_RULES = (
    site_rule("block", "com/en/"),
    site_rule("allow", "example.com/en/7"),
    site_rule("allow", "net/de/"),
    site_rule("block", "example.net/de/8"),
    site_rule("block", "org/es/"),
)
#: What parts of a host's labels name sites that no text corpus wants.  Fixed values.
SITE_WORDS = "adult xxx porn escort casino poker slots bets betting pills viagra spam warez torrent".split()
#: Paths and hosts no text corpus wants.  Fixed values.
PATTERN_RULES = (
    *(pattern_rule(word, rf"^(?:[^/]*[.-])?{word}[.-][^/]*(?:/|$)", (word,)) for word in SITE_WORDS),
    pattern_rule("executable", r"/[^/]*\.exe$", ("exe",)),
    pattern_rule("login", r"/login(?:/|$)", ("login",)),
    pattern_rule("ad server", r"^ads?\.[^/]*/banner/", ("banner",)),
    pattern_rule("ad tracker", r"^(?:[^/]*[.-])?(?:ad|ads)-track\.[^/]*(?:/|$)", ("track",)),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _tokens(at: Column) -> Column:
    return F.array_distinct(F.filter(F.split(at, "[^A-Za-z0-9]+"), lambda t: t != ""))


def index_rules(pages: DataFrame, rules: tuple[Rule, ...], at: str = "__at") -> dict[str, list[Rule]]:
    """Rules by the token that fewest URLs hold; ties by the token's text.

    Only tokens that rules name are counted, over all rows, so what reaches
    the driver is no longer than the rules.
    """
    named = sorted({t for r in rules for t in r.tokens})
    if len(named) <= COUNTED_TOKENS:
        held = pages.select(_tokens(F.col(at)).alias("ts"))
        row = held.agg(*[F.count_if(F.array_contains("ts", t)).alias(f"c{k}") for k, t in enumerate(named)]).first()
        counts = dict(zip(named, row, strict=True))
    else:
        spark = pages.sparkSession
        words = spark.createDataFrame([(t,) for t in named], "token string")
        held = pages.select(F.explode(_tokens(F.col(at))).alias("token")).groupBy("token").count()
        counts = {r["token"]: r["count"] for r in held.join(words, "token", "left_semi").collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return index


def _entry(token: str, r: Rule) -> Column:
    values = {"token": token, "order": r.order, "rule": r.rule, "verdict": r.verdict, "site": r.site, "regex": r.regex}
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def _buckets(index: dict[str, list[Rule]]) -> tuple[Column, int]:
    """A constant array of buckets; a token's rules lie in the bucket of its checksum."""
    n = 2 * len(index) + 1
    listed: list[list[Column]] = [[] for _ in range(n)]
    for token, filed in sorted(index.items()):
        listed[zlib.crc32(token.encode()) % n] += [_entry(token, r) for r in filed]
    none = F.array().cast("array<struct<token:string,order:string,rule:string,verdict:string,site:boolean,regex:string>>")
    return F.array(*[F.array(*x) if x else none for x in listed]), n


def _fetched(tokens: Column, index: dict[str, list[Rule]]) -> Column:
    """The rules filed under a URL's tokens."""
    buckets, n = _buckets(index)
    return F.flatten(F.transform(tokens, lambda t: F.filter(F.get(buckets, F.pmod(F.crc32(t.cast("binary")), F.lit(n)).cast("int")), lambda e: e["token"] == t)))


def _inline(index: dict[str, list[Rule]]) -> Column:
    """The best fitting rule as a struct, found without leaving the row; only fetched rules run."""
    fits = F.filter(_fetched(_tokens(F.col("__at")), index), lambda e: F.rlike(F.col("__at"), e["regex"]))
    return F.array_max(F.transform(fits, lambda e: F.struct(*[e[c].alias(c) for c in ("order", "rule", "verdict", "site")])))


def _joined(pages: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """``__at`` with its best fitting rule, for each distinct URL that has one."""
    rows = [(t, r.order, r.rule, r.verdict, r.site, r.regex) for t, filed in index.items() for r in filed]
    filed = pages.sparkSession.createDataFrame(rows, "token string, order string, rule string, verdict string, site boolean, regex string")
    if len(rows) <= BROADCAST_RULES:
        filed = F.broadcast(filed)
    urls = pages.select("__at").distinct()
    fetched = urls.select("__at", F.explode(_tokens(F.col("__at"))).alias("token")).join(filed, "token").filter("__at rlike regex")
    return fetched.groupBy("__at").agg(F.max(F.struct("order", "rule", "verdict", "site")).alias("__best"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, url: str = "url", inline: bool | None = None) -> DataFrame:
    """``pages`` with host, path, rule, pattern and verdict.

    ``rule`` is the site rule that decided, ``pattern`` the pattern rule where
    no site rule did; at most one isn't null.  Columns of these names are
    replaced.  ``inline`` chooses the way of looking rules up; both give the
    same rows.
    """
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path}).withColumn("__at", F.concat("host", "path"))
    if rules:
        index = index_rules(out, rules)
        if len(rules) <= INLINE_RULES if inline is None else inline:
            out = out.withColumn("__best", _inline(index))
        else:
            out = out.join(_joined(out, index), "__at", "left")
        best = F.col("__best")
        out = out.withColumns(
            {
                "rule": F.when(best["site"], best["rule"]),
                "pattern": F.when(~best["site"], best["rule"]),
                "verdict": F.coalesce(best["verdict"], F.lit("allow")),
            }
        ).drop("__best")
    else:
        out = out.withColumns({"rule": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    return out.drop("__at")


def sql(rules: tuple[Rule, ...] = SITE_RULES) -> str:
    """The registered query in DuckDB SQL, without an index: every rule is tried."""
    values = ", ".join(f"('{r.rule}', '{r.verdict}', '{r.rule.split('/', 1)[0]}', '/{r.rule.split('/', 1)[1]}')" for r in rules)
    patterns = " OR ".join(f"regexp_matches(host || path, '{r.regex}')" for r in PATTERN_RULES)
    return f"""
WITH rules(rule, verdict, rule_host, rule_path) AS (VALUES {values}),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest)
SELECT page_id, host, path,
       arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(verdict, length(rule)), CASE WHEN {patterns} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT row_number() OVER () AS n, * FROM parts) p LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY n, page_id, host, path"""
