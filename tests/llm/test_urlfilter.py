import pytest
from pyspark.sql import functions as F

from tidemill.llm import urlfilter as U

URLS = [
    "http://a.example.com/en/825?x=1",
    "https://EXAMPLE.com/en/7",
    "https://example.com/en/712#top",
    "https://notexample.com/en/7",
    "https://x.example.net/de/81",
    "https://x.example.net/de/9",
    "https://net/de/",
    "https://net/DE/",
    "ftp://blog.example.org/es/1",
    "https://example.org",
    "https://example.org?q=/es/",
    "https://h.fr/setup.exe",
    "https://h.fr/setup.exe?x",
    "https://h.fr/login",
    "https://h.fr/loginpage",
    "https://ads.h.fr/banner/1",
    "https://m.ads-track.h.fr/en/1",
    "https://blog.casino-win.h.fr",
    "https://casinos.h.fr/",
    "https://h.casino/",
    "https://adult-x.example.com/en/9",
    "no scheme/en/",
    "",
    None,
    "://com/en/",
    "https://com/en/\nx",
    "https://h.fr/" + "a/" * 20000,
]


def plain(url):
    """Every rule tried in turn."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for r in U.SITE_RULES:
        h, p = r.rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.rule), r.rule, r.verdict))
    if fits:
        return host, path, *max(fits)[1:]
    import re

    blocked = any(re.search(r.regex, host + path) for r in U.PATTERN_RULES)
    return host, path, None, "block" if blocked else "allow"


@pytest.mark.parametrize("inline", [True, False])
def test_matches_plain_rules(spark, inline):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(df, inline=inline).collect()}
    assert got == {k: plain(u) for k, u in enumerate(URLS + URLS[:3])}


def test_only_fetched_rules_run(spark, monkeypatch):
    """A rule filed under a token that no URL holds is never reached, so results come through the index."""
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    for inline in (True, False):
        assert U.filter_urls(df, inline=inline).filter("rule is not null").count() > 0
        with monkeypatch.context() as patch:
            patch.setattr(U, "index_rules", lambda pages, rules, at="__at": {"nowhere": list(rules)})
            assert U.filter_urls(df, inline=inline).filter("rule is not null or pattern is not null").count() == 0
    held = spark.createDataFrame([("example.com/en/1",)], "__at string")
    index = {"com": [U.SITE_RULES[0]], "absent": list(U.SITE_RULES[1:])}
    assert [e["rule"] for e in held.select(U._fetched(U._tokens(F.col("__at")), index).alias("x")).first()["x"]] == ["com/en/"]


@pytest.mark.parametrize("most", [0, 10_000])
def test_large_sets_of_rules(spark, monkeypatch, most):
    """Joined by token, broadcast or shuffled, and looked up in the row: the same rows."""
    monkeypatch.setattr(U, "BROADCAST_RULES", most)
    monkeypatch.setattr(U, "COUNTED_TOKENS", 20)
    rules = U.SITE_RULES + U.PATTERN_RULES + tuple(U.site_rule("block" if k % 2 else "allow", f"host{k}.example.com/en/{k % 7}") for k in range(1500))
    urls = [f"https://a.host{k}.example.com/en/{j}x" for k in range(0, 1600, 9) for j in (k % 7, 9)] + URLS
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {inline: sorted(map(tuple, U.filter_urls(df, rules, inline=inline).select("page_id", "rule", "verdict").fillna("").collect())) for inline in (None, True)}
    assert got[None] == got[True]
    want = {f"host{k}.example.com/en/{k % 7}" for k in range(0, 1500, 9)}
    assert want <= {r for _, r, _ in got[None]}


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("example.com/en/1",), ("example.com/en/2",), ("example.net/en/2",)], "__at string")
    index = U.index_rules(df, (U.site_rule("block", "example.com/en/"), U.site_rule("allow", "example.net/en/")))
    assert {t: [r.rule for r in rs] for t, rs in index.items()} == {"com": ["example.com/en/"], "net": ["example.net/en/"]}


def test_a_token_the_url_may_continue_is_not_literal():
    assert U.site_rule("allow", "example.com/en/7").tokens == ("example", "com", "en")


def test_empty_table_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(none).count() == 0
    one = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    assert U.filter_urls(one, ()).first()["verdict"] == "allow"


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    plan = U.filter_urls(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
