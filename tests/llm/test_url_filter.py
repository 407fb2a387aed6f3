"""The cascade of filters against rules read one by one, and its levels against the keys they were built from."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import url_filter
from strandloom.llm.url_filter import _as_array, build_cascade, judge_urls

SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, `a.b c` string"
RULES = "host string, path string, verdict string"
FIXED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url, rules):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, v in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p), h.count("."), h + p, v))
    return host, path, best and best[2], best[3] if best else "allow"


def compared(spark, urls, rules, **options):
    rows = [(i, u, "h", "p", "r", "v", "x") for i, u in enumerate(urls)] + [(None, urls[0] if urls else None, *"hprvx")]
    got = judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(rules, RULES), **options)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(r[0], *judged(r[1], rules)) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


ODD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://xnet/", "http://.net/", "http://net./", "http://a..net/b", "https://www.Example.NET/en/1", "https://example.net/en",
    "https://myexample.net/en/2", "https://example.com?x=/de/", "https://example.com/de/?a://b.net/", "http://ORG/fr/", "http://É.org/fr/ü", "ftp://a://b.net/c", "http://a.org/fr/\nsecond", "http://a.net#/en/", "x" * 50_000 + "://" + "a." * 20_000 + "net/" + "p" * 50_000,
]


def test_odd_urls(spark):
    compared(spark, ODD + ODD[5:9], FIXED)


def test_no_rows_and_no_rules(spark):
    compared(spark, ODD, [])
    assert judge_urls(spark.createDataFrame([], SCHEMA), spark.createDataFrame(FIXED, RULES)).collect() == []


def many(seed=1):
    rng = random.Random(seed)
    name = lambda: ".".join(rng.choice(["a", "b", "cc", "d%d" % rng.randrange(40)]) for _ in range(rng.randint(1, 3)))
    rules = list({(name(), rng.choice(["", "/", "/x", "/x/", "/y/z"])): rng.choice(["allow", "block"]) for _ in range(400)}.items())
    urls = [f"http://{name()}.{name()}{rng.choice(['', '/', '/x', '/xy', '/x/1', '/y/z?q', '/y'])}" for _ in range(3000)]
    return urls, [(h, p, v) for (h, p), v in rules]


@pytest.mark.parametrize("bits", [4.0, 16.0])
def test_long_list(spark, bits):
    """At four bits a key many keys are taken wrongly, so several levels must put them right."""
    compared(spark, *many(), bits_per_key=bits)


@pytest.mark.parametrize("bound", ["MAX_WORDS", "MAX_SHAPES"])
def test_beyond_the_bounds(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, bound, 2)
    compared(spark, *many(2))


def test_rules_that_fit_nothing_and_both_ways(spark):
    rules = [("", "/", "block"), (None, "/", "block"), ("a.b", "x", "block"), ("a/b", "/", "block"), ("c.b", "/", "odd"), ("d.b", "/", None), ("E.b", None, "allow"), ("f.b", "/", "block"), ("f.b", "/", "allow"), ("f.b", "/", "allow")]
    urls = [f"http://{h}.b/x" for h in "acdef"]
    got = judge_urls(spark.createDataFrame([(i, u, *"hprvx") for i, u in enumerate(urls)], SCHEMA), spark.createDataFrame(rules, RULES)).collect()
    assert [(r.rule, r.verdict) for r in sorted(got)] == [(None, "allow")] * 3 + [("e.b", "allow"), ("f.b/", "block")]


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade, words = build_cascade(keys.filter("listed").select("key"), keys.filter("not listed").select("key"), bits_per_key=4.0)
    assert len(cascade.levels) > 2
    array = _as_array(words, sum(x.words for x in cascade.levels))
    assert keys.filter(cascade.holds(F.col("key"), array) != F.col("listed")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = judge_urls(spark.createDataFrame([(1, "http://a.net/", *"hprvx")], SCHEMA), spark.createDataFrame(FIXED, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
