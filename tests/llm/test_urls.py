import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoofscope.llm import urls
from spoofscope.llm.queries import QUERIES, URL_RULES


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id bigint, url string")


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:end]


def rule(host, path):
    best = None
    for r in URL_RULES:
        at, _, rest = r.place.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest) and (best is None or len(r.place) > len(best.place)):
            best = r
    return best


URLS = [None, "", "nope", "http://", "://x.com/", "HTTP://WWW.Example.COM/en/1?q#f", "http://a.example.com/en/x", "http://example.com/EN/",
        "https://notexample.com/en/", "http://x.net/es/", "http://x.net/es", "http://net/fr/a", "http://b.org?x://y.com/", "a://b\nc.net/fr/\nd", "http://É.org/ü/1"]


def test_parts_and_rules(pages, spark):
    counts = spark.createDataFrame([("the", 5)], "word string, n bigint")
    got = {r.page_id: r for r in urls.judged(pages(URLS), URL_RULES, counts).collect()}
    for i, u in enumerate(URLS):
        r, want = got[i], parse(u)
        assert (r.host, r.path) == want, u
        best = rule(*want)
        assert r.rule == (best and best.place) and (best is None or r.verdict == best.verdict) and r.verdict in ("allow", "block")


def best_split(label, logp, unknown):
    """The highest score over all ways to split."""
    best = [0.0] + [float("-inf")] * len(label)
    for e in range(1, len(label) + 1):
        best[e] = best[e - 1] + unknown
        for s in range(e):
            if label[s:e] in logp:
                best[e] = max(best[e], best[s] + logp[label[s:e]])
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=8))
def test_segmentation_is_the_most_probable(label, counts):
    total = sum(counts.values()) or 1
    logp = {w: math.log(n / total) for w, n in counts.items()}
    unknown = -math.log(total + 1.0) - urls.UNKNOWN
    pieces = [(s, n, logp[label[s:s + n]]) for s in range(len(label)) for n in range(1, 5) if label[s:s + n] in logp and s + n <= len(label)]
    words = urls.segment(label, pieces, unknown)
    assert "".join(words) == label
    score = sum(logp[w] if w in logp else unknown * len(w) for w in words)
    assert score == pytest.approx(best_split(label, logp, unknown))


def test_verdicts_equal_brute_force(spark, pages):
    counts = {"spam": 9, "farm": 9, "good": 9, "news": 9, "read": 2, "sp": 1}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rows = (["http://spamfarm.x.net/es/buy1"] * 3 + ["http://goodnews.com/read"] * 4 + ["http://spam.net/fr/buy"] + [None]
            + ["http://spamfarm.org/buy", "http://goodnews.org/read", "http://unseen.org/", "http://farm-news.org/9"] * 2)
    got = urls.judged(pages(rows), URL_RULES, table).collect()
    total = sum(counts.values())
    logp = {w: math.log(n / total) for w, n in counts.items()}

    def tokens(host, path):
        import re
        out = []
        for label in re.split(r"[.\-0-9_:@]+", host):
            pieces = [(s, n, logp[label[s:s + n]]) for s in range(len(label)) for n in range(1, 25) if label[s:s + n] in logp and s + n <= len(label)]
            out += urls.segment(label, pieces, -math.log(total + 1.0) - urls.UNKNOWN)
        return out + ["0" if w.isdigit() else w.lower() for w in re.findall(r"[^\W\d_]+|[0-9]+", path)]

    seen, n = {"allow": Counter(), "block": Counter()}, Counter()
    for u in rows:
        r = rule(*parse(u))
        if r:
            seen[r.verdict].update(tokens(*parse(u)))
            n[r.verdict] += 1
    words = set(seen["allow"]) | set(seen["block"])
    a, b = (sum(seen[k].values()) + len(words) + 1 for k in ("allow", "block"))
    for r in got:
        if r.rule is None:
            score = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(
                math.log((seen["block"][w] + 1) / b) - math.log((seen["allow"][w] + 1) / a) for w in tokens(r.host, r.path) if w in words)
            assert r.score_micro == pytest.approx(1e6 * score, abs=50) and r.verdict == ("block" if r.score_micro > 0 else "allow")
    verdict = {r.host: r.verdict for r in got}
    assert verdict["spamfarm.org"] == "block" and verdict["goodnews.org"] == "allow"


def test_empty_tables_and_clashing_columns(spark, pages):
    counts = spark.createDataFrame([], "word string, n bigint")
    assert urls.judged(pages([]), URL_RULES, counts).count() == 0
    got = urls.judged(pages(["http://a.org/x"] * 3).withColumn("host", F.lit(1)), URL_RULES, counts).collect()
    assert [r.host for r in got] == ["a.org"] * 3
    with pytest.raises(ValueError):
        urls.rule_for(F.lit(""), F.lit(""), [urls.Rule("allow", "x/")] * (urls.MOST_RULES + 1))


def test_query_covers_every_page(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in QUERIES["op10_url_filter"](spark, d).collect()}
    for p in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect():
        assert (got[p.page_id].host, got[p.page_id].path) == parse(p.url)
