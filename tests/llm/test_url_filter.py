import math
from collections import Counter

import pytest

from lodestar.llm import url_filter as u

PAGES = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def rule(host, path):
    best = None
    for verdict, site in u.RULES:
        domain, _, rest = site.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(site) > len(best[1])):
            best = (verdict, site)
    return best


URLS = (
    [f"http://h{i}.example.{t}/{lang}/{i}" for i in range(12) for t in ("com", "net", "org") for lang in ("en", "fr", "es", "de")]
    + ["https://WWW.Example.COM/en/x?q=http://a.net/es/", "http://net/es/", "http://net/es", "http://xnet/es/1", "ftp://a.b.net?x/es/", "http://com", "http://com/", "com/", None, "", "://", "http://é.com/ü", "http://x.org/" + "a" * 20_000, "x://a.net#/es/"]
)


def model(urls):
    """The two smoothed Markov models and the threshold by plain counting."""
    import numpy as np

    def code(url):
        return [u.ALPHABET.find("0" if c.isdigit() and c.isascii() else c) + 1 for c in (url or "").lower()]

    counts = {True: [Counter(), Counter(), Counter()], False: [Counter(), Counter(), Counter()]}
    for url, good in urls:
        s = [0, 0, *code(url)]
        for i in range(2, len(s)):
            for k in range(3):
                counts[good][k][tuple(s[i - k : i + 1])] += 1

    def p(good, gram):
        out = 1 / u.SYMBOLS
        for k in range(3):
            context = gram[2 - k : 2]
            seen = {g: n for g, n in counts[good][k].items() if g[:k] == context}
            n, t = sum(seen.values()), len(seen)
            if n:
                out = (seen.get(gram[2 - k :], 0) + t * out) / (n + t)
        return out

    cache = {}

    def score(url):
        s = [0, 0, *code(url)]
        total = 0
        for i in range(2, len(s)):
            g = tuple(s[i - 2 : i + 1])
            if g not in cache:
                cache[g] = int(np.round((math.log(p(True, g)) - math.log(p(False, g))) * 1e6))
            total += cache[g]
        return total / 1e6 / (len(s) - 2) if len(s) > 2 else 0.0

    return score


def test_against_plain_counting(spark):
    df = spark.createDataFrame([(i, url, None) for i, url in enumerate(URLS)], PAGES)
    got = {r.page_id: r for r in u.judge(df).collect()}
    assert len(got) == len(URLS)
    held = {r.page_id for r in df.selectExpr("page_id", "pmod(xxhash64(url), 5L) = 0 AS h").collect() if r.h}
    known = [(i, url, rule(*parts(url))) for i, url in enumerate(URLS)]
    score = model([(url, r[0] == "allow") for i, url, r in known if r and i not in held])
    for i, url, r in known:
        row = got[i]
        assert (row.host, row.path) == parts(url)
        assert row.rule == (r[1] if r else None)
        if r:
            assert row.verdict == r[0]
        else:
            assert row.score == pytest.approx(score(url), abs=3e-6) and row.verdict in ("allow", "block")
    free = sorted((got[i].score, got[i].verdict) for i, _, r in known if not r)
    verdicts = [v for _, v in free]
    assert verdicts == sorted(verdicts, reverse=True)  # block below the threshold, allow from it on


def test_edge_cases(spark):
    assert u.judge(spark.createDataFrame([], PAGES)).count() == 0
    rows = u.judge(spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://a.org/", None)], PAGES)).collect()
    assert [(r.score, r.verdict) for r in rows] == [(0.0, rows[0].verdict)] * 3


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(i, url, None) for i, url in enumerate(URLS)], PAGES)
    assert "Python" not in (plan := u.judge(df)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
