import math

import numpy as np
import pytest

from ledgerlake.llm import urlrep

PAGES = "page_id long, url string, host string, n int"


def judge(spark, urls, bad=()):
    pages = spark.createDataFrame([(i, u, "h", 0) for i, u in enumerate(urls)], PAGES)
    marks = spark.createDataFrame(list(bad), "page_id long, bad boolean")
    return {r["page_id"]: r for r in urlrep.judge_urls(pages, marks).collect()}


def test_rules_and_parts(spark):
    got = judge(spark, [
        "http://Example.com/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/q", "http://x.net/es/1",
        "http://x.net/es", "http://net/fr/", "http://com", "http://com/", "http://xcom/", "http://notexample.com/en/",
        None, "no scheme", "a://b://c/d", "http://h?q=/en/", "http://h#/x", "http://example.com/EN/", "http://a.example.com/en/"])
    want = [
        ("example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("a.www.example.com", "/en/q", "www.example.com/en/", "allow"), ("x.net", "/es/1", "net/es/", "block"),
        ("x.net", "/es", None, "allow"), ("net", "/fr/", "net/fr/", "block"), ("com", "", None, "allow"),
        ("com", "/", "com/", "allow"), ("xcom", "/", None, "allow"), ("notexample.com", "/en/", "com/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("h", "", None, "allow"),
        ("h", "", None, "allow"), ("example.com", "/EN/", "com/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block")]
    # no label at all: what no rule fits is allowed
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(want))] == want


def test_empty(spark):
    assert judge(spark, []) == {}


def beta_cdf(x, a, b):
    """Incomplete beta integral by the midpoint rule in a variable without
    poles (t = u ** (1 / a) below x, its mirror above)."""
    u = (np.arange(20_000) + 0.5) / 20_000
    low = np.mean((1 - x * u ** (1 / a)) ** (b - 1)) * x ** a / a
    high = np.mean((1 - (1 - x) * u ** (1 / b)) ** (a - 1)) * (1 - x) ** b / b
    return low / (low + high)


def reference(pages, limit=0.3):
    """Chance that a host's bad rate is within the limit, host by host in plain
    Python: pages are (host, domain, suffix, bad or None)."""
    counts, above = {}, {}
    for h, d, s, bad in pages:
        k, g = counts.get(h, (0, 0))
        counts[h] = (k + (bad is True), g + (bad is False))
        above[h] = (d, s)

    def summed(level):
        out = {}
        for h, (k, g) in counts.items():
            x = out.setdefault(above[h][level], [0, 0])
            x[0] += k
            x[1] += g
        return out

    def strength(c):
        c = [(k + g, k) for k, g in c.values() if k + g]
        n_all, k_all, m = sum(n for n, _ in c), sum(k for _, k in c), len(c)
        if m < 2 or k_all in (0, n_all):
            return 1.0
        mu = k_all / n_all
        room = mu * (1 - mu) * (n_all - sum(n * n for n, _ in c) / n_all - (m - 1))
        if room <= 0:
            return 1.0
        share = (sum(n * (k / n - mu) ** 2 for n, k in c) - mu * (1 - mu) * (m - 1)) / room
        return 1e4 if share <= 0 else min(1e4, max(1.0, 1 / share - 1))

    kh, kd, ks = strength(counts), strength(summed(0)), strength(summed(1))

    def fewer(pair, k):
        return [v * (k + 1) / (sum(pair) + k) for v in pair]

    def total(pairs):
        return [sum(p[0] for p in pairs), sum(p[1] for p in pairs)]

    def domain_counts(d, but=None):
        return total([fewer(counts[h], kh) for h in counts if above[h][0] == d and h != but])

    def suffix_counts(s, but=None):
        return total([fewer(domain_counts(d), kd) for d in {above[h][0] for h in counts if above[h][1] == s} - {but}])

    out = {}
    for h, (d, s) in above.items():
        post = total([[0.5, 0.5], *[fewer(suffix_counts(x), ks) for x in {v[1] for v in above.values()} - {s}]])
        for others, k in ((suffix_counts(s, d), ks), (domain_counts(d, h), kd), (counts[h], kh)):
            shrunk = min(1, k / sum(post))
            post = [v * shrunk + o for v, o in zip(post, others)]
        out[h] = beta_cdf(limit, *post)
    return out


def test_normal_approximation(spark):
    grid = [(a / 4, b / 4) for a in range(2, 80, 3) for b in range(2, 80, 3) if a + b >= 8]
    df = spark.createDataFrame(grid, "a double, b double")
    rows = df.select("a", "b", urlrep.within_z(df["a"], df["b"], 0.3).alias("z")).collect()
    off = [abs(beta_cdf(0.3, r["a"], r["b"]) - 0.5 * (1 + math.erf(r["z"] / 2 ** 0.5))) for r in rows
           if 0.01 < beta_cdf(0.3, r["a"], r["b"]) < 0.12]
    assert len(off) > 20 and max(off) < 0.01


@pytest.mark.parametrize("marks,blocked", [
    ([], set()), ([(0, True)], set()), ([(0, True), (1, False)], set()), ([(0, False)], set()),
    ([(0, True)] * 1 + [(i, True) for i in range(6, 26)], {0})])
def test_little_evidence_blocks_nobody_else(spark, marks, blocked):
    """Six hosts of six suffixes; the last case puts 21 bad pages on the first."""
    urls = [f"http://h.d{i}.s{i}/" for i in range(6)] + ["http://h.d0.s0/x"] * 20
    got = judge(spark, urls, marks)
    assert {i for i in range(6) if got[i]["verdict"] == "block"} == blocked


def test_domain_of_many_bad_hosts_blocks_a_new_one(spark):
    urls = ["http://new.spam.org/"] + [f"http://h{i}.spam.org/" for i in range(40)] + [f"http://a.ok{i}.org/" for i in range(40)]
    got = judge(spark, urls, [(i, i <= 40) for i in range(1, 81)])
    assert got[0]["verdict"] == "block" and got[41]["verdict"] == "allow"


def test_long_urls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://A.org/" + "x" * 200_000, "h", 1), (2, None, "g", 2), (None, "http://b.org", "", 3)],
                                  "page_id long, url string, host string, bad int")
    marks = spark.createDataFrame([(1, True, "u")], "page_id long, bad boolean, url string")
    got = {r["page_id"]: (r["host"], len(r["path"]), r["verdict"]) for r in urlrep.judge_urls(pages, marks).collect()}
    assert got == {1: ("a.org", 200_001, "allow"), 2: ("", 0, "allow"), None: ("b.org", 0, "allow")}


def test_shrinkage_equals_plain_computation(spark):
    import random
    r = random.Random(5)
    pages = []
    for h in range(60):
        suffix = ["org", "io", "co.uk"][h % 3]
        domain = f"d{h % 17}.{suffix}"
        rate = r.choice([0.02, 0.1, 0.9])
        for _ in range(r.choice([0, 1, 3, 40]) + 1):
            pages.append((f"h{h}.{domain}", domain, suffix, r.choice([None, r.random() < rate, r.random() < rate])))
    got = judge(spark, [f"http://{p[0]}/" for p in pages], [(i, p[3]) for i, p in enumerate(pages) if p[3] is not None])
    want = reference(pages)
    assert {got[i]["verdict"] for i in got} == {"allow", "block"}
    limit = 0.5 * (1 + math.erf(-1.64 / 2 ** 0.5))
    sure = [i for i, p in enumerate(pages) if abs(want[p[0]] - limit) > 0.01]
    assert len(sure) > 0.9 * len(pages)
    assert all((got[i]["verdict"] == "block") == (want[pages[i][0]] < limit) for i in sure)


def test_registered_domain(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.example.org:8080", "u:p@q.r.de", "10.0.0.1", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    d, s = urlrep.registered_domain(df["h"])
    assert [tuple(r) for r in df.select(d, s).collect()] == [
        ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.org", "org"), ("r.de", "de"), ("10.0.0.1", "10.0.0.1"),
        ("localhost", "localhost"), ("", "")]


def test_labels_of_null_and_repeated_ids(spark):
    got = judge(spark, ["http://a.org/", "http://a.org/"], [(0, True), (0, False), (None, True), (1, None)])
    assert len(got) == 2
