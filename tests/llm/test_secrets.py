import hashlib
import random
import re

from ledgerlake.llm import secrets


def brute(text):
    out = []
    for order, (kind, p, group, least) in enumerate([
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
            ("github", "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
            ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1)]):
        for m in re.finditer(p, text or "", re.I | re.A if kind == "assign" else re.A):
            if len(m.group(group)) >= least:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def expect(rows):
    out = []
    for i, t, *_ in rows:
        spans = brute(t)
        base = ",".join(f"{k}:{s}:{e}" for s, o, e, k in spans if o < 3)
        out.append((i is None, i or 0, *[sum(k == x for *_, k in spans) for x in secrets.BASE],
                    hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, o, e, k in spans)))
    return sorted(out)


def got(df):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in secrets.digest(secrets.scan(df)).collect())


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == []
    assert q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and len(q["assign"]) == 6
    assert secrets.trigram_query("a?b*") == []
    assert secrets.trigram_query("(abc|de)f+") == []
    assert secrets.trigram_query("(abcd|bcde)+x") == [frozenset({"abc", "bcd"}), frozenset({"bcd", "cde"})]


def test_planted_and_odd_cases(make, edge_rows):
    h = "0123456789abcdef" * 2
    rows = [*edge_rows, (30, f"é PASSWORD = 'abcdef' x token:short secret=token:abcdefgh {h}", "en", "s"),
            (31, "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "en", "s"), (32, h, "en", "s"), (33, f"{h} {h}ü{h}", "en", "s"),
            (34, "ApiKey=\"zzzzzzzz\" api_key : yyyyyyyy", "en", "s"), (35, "ghp_" + "a1" * 20 + " xoxb-0123456789ab", "en", "s"),
            (36, "-----BEGIN RSA PRIVATE KEY-----", "en", "s"), (37, "\U0001F600 token=ABCDEF1234", "en", "s"),
            (None, "token=ABCDEF1234", "en", "s"), (37, "\U0001F600 token=ABCDEF1234", "en", "s")]
    assert got(make(rows)) == expect(rows)


def test_random_texts(make):
    r = random.Random(6)
    bits = ["password", "Token", "api_key", "AKIA", "secret", "=", ":", " ", "'", "é", "abcdef0123456789", "QWERTY12",
            "ABCDEFGHIJKLMNOP", "\n", "x", "\U0001F511", "ghs_" + "z" * 36]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(60))), "en", "s") for i in range(300)]
    assert got(make(rows)) == expect(rows)


def test_empty(make):
    assert got(make([])) == []


def test_rules_without_trigrams_scan_fully(make):
    rules = [secrets.Rule("hex", "[0-9a-f]{24,}")]
    df = secrets.scan(make([(1, "ab" * 20, "en", "s"), (2, "none", "en", "s")]), rules)
    assert {r["doc_id"]: len(r["spans"]) for r in df.collect()} == {1: 1, 2: 0}
