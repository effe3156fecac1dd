import re

from ledgerlake.llm import surrogates as S

KEY = b"test"
TEXTS = [
    "Write to anna.lee42@mail.example.com or ANNA.LEE42@mail.example.com, call +1 (626) 555-5759.",
    "From 42.144.35.254 paid 4041894974608795 and 4111 1111 1111 1111; SSN 123-45-6789.",
    "Frau Müller met Mr. John Smith and Mr Smith. IBAN DE44 5001 0517 5407 3249 31.",
    "anna.lee42@mail.example.com again, 16265555759 is no phone but 626-555-5759 is one. госпожа Анна Иванова",
    "Version 3.0, 12 items, 2024 and 1.2.3.4.5 stay. The Man in Mrs x.",
]


def run(make, texts, extra=()):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + list(extra)
    return S.pseudonymize(make(rows), KEY)


def test_replaces_all_and_only_entities(make):
    got = {r["doc_id"]: r for r in run(make, TEXTS).collect()}
    for i, t in enumerate(TEXTS):
        found = S.mentions(t)
        assert got[i]["n_entities"] == len(found)
        for a, b, kind, canon in found:
            assert t[a:b] not in got[i]["text"], (kind, t[a:b])
        # what lies between mentions stays
        at = 0
        for a, b, *_ in found:
            assert t[at:a].strip() in got[i]["text"]
            at = b
    assert got[4]["text"] == TEXTS[4]


def test_kinds():
    kinds = [[k for _, _, k, _ in S.mentions(t)] for t in TEXTS]
    assert kinds == [["email", "email", "phone"], ["ip", "card", "card", "ssn"],
                     ["surname", "given:m", "surname", "surname", "iban"], ["email", "phone", "given:f", "surname"], []]


def test_format_script_gender_and_coreference(make):
    got = {r["doc_id"]: r["text"] for r in run(make, TEXTS).collect()}
    lower, upper = re.findall(r"[\w.]+@[\w.]+\.com", got[0])
    assert upper.partition("@")[0] == lower.partition("@")[0].upper() and lower in got[3]
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", got[0])
    luhn = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1]).group().replace(" ", "")
    assert S._luhn(luhn) and luhn != "4111111111111111"
    assert re.search(r"SSN 9\d\d-\d\d-\d{4}", got[1])
    assert re.search(r"IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", got[2])
    a, b = re.search(r"Mr\. (\w+) (\w+) and", got[2]).group(2), re.search(r"and Mr (\w+)\.", got[2]).group(1)
    assert a == b
    assert re.search(r"госпожа [А-Я][а-я]*а [А-Я][а-я]+$", got[3])
    assert re.search(r"госпожа", got[3]) and not re.search("Анна|Иванова", got[3])


def test_key_decides(make):
    rows = [(0, TEXTS[0], "en", "s")]
    a = S.pseudonymize(make(rows), KEY).first()["text"]
    assert a == S.pseudonymize(make(rows), KEY).first()["text"] != S.pseudonymize(make(rows), b"other").first()["text"]


def test_collisions_are_drawn_again(spark):
    """More than half of all one-digit addresses are entities: surrogates must
    still be distinct and never a real address."""
    ips = [f"{a}.{b}.{c}.1" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10)]
    df = spark.createDataFrame([("ip", x) for x in ips], "kind string, canon string")
    got = S.draw_surrogates(df, KEY).collect()
    assert len(got) == len(ips) == len({r["surrogate"] for r in got})
    assert not {r["surrogate"] for r in got} & set(ips)


def test_a_used_up_shape_grows(spark):
    ips = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    df = spark.createDataFrame([("ip", x) for x in ips], "kind string, canon string")
    got = S.draw_surrogates(df, KEY).collect()
    assert len({r["surrogate"] for r in got} - set(ips)) == len(ips)


def test_formats_of_one_phone_number_share_a_surrogate(make):
    groups = [["+1 (626) 555-5759", "+16265555759", "+1-626-555-5759", "+1 626.555.5759", "(626) 555-5759", "626-555-5759"],
              ["+49 30 1234", "+49301234", "+49 (30) 1234", "+49 (0)30 1234", "+49-301-234"], ["+351 21 1234", "+351211234"]]
    texts = [f"call {x}." for g in groups for x in g]
    got = {texts[r["doc_id"]]: r["text"] for r in run(make, texts).collect()}
    for g in groups:
        out = [got[f"call {x}."].removeprefix("call ").removesuffix(".") for x in g]
        assert [re.sub("[0-9]", "0", x) for x in out] == [re.sub("[0-9]", "0", x) for x in g]
        assert len({S.phone(x) for x in out}) == 1 and not {S.phone(x) for x in g} & {S.phone(x) for x in out}
        assert all(x.startswith(y[:y.index(" ")]) for x, y in zip(out, [g[0]] * len(g)) if x[0] == "+")
    assert "(0)" in got["call +49 (0)30 1234."]


def test_written_phone_numbers_are_distinct_and_not_real(make):
    """Most national numbers are taken, under one-, two- and three-digit codes."""
    texts = [f"{code} {n // 100:02d} {n % 100:02d}" for code in ("+7", "+49", "+351") for n in range(9500)]
    got = [r["text"] for r in run(make, texts).collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert sorted({t.split()[0] for t in got}) == ["+351", "+49", "+7"]


def test_iban_check_digits_stay_valid():
    for a, valid in (("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("DE88370400440532013000", False)):
        drawn = [S.surrogate(KEY, "iban", a, i) for i in range(30)]
        assert all(S._mod97(x) == 1 for x in drawn) == valid
        assert all(x[:2] == a[:2] for x in drawn) and len(drawn[0]) == len(a)


def test_names_of_any_number_of_words(make):
    names = {
        "John Michael Smith": "John Michael Smith", "Mary Ann Johnson": "Mary Ann Johnson",
        "Mr Juan Carlos Garcia Lopez": "Juan Carlos Garcia Lopez", "Herr von der Leyen": "Leyen",
        "Dr. Anna Maria Luisa van Beethoven": "Anna Maria Luisa Beethoven", "María de la Cruz Romero": "María Cruz Romero",
        "John Paul George Richard Thomas Peter O'Brien": "John Paul George Richard Thomas Peter O'Brien",
        "Mary Ann McDonald": "Mary Ann McDonald", "Jean d'Arcy": "Jean Arcy",
    }
    for t, words in names.items():
        found = S.mentions(f"so {t}, then")
        assert [f"so {t}, then"[a:b] for a, b, *_ in found] == words.split(), t
        assert [k.partition(":")[0] for _, _, k, _ in found] == ["given"] * (len(found) - 1) + ["surname"], t
    assert [k for _, _, k, _ in S.mentions("Mary Ann Johnson")] == ["given:f", "given:f", "surname"]
    assert S.mentions("Peter der Hund") == S.mentions("Klaus das Buch") == []
    got = {r["doc_id"]: r["text"] for r in run(make, [*names, "John Smith", "Mr Smith"]).collect()}
    for i, words in enumerate(names.values()):
        assert not set(words.split()) & set(re.findall(r"[\w']+", got[i]))
    john, michael, smith = got[0].split()
    assert got[9].split() == [john, smith] and got[10].split() == ["Mr", smith]
    assert got[3].startswith("Herr von der ") and " van " in got[4] and " de la " in got[5] and " d'" in got[8]


def test_edge_rows(make, edge_rows):
    mail = "x@y.example.com"
    extra = [(None, mail, "en", "s"), (50, mail, "en", "s"), (50, mail, "en", "s")]
    docs = make([*edge_rows, *extra])
    out = S.pseudonymize(docs, KEY)
    assert out.columns == [*docs.columns, "n_entities"]
    got = out.collect()
    assert len(got) == len(edge_rows) + 3
    assert sum(r["n_entities"] for r in got) == 3
    assert len({r["text"] for r in got if r["n_entities"]}) == 1
    clean = {i: t for i, t, *_ in edge_rows if i is not None}
    assert all(r["text"] == clean[r["doc_id"]] for r in got if r["doc_id"] in clean)
    assert S.pseudonymize(make([]), KEY).count() == 0


def test_n_entities_of_the_input_is_replaced(make):
    df = make([(1, "a@b.example.org", "en", "s")])
    from pyspark.sql import functions as F
    assert S.pseudonymize(df.withColumn("n_entities", F.lit(9)), KEY).first()["n_entities"] == 1
