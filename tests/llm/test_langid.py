import zlib

from pyspark.sql import functions as F

from ledgerlake.llm import langid
from ledgerlake.llm.common import table
from tests.conftest import SF_CHECK


def test_held_out_accuracy(spark):
    docs = table(spark, SF_CHECK, "documents")
    got = langid.op2_language(spark, SF_CHECK).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r["held_out"]]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_lang_is_no_input_of_a_prediction(spark):
    docs = table(spark, SF_CHECK, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    pred = langid.predicted(model, F.col("text"))
    a = docs.select("doc_id", pred.alias("p")).orderBy("doc_id").collect()
    b = docs.withColumn("lang", F.lit("xx")).select("doc_id", pred.alias("p")).orderBy("doc_id").collect()
    assert a == b
    assert sorted(model.members) == ["germanic", "romance"]
    assert {(x, y) for x, y, *_ in model.pairs} == {("de", "en"), ("es", "fr")}


def test_edge_rows(make, edge_rows):
    docs = make(edge_rows)
    got = langid.identify(docs, docs)
    assert got.drop("_ll_pred").columns == docs.columns
    rows = langid.digest(got).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r["doc_id"] in (2, 3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de", "fr", "es")
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_nothing_to_learn_from(make, edge_rows):
    docs = make(edge_rows)
    assert {r["lang_pred"] for r in langid.digest(langid.identify(docs, docs.limit(0))).collect()} == {"und"}
    one = make([(1, "ein Text", "de", "s"), (2, None, "de", "s")])
    got = {r["doc_id"]: r for r in langid.digest(langid.identify(one, one)).collect()}
    assert got[1]["lang_pred"] == "de" and got[2]["lang_pred"] == "und"
    assert langid.digest(langid.identify(make([]), make([]))).count() == 0


def test_foreign_letters_lower_the_score(make):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(
        [("the cat sat on the mat and the dog ran", "en"), ("die Katze saß auf der Matte und der Hund", "de"),
         ("le chat est sur le tapis avec le chien", "fr"), ("el gato y el perro en la casa", "es")] * 20)]
    model = langid.fit(make(rows))
    assert model.predict("the dog and the cat")[0] == "en"
    assert model.predict("кошка и собака")[1] < 0.05
    assert model.predict("12345 !?")[0] == "und"
