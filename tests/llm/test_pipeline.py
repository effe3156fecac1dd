import corpus_pipeline as cp
from ledgerlake.llm import decontam
from ledgerlake.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_neardup import brute


def test_stages_on_their_own_inputs(spark, tmp):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF_SMALL)
        path = f"{tmp}/{name}"
        out.write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
        assert name == cp.STAGES[-1][0] or docs.columns == columns
    # language: texts with letters of the learned languages stay
    before, after = seen["language"]
    away = before.join(after, "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r["text"] or "") for r in away)
    # near-duplicates: one row of each component
    before, after = seen["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, _, c in brute(rows, 5, 80, 100)})
    # decontamination: exactly the documents with a hit go
    before, after = seen["decontamination"]
    hit = decontam.contamination(before, table(spark, SF_SMALL, "benchmark")).where("n_hit > 0")
    assert before.count() - after.count() == hit.count() > 0
    assert decontam.contamination(after, table(spark, SF_SMALL, "benchmark")).where("n_hit > 0").count() == 0
    # mixture and shards
    before, after = seen["mixture"]
    assert after.join(before, "doc_id", "left_anti").count() == 0
    assert seen["shards"][1].count() == after.count()


def test_run_and_empty_input(spark, make, tmp):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    docs = make([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0


def test_edge_rows_pass_every_stage(spark, make, edge_rows):
    docs = make(edge_rows).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        docs.count()
