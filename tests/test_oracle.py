"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

from ledgerlake.plans import catalog
from tests.conftest import SF_SMALL


def test_registered_queries_match_oracle(spark):
    from ledgerlake.plans.oracle import check
    failures = [(n, m) for n, status, _, _, m in check(spark, SF_SMALL, list(catalog.queries())) if status == "fail"]
    assert not failures, failures


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert "active_accounts" in df.columns


def test_registered_queries_match_under_other_session_settings(spark):
    """Same oracles with a non-UTC zone, ANSI off, AQE off, 200 partitions."""
    from ledgerlake.plans.oracle import check
    settings = {"spark.sql.session.timeZone": "America/Los_Angeles", "spark.sql.ansi.enabled": "false",
                "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "200"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        failures = [(n, m) for n, status, _, _, m in check(spark, SF_SMALL, list(catalog.queries())) if status == "fail"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert not failures, failures


def test_pandas_conversions_agree(spark):
    """Spark ``toPandas`` and DuckDB ``fetchdf`` give the same stringified
    rows for every registered query (nulls compared as missing)."""
    import math
    import __spark_entry__ as e
    from ledgerlake.plans.oracle import duck
    con = duck(SF_SMALL)
    ors = e.oracle_sql()

    def key(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        return str(v)
    bad = []
    for name, fn in catalog.queries().items():
        a = fn(spark, SF_SMALL).toPandas()
        b = con.execute(ors[name]).fetchdf()
        cols = sorted(a.columns)
        ra = sorted(tuple(key(x) for x in r) for r in a[cols].itertuples(index=False))
        rb = sorted(tuple(key(x) for x in r) for r in b[cols].itertuples(index=False))
        if ra != rb:
            bad.append(name)
    assert not bad, bad


def test_entry_without_the_training_data_operators(spark):
    """The entry module works where ``ledgerlake/llm`` and the pipeline are
    not installed, and only then leaves their queries out."""
    import subprocess
    import sys
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("ledgerlake.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "network_metrics" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
