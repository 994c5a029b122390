"""Every query with SQL gives the rows that DuckDB finds, on the smallest tables."""

import duckdb
import pytest

from waywright.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    rows = catalog.QUERIES[name](spark, DATA)
    names = sorted(rows.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in rows.collect())
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == sorted(repr(tuple(r[columns.index(c)] for c in names)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_traces_reach_every_branch(spark):
    """The made traces hold every outcome that the queries tell apart."""
    a = catalog.analysis(spark, "/root/testdata/sf0.01")
    assert {(r[0], r[1]) for r in a.runs.select("lifecycle", "validity").distinct().collect()} == {("completed", "valid"), ("completed", "unranked"), ("abandoned", "unranked"), ("armed", "pending"), ("active", "pending")}
    assert {r[0] for r in a.status.select("reason").distinct().collect()} == {None, "not_valid", "replay_incomplete", "missing_start_coverage"}
    assert {r[0] for r in a.matched.select("quality").distinct().collect()} == {"accepted", "off_course", "poor_accuracy"}
    assert {r[0] for r in a.comparison.select("reason").distinct().collect()} >= {None, "current_not_eligible", "missing_comparison_target"}
    assert {r[0] for r in a.intervals.select("label").distinct().collect()} == {"moving", "waiting", "unknown"}


def test_changed_tables_are_analysed_anew(spark, tmp_path):
    for t in ("events", "region"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    n = catalog.QUERIES["q_match"](spark, str(tmp_path)).count()
    spark.read.parquet(f"{DATA}/events.parquet").filter("event_id % 2 = 0").write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert 0 < catalog.QUERIES["q_match"](spark, str(tmp_path)).count() < n


def test_winding_traces_reach_what_straight_ones_can_t(spark):
    """No segment in the window, attempts without telemetry, equal times, and places that the path passes twice."""
    from waywright.sources import traces

    d = "/root/testdata/sf0.01"
    assert {r[0] for r in catalog.QUERIES["q_winding_match"](spark, d).select("quality").distinct().collect()} == {"accepted", "off_course", "out_of_window", "poor_accuracy"}
    assert {r[0] for r in catalog.QUERIES["q_winding_status"](spark, d).select("reason").distinct().collect()} >= {"missing_telemetry", "replay_incomplete"}
    s = traces.winding_samples(spark, d)
    assert s.groupBy("attempt_id", "recorded_at_ms").count().filter("count > 1").limit(1).count() == 1
