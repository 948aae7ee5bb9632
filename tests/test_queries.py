from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sentrel.driver_queries import ORACLES, QUERIES
from sentrel.scratch import settings

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    """Rows with columns by name; numbers and texts compare as text, doubles rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(spark, duck, name, query, sql):
    df, want = query(spark, SF), duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns), name
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall()), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    same(spark, duck, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_in_another_zone(spark, duck, name):
    with settings(spark, {"spark.sql.session.timeZone": "Europe/Berlin"}):
        same(spark, duck, name, QUERIES[name], ORACLES[name])


def test_every_customer_is_looked_up(spark, tmp_path):
    """More customers than 600, so that a lookup table that is cut by id loses hits."""
    for name in ("events", "customer"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "customer":
            df = df.unionByName(df.withColumn("c_custkey", df.c_custkey + 3000))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    customers = {r["c_custkey"]: r for r in spark.read.parquet(f"{tmp_path}/customer.parquet").collect()}
    values = {}
    for k in customers:
        value = f"host{k % 20}.example" if k % 3 == 2 else f"{'203.0.113.' if k % 2 == 0 else '172.16.0.'}{k % 250}"
        values.setdefault((("tor", "c2", "c2d")[k % 3], value), []).append(k)
    want, matched = {}, []
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        u = r["user_id"]
        src = f"{('203.0.113.', '172.16.0.', '198.51.100.')[u % 3]}{u % 250}"
        asked = [("c2", src), ("c2d", f"host{u % 20}.example")] + ([("tor", src)] if not src.startswith("172.16.") else [])
        found = [k for a in asked for k in values.get(a, ())]
        want[r["event_id"]] = ",".join(sorted(map(str, found))) or None
        if r["event_type"] == "error" and any(customers[k]["c_mktsegment"] == "BUILDING" for k in found):
            matched.append(r["event_id"])
    assert {r["event_id"]: r["intel_event_id"] for r in QUERIES["enrich_intel"](spark, str(tmp_path)).collect()} == want
    assert sorted(r["event_id"] for r in QUERIES["enriched_then_match"](spark, str(tmp_path)).collect()) == sorted(matched)


def test_lists_that_many_events_share_are_stored_once_a_file(spark, tmp_path):
    """60 lists of some 110 KB for 3,000 events: 330 MB as rows, 6.6 MB if no file keeps more of them than a Parquet dictionary does."""
    days = F.timestamp_seconds(F.col("id") * 60)
    events = spark.range(3000).select(F.col("id").alias("event_id"), days.alias("ts"), (F.col("id") % 60).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(900_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    QUERIES["enrich_intel"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 8e6
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    brief = "SELECT event_id, md5(intel_event_id) AS ids, intel_attribute_category AS c, intel_attribute_tags AS t FROM"
    want = con.sql(f"{brief} ({ORACLES['enrich_intel'].replace('FROM events)', 'FROM events WHERE event_id < 60)')})").fetchall()
    got = con.sql(f"{brief} '{tmp_path}/out/*.parquet'").fetchall()
    known = {r[0]: r[1:] for r in want}
    assert len(known) == 60 and len(got) == 3000 and {r[0]: r[1:] for r in got} == {i: known[i % 60] for i in range(3000)}


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 13
