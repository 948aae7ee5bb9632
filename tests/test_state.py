"""The stateful stream against the batch fold, and what its state holds."""

import json
import random
from datetime import datetime, timedelta

import pytest

from sentrel.operators.thresholds import AGGREGATIONS, fired
from sentrel.scratch import settings
from sentrel.streaming.thresholds import ROCKSDB, fired_stream

SCHEMA = "event_uid string, created timestamp, rule_key string, agg_fn string, agg_field boolean, agg_by boolean, agg_raw string, group_value string, op string, threshold long, timeframe_sec long, payload string"


def some_rows(n, seed=3, frame=15, span=120):
    rnd, out = random.Random(seed), []
    for fn in AGGREGATIONS:
        for op, threshold in ((">", 3), ("<=", 1), ("=", 4)):
            at = sorted(rnd.uniform(0, span) for _ in range(n))
            out += [(f"{fn}{op}{i}", datetime(2024, 1, 1) + timedelta(milliseconds=int(t * 1000)), f"{fn} {op}", fn, fn != "count", True, rnd.choice([None, "x", "1", "2", "-3", "7"]), rnd.choice("ab"), op, threshold, frame, json.dumps({"i": i})) for i, t in enumerate(at)]
    return sorted(out, key=lambda r: r[1])


def streamed(spark, tmp_path, parts, **how):
    """The rows that fire over micro-batches, and each batch's number of state rows and dropped rows."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        with settings(spark, ROCKSDB):
            source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            q = fired_stream(source, **how).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None
        last = q.lastProgress["stateOperators"][0]
        dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((r["event_uid"], r["rule_key"], r["agg_value"], r["payload"]) for r in got), last["numRowsTotal"], dropped


def batch(spark, rows, reopen):
    return sorted(map(tuple, fired(spark.createDataFrame(rows, SCHEMA), reopen, ("payload",)).select("event_uid", "rule_key", "agg_value", "payload").collect()))


@pytest.mark.parametrize("cuts, reopen", [((1,), False), ((0.2, 0.5, 1), False), ((0.3, 0.31, 1), True)])
def test_stream_equals_batch(spark, tmp_path, cuts, reopen):
    rows, ends = some_rows(40), [0]
    ends += [int(c * len(rows)) for c in cuts]
    got, *_ = streamed(spark, tmp_path, [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)], reopen_on_expiry=reopen)
    assert got == batch(spark, rows, reopen) and len(got) > 50


def test_state_goes_with_the_timeframe(spark, tmp_path):
    """By event time nothing is left once the watermark has passed; results are the batch's, and what is older than the watermark is dropped."""
    rows = some_rows(30)
    end = (("end", datetime(2024, 1, 2), "z", "count", False, True, None, "z", ">", 5, 15, "{}"),)
    after = (("late", datetime(2024, 1, 1), "z", "count", False, True, None, "late", ">", 5, 15, "{}"), ("end2", datetime(2024, 1, 3), "z", "count", False, True, None, "y", ">", 5, 15, "{}"))
    got, left, dropped = streamed(spark, tmp_path, [rows[:200], rows[200:], end, after], reopen_on_expiry=True, event_time=True)
    assert got == batch(spark, rows, True) and dropped == 1
    assert left <= 2  # the last event's own state and its timer


def test_without_reopening_only_the_first_time_stays(spark, tmp_path):
    rows = [r for r in some_rows(30) if r[3] == "uniquecount"]
    end = [("end", datetime(2024, 1, 2), "z", "count", False, True, None, "z", ">", 5, 15, "{}")]
    got, left, _ = streamed(spark, tmp_path / "a", [rows, end], event_time=True)
    assert got == batch(spark, rows, False)
    _, forgotten, _ = streamed(spark, tmp_path / "b", [rows, end], event_time=True, forget_after_seconds=60)
    assert forgotten <= 2 < left <= 2 + 6


def test_unique_values_are_entries(spark, tmp_path):
    """Many values of one key over several batches: the state has an entry for each, and one number."""
    start, n = datetime(2024, 1, 1), 600
    rows = [(f"e{i:05d}", start + timedelta(milliseconds=i), "r", "uniquecount", True, True, f"v{i // 2}", "g", ">", 299, 3600, "{}") for i in range(n)]
    got, left, _ = streamed(spark, tmp_path, [rows[:250], rows[250:500]])
    assert got == [] and left == 250 + 1


def test_custom_aggregations(spark, tmp_path, monkeypatch):
    from sentrel.operators import thresholds

    monkeypatch.setitem(AGGREGATIONS, "last", thresholds.Aggregation(lambda x: {"last": x}, lambda acc, x: {"last": x}, lambda acc: acc["last"] or 0))
    rows = [(f"e{i}", datetime(2024, 1, 1) + timedelta(seconds=i), "r", "last", True, True, str(v), "g", ">", 5, 60, "{}") for i, v in enumerate([1, 2, 9, 1, 3, 7])]
    want = [("e2", "r", 9, "{}"), ("e5", "r", 7, "{}")]
    assert batch(spark, rows, False) == want and streamed(spark, tmp_path, [rows[:2], rows[2:]])[0] == want
