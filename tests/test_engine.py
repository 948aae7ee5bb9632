import json
import random
import shutil
import uuid
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentrel.operators import enrich
from sentrel.operators.events import parse_events, quarantine, struct_resolver, variant_resolver
from sentrel.operators.matching import match_rules
from sentrel.operators import thresholds
from sentrel.operators.thresholds import AGGREGATIONS, advance, fired
from sentrel.plans.rules import RuleSet, compile_rule
from sentrel.sources.config import load_config
from sentrel.sources.readers import event_source, kafka_options
from sentrel.sources.sinks import append_events, read_alerts, to_format
from sentrel.streaming.pipeline import run, run_batch, start_alerting, start_matching

EVENTS = [
    {"n": 0, "event": {"code": "4625"}, "process": {"executable": "C:\\Windows\\x.exe", "args": ["x", "-a"]}, "logsource": {"category": "process_creation", "product": "windows", "service": "s"}},
    {"n": 1, "event": {"code": 4625}, "user": {"name": None}, "logsource": {"product": "windows"}},
    {"n": 2, "event": {"code": "1"}, "user": {"name": ""}, "message": "first line\nsecond 'quoted' line", "logsource": {"category": "process_creation"}},
    {"n": 3, "user": {"name": "Bob"}, "ok": True, "logsource": {}},
    {"n": 4, "user": {"name": {"first": "x"}}, "message": "x*y"},
]


def rule(detection, **more):
    return {"id": "r", "detection": detection} | more


def hits(spark, detection, case_insensitive=False, **more):
    raw = spark.createDataFrame([(json.dumps(e),) for e in EVENTS] + [("{broken",), ("[1]",), (None,)], "value string")
    events = parse_events(raw).where("v is not null")
    found = match_rules(events, compile_rule(rule(detection, **more), case_insensitive=case_insensitive), variant_resolver())
    return sorted(json.loads(r["raw"])["n"] for r in found.select("raw").collect())


@pytest.mark.parametrize(
    "selection, want",
    [
        ({"event.code": 4625}, [0, 1]),
        ({"event.code": "4625"}, [0, 1]),
        ({"event.code": 4625.7}, [0, 1]),
        ({"ok": True}, [3]),
        ({"user.name": None}, [0, 1]),
        ({"user.name": ""}, [2]),
        ({"user.name": "*"}, [2, 3]),
        ({"process.args": "*x*"}, []),
        ({"process.executable|endswith": "\\x.exe"}, [0]),
        ({"process.executable": "C:\\Win*\\x.exe"}, [0]),
        ({"message|contains": "line\nsecond"}, [2]),
        ({"message": ["'quoted'", "zzz"]}, [2]),
        ({"user.name": "bob"}, []),
        ({"absent.path": "x"}, []),
    ],
)
def test_leaves_on_json(spark, selection, want):
    assert hits(spark, {"s": selection, "condition": "s"}) == want
    assert hits(spark, {"s": selection, "condition": "not s"}) == [n for n in range(5) if n not in want]


def test_case_insensitive(spark):
    assert hits(spark, {"s": {"user.name": "bOb"}, "condition": "s"}, case_insensitive=True) == [3]


def test_log_sources(spark):
    s = {"s": {"absent": None}, "condition": "s"}
    assert hits(spark, s, logsource={"category": "process_creation", "product": "Windows"}) == [0]
    assert hits(spark, s, logsource={"product": "windows"}) == [0, 1]
    assert hits(spark, s, logsource={"category": "process_creation", "service": "other"}) == [0, 2]
    assert hits(spark, s) == [0, 1, 2, 3, 4]


def test_quarantine_and_empty(spark):
    raw = spark.createDataFrame([("{broken",), ("[1]",), (None,), ('{"a":1}',)], "value string")
    assert sorted(str(r["raw"]) for r in quarantine(parse_events(raw)).collect()) == ["None", "[1]", "{broken"]
    assert match_rules(parse_events(raw), [], variant_resolver()).count() == 0
    assert run_batch(raw.limit(0), compile_rule(rule({"s": {"a": 1}, "condition": "s"}))).count() == 0


def test_struct_resolver(spark):
    df = spark.range(3).select(F.struct(F.struct(F.col("id").alias("b")).alias("a")).alias("e"), F.col("id").alias("event_uid"), F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("product")).alias("logsource"))
    got = match_rules(df, compile_rule(rule({"s": {"a.b": 2}, "condition": "s"})), struct_resolver("e"))
    assert [r["event_uid"] for r in got.collect()] == [2]


def plain_machine(rows, fn, op, threshold, frame):
    """rows of one key, in order: (seconds, raw). Numbers of those that fire."""
    out, t0, seen = [], None, []
    for i, (sec, raw) in enumerate(rows):
        x = int(raw) if raw is not None and raw.lstrip("-").isdigit() else None
        use = x if fn in ("sum", "min", "max", "avg") else raw
        if t0 is None:
            if fn == "count" or use is not None:
                t0, seen = sec, [use]
            continue
        if sec - t0 >= frame:
            t0 = None
            continue
        if use is not None or fn == "count":
            seen.append(use)
        value = {"count": len, "uniquecount": lambda s: len(set(s)), "sum": sum, "min": min, "max": max, "avg": lambda s: abs(sum(s)) // len(s) * (1 if sum(s) >= 0 else -1)}[fn](seen)
        if {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold, "=": value == threshold}[op]:
            out.append(i)
            t0 = None
    return out


@pytest.mark.parametrize("fn", ["count", "uniquecount", "sum", "min", "max", "avg"])
def test_fold_against_plain_machine(fn):
    rnd = random.Random(fn)
    for _ in range(300):
        sec, rows = 0, []
        for _ in range(rnd.randint(0, 25)):
            sec += rnd.choice([0, 1, 2, 5, 9])
            rows.append((sec, rnd.choice([None, "x", "1", "2", "-3", "7"])))
        op, threshold, frame = rnd.choice(["<", "<=", ">", ">=", "="]), rnd.randint(-2, 6), rnd.randint(1, 20)
        state, got = None, []
        for i, (s, raw) in enumerate(rows):
            state, value = advance(state, s * 1000, raw, fn, op, threshold, frame)
            if value is not None:
                got.append(i)
        assert got == plain_machine(rows, fn, op, threshold, frame)


def logs(n, seed=1):
    rnd, at, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=rnd.randint(0, 40))
        out.append({"n": i, "event": {"created": at.strftime("%Y-%m-%dT%H:%M:%S.000Z"), "code": rnd.choice(["1", "2"])}, "user": {"name": rnd.choice(["a", "b", None])}, "bytes": rnd.choice([1, 5, "x"]), "logsource": {"product": "linux"}})
    return out


RULES = """
id: counted
status: test
fields: [user.name]
logsource: {product: linux}
detection:
  s: {event.code: 1}
  condition: [s | count() by user.name > 2, s | sum(bytes) > 9, s]
  timeframe: 10m
---
id: plain
logsource: {product: linux}
detection:
  s: {event.code: 2}
  condition: s
"""


def test_batch_equals_stream_in_any_batches(spark, tmp_path):
    (tmp_path / "rules").mkdir(), (tmp_path / "in").mkdir()
    (tmp_path / "rules/r.yml").write_text(RULES)
    rules = RuleSet(str(tmp_path / "rules"))
    rules.refresh()
    lines = [json.dumps(e) for e in logs(120)]
    want = {r["alert_uid"] for r in run_batch(spark.createDataFrame([(x,) for x in lines], "value string"), rules.compiled()).collect()}
    assert len(want) > 60
    live = RuleSet(str(tmp_path / "rules"))
    for k in range(3):
        (tmp_path / f"in/{k}.json").write_text("\n".join(lines[k * 40 : k * 40 + 40]) + "\n")
        for step in (lambda: [start_matching(event_source(spark, "text", str(tmp_path / "in"), streaming=True), live, str(tmp_path / "m"), str(tmp_path / "c1"))], lambda: start_alerting(spark, str(tmp_path / "m"), str(tmp_path / "alerts"), str(tmp_path / "c2"))):
            for q in step():
                assert q.awaitTermination(300)
                assert q.exception() is None
    got = {r["alert_uid"] for kind in ("plain", "fired") for r in read_alerts(spark, f"{tmp_path}/alerts/{kind}/batch=*").collect()}
    assert got == want


def test_alert_fields(spark):
    raw = spark.createDataFrame([(json.dumps(e),) for e in logs(5)], "value string")
    a = run_batch(raw, compile_rule(rule({"s": {"event.code": "*"}, "condition": "s"}, fields=["user.name", "bytes"], tags=["t", "t"], status="stable"))).collect()
    assert len(a) == 5 and all(r["rule_status"] == "stable" and r["tags"] == ["t"] for r in a)
    for r in a:
        e = json.loads(r["rule_event"])
        assert r["fields"] == {k: str(v) for k, v in (("user.name", e["user"]["name"]), ("bytes", e["bytes"])) if v is not None}


def test_public_ip(spark):
    public = ["8.8.8.8", "172.32.0.1", "2001:db8::1", "192.169.1.1"]
    other = ["10.1.2.3", "172.16.0.1", "192.168.3.4", "127.0.0.1", "169.254.1.1", "224.0.0.1", "::1", "fe80::1", "ff02::1", "host", "1.2.3", "1.2.3.400", "", None]
    rows = spark.createDataFrame([(x,) for x in public + other], "ip string").select("ip", enrich.is_public_ip(F.col("ip")).alias("p")).collect()
    assert [r["ip"] for r in rows if r["p"]] == public and all(r["p"] is not None for r in rows)


def test_read_through_cache(spark, tmp_path):
    """Every request that the cache lacks is asked once, however often the results are read; two types of one value are two requests."""
    asked = spark.createDataFrame([("e1", "a", "t", "ip"), ("e2", "a", "t", "ip"), ("e1", "b", "t", "ip"), ("e3", "c", "t", "ip"), ("e3", "a", "t", "host")], "event_uid string, value string, tag string, attr_type string")
    cache = spark.createDataFrame([("a", "t", "ip", "kept", datetime(2030, 1, 1)), ("a", "t", "ip", "older", datetime(2029, 1, 1)), ("b", "t", "ip", "old", datetime(2020, 1, 1)), ("z", "t", "ip", "other", datetime(2030, 1, 1))], enrich.CACHE)
    log = tmp_path / "asked"
    log.mkdir()

    def provider(rows):
        for v, _, k in rows:
            (log / f"{v}-{k}-{uuid.uuid4().hex}").touch()
        return [(v, t, k, f"asked {v} {k}" if v != "c" else "") for v, t, k in rows]

    answers, new = enrich.read_through(asked, cache, provider, F.lit(datetime(2025, 1, 1)))
    for _ in range(2):
        assert sorted(map(tuple, answers.collect())) == [("a", "t", "host", "asked a host"), ("a", "t", "ip", "kept"), ("b", "t", "ip", "asked b ip"), ("c", "t", "ip", "")]
        assert sorted((r["value"], r["expires_at"]) for r in new.collect()) == [(v, datetime(2025, 1, 2)) for v in "abc"]
    assert sorted(f.name.rpartition("-")[0] for f in log.iterdir()) == ["a-host", "b-ip", "c-ip"]


@pytest.mark.parametrize("broadcast_rows", [enrich.BROADCAST_ROWS, 1])
def test_intel_lookup_against_brute_force(spark, broadcast_rows):
    """Lists made per value, by broadcast and by shuffle, are those of a walk over all pairs."""
    rnd = random.Random(3)
    some = lambda xs: rnd.choice([*xs, None])
    asked = sorted({(f"e{rnd.randint(0, 30)}", rnd.choice("st"), "ip", rnd.choice("abcd")) for _ in range(80)})
    intel = [(rnd.choice("st"), "ip", some("abcx"), some(["7", "10", "7"]), some("pq"), some([["n", "t"], ["t"], []])) for _ in range(60)]
    want = {}
    for e, tag, kind, value in asked:
        for row in intel:
            if row[:3] == (tag, kind, value):
                ids, cats, tags = want.setdefault(e, ([], set(), set()))
                ids += [row[3]] if row[3] else []
                cats |= {row[4]} if row[4] else set()
                tags |= set(row[5] or [])
    a = spark.createDataFrame(asked, "event_uid string, tag string, attr_type string, value string")
    i = spark.createDataFrame(intel, "tag string, attr_type string, value string, event_id string, category string, attr_tags array<string>")
    got = enrich.lookup_intel(a, i, broadcast_rows)
    assert sorted(map(tuple, got.collect())) == sorted((e, *(sorted(x) or None for x in lists)) for e, lists in want.items())


def test_a_text_is_parsed_once(spark):
    """Neither the filter of the rules nor that of events repeats the parse or the fields' extraction."""
    rules = [c for i in range(4) for c in compile_rule({"id": f"r{i}", "detection": {"s": {"a.b": [i, "x*", None]}, "condition": "not s"}})]
    found = match_rules(parse_events(spark.createDataFrame([(' {"a": {"b": 1}}',), ("[{}]",), ("{}",)], "value string")).where("v is not null"), rules, variant_resolver())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1
    assert sorted((r["raw"], r["ruleid"]) for r in found.select("raw", "ruleid").collect()) == [(' {"a": {"b": 1}}', f"r{i}") for i in (0, 2, 3)]


def test_lists_of_hits_are_made_per_combination(spark):
    """Events of one combination of values share its lists: what is moved grows with the combinations, not with events times hits."""
    events = spark.createDataFrame([(i, f"10.0.0.{i % 3}", None if i % 2 else "h") for i in range(600)], "event_uid long, ip string, name string")
    mapping = {"ip": {"t": [{"mispAttribute": "ip-src", "type": "ip", "enrichPublicOnly": False}]}, "name": {"d": [{"mispAttribute": "domain", "type": "domain", "resolveName": True}]}}
    intel = spark.createDataFrame([("t", "ip-src", "10.0.0.1", str(i), "c", ["x"]) for i in range(40)] + [("d", "domain", "h", "z", "b", None)], "tag string, attr_type string, value string, event_id string, category string, attr_tags array<string>")
    asked = []
    got = enrich.enrich_values(events, enrich.attributes_frame(spark, mapping), list(mapping), struct_resolver(), lambda a: asked.append(a) or intel)
    assert asked[0].count() == 9 and got.columns == [*events.columns, "intel_event_id", "intel_attribute_category", "intel_attribute_tags"]
    rows = {r["event_uid"]: r for r in got.collect()}
    plain = enrich.enrich(events, enrich.requests(events, enrich.attributes_frame(spark, mapping), list(mapping), struct_resolver()), intel)
    assert len(rows) == 600 and {r["event_uid"]: r for r in plain.collect()} == rows
    assert "BroadcastHashJoin [asked_values" not in got._jdf.queryExecution().toString()


def test_partitions_end_by_their_texts_or_rows():
    cells = [(5, 400, 10, 4000), (1, 400, 10, 4000), (2, 400, 10, 4000), (3, 400, 95, 38000), (4, 400, 250, 100000), (6, 5000, 1, 5000), (7, 5000, 1, 5000), (8, 300, 30, 3000), (9, 300, 30, 9000)]
    assert enrich.deal(cells, 1000, 12000, 100) == ([(1, 0, 1), (2, 0, 1), (3, 1, 1), (4, 2, 3), (5, 5, 1), (6, 5, 1), (7, 6, 1), (8, 6, 1), (9, 7, 1)], 8)
    assert enrich.deal([], 1000, 12000, 100) == ([], 0)


@pytest.mark.parametrize("bounds", [(1_000_000, 64_000_000, 500_000), (1, 1, 500_000), (1_000_000, 64_000_000, 30)])
def test_texts_of_lists_meet_their_events_in_any_partition(spark, monkeypatch, bounds):
    """One combination has half of all events; by the last bounds it is dealt over several partitions. Nulls are a combination too."""
    for name, x in zip(("TEXT_BYTES", "ROW_BYTES", "ROWS"), bounds, strict=True):
        monkeypatch.setattr(enrich, name, x)
    events = spark.createDataFrame([(f"e{i}", f"10.0.0.{max(0, i - 400) % 5}", None if i % 2 else "h", i) for i in range(0, 800, 2)] + [(f"n{i}", None, None, i) for i in range(80)], "event_uid string, ip string, name string, cell int")
    mapping = {"ip": {"t": [{"mispAttribute": "ip-src", "type": "ip", "enrichPublicOnly": False}]}, "name": {"d": [{"mispAttribute": "domain", "type": "domain", "resolveName": True}]}}
    intel = spark.createDataFrame([("t", "ip-src", f"10.0.0.{i % 3}", str(i), "c", ["x"]) for i in range(40)], "tag string, attr_type string, value string, event_id string, category string, attr_tags array<string>")
    attributes, join = enrich.attributes_frame(spark, mapping), lambda c: F.array_join(c, ",")
    got = enrich.enrich_values(events, attributes, list(mapping), struct_resolver(), intel, text=join)
    plain = enrich.enrich(events, enrich.requests(events, attributes, list(mapping), struct_resolver()), intel)
    names = ["intel_event_id", "intel_attribute_category", "intel_attribute_tags"]
    assert got.columns == [*events.columns, *names]
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.select(*events.columns, *[join(F.col(c)).alias(c) for c in names]).collect()))
    held = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 480 and max(held) <= bounds[2] + 30 * (bounds[2] == 30) and (bounds[0] > 1 or len(held) > 4)


def test_config_and_sources(spark, tmp_path):
    (tmp_path / "c.properties").write_text("# c\ntopics = a, b\nstart=1700000000000\ntls.security.protocol=SSL\ntls.truststore.location=/t\nflush_rows=5\nenrichment=true\n")
    c = load_config(str(tmp_path / "c.properties"))
    assert c.flush_rows == 5 and c.enrichment
    assert kafka_options(c) == {"kafka.bootstrap.servers": "localhost:9092", "subscribe": "a,b", "startingTimestamp": "1700000000000", "kafka.security.protocol": "SSL", "kafka.ssl.truststore.location": "/t"}
    (tmp_path / "d.properties").write_text("nope=1\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "d.properties"))
    (tmp_path / "e.properties").write_text("topic_pattern=x.*\nsink=jdbc\nsink.url=u\nsink.queryTimeout=5\nmax_files=3\n")
    e = load_config(str(tmp_path / "e.properties"))
    assert (e.sink, e.sink_options, e.max_files) == ("jdbc", {"url": "u", "queryTimeout": "5"}, 3)
    assert kafka_options(e) == {"kafka.bootstrap.servers": "localhost:9092", "subscribePattern": "x.*", "startingOffsets": "latest"} and kafka_options(e, streaming=False)["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        kafka_options(replace(e, start="latest"), streaming=False)
    for _ in range(2):  # a batch that is tried again is written once
        append_events(str(tmp_path / "events"), flush_rows=2)(spark.range(3).coalesce(1), 0)
    append_events(str(tmp_path / "events"))(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "events")).count() == 5 and len(list((tmp_path / "events/batch=0").glob("index=*/*.parquet"))) == 2
    to_format("json", {"path": str(tmp_path / "j"), "compression": "none"}, "x-")(spark.range(3), 0)
    assert spark.read.json(str(tmp_path / "j")).select("index").distinct().count() == 1


def machine_rows(spark, rows, fn, op, threshold, frame):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(seconds=sec), k, raw) for i, (k, sec, raw) in enumerate(rows)], "event_uid long, created timestamp, group_value string, agg_raw string")
    lit = lambda v, t: F.lit(v).cast(t)
    return df.withColumns({"rule_key": F.lit("r#0"), "agg_fn": F.lit(fn), "agg_field": lit(fn != "count", "boolean"), "agg_by": lit(True, "boolean"), "op": F.lit(op), "threshold": lit(threshold, "long"), "timeframe_sec": lit(frame, "long")})


@pytest.mark.parametrize("fn, op, threshold, frame", [("count", ">", 9, 100), ("count", ">", 10**6, 10**6), ("sum", ">", 30, 40), ("uniquecount", ">=", 3, 25), ("max", "=", 7, 10)])
def test_hot_keys_in_parts(spark, fn, op, threshold, frame):
    """A key with most rows is folded in parts that don't start with a key, with the result of one pass; also where no part forgets its entry state."""
    rnd = random.Random(fn)
    rows = sorted(((rnd.choice(["hot"] * 8 + ["a", "b", "warm", "warm"]), rnd.randint(0, 3000), rnd.choice([None, "1", "2", "7", "x"])) for _ in range(1500)), key=lambda r: r[1])
    want = []
    for k in {r[0] for r in rows}:
        own = [(i, r) for i, r in enumerate(rows) if r[0] == k]
        want += [own[j][0] for j in plain_machine([(s, raw) for _, (_, s, raw) in own], fn, op, threshold, frame)]
    assert sorted(r["event_uid"] for r in fired(machine_rows(spark, rows, fn, op, threshold, frame)).collect()) == sorted(want)


@pytest.mark.parametrize("fn, op, threshold", [("count", ">", 10**6), ("sum", ">", 10**6), ("sum", "<", -(10**6)), ("max", ">=", 8), ("min", "=", 5), ("uniquecount", ">", 10)])
def test_a_quiet_hot_key_takes_one_pass(spark, monkeypatch, fn, op, threshold):
    """However many parts it has: their summaries are put together."""
    monkeypatch.setattr(thresholds, "ARRAY_ROWS", 10)
    folds, write = [], thresholds.Scratch.write
    monkeypatch.setattr(thresholds.Scratch, "write", lambda self, df, name: folds.append(name) or write(self, df, name))
    rnd = random.Random(fn)
    rows = [("hot", i, rnd.choice(["1", "2", "-3", "7", None])) for i in range(600)] + [("b", i, "9") for i in range(20)]
    df = machine_rows(spark, rows, fn, op, threshold, 10**6)
    assert thresholds._fired_in_parts(thresholds.Scratch(spark), thresholds.keyed(df).withColumn("row", F.monotonically_increasing_id()).select(*thresholds._NARROW), 9, False).count() == (10 if fn == "max" else 0)
    assert folds.count("folded") == 1


@pytest.mark.parametrize("fn, op, threshold, reopen", [("count", ">", 20, False), ("count", ">", 6, True), ("uniquecount", ">=", 10, False)])
def test_a_dense_hot_key_takes_two_passes(spark, monkeypatch, fn, op, threshold, reopen):
    """Its parts never forget their entry state: where alerts come every few events, each fold has its own phase to the end."""
    folds, write = [], thresholds.Scratch.write
    monkeypatch.setattr(thresholds.Scratch, "write", lambda self, df, name: folds.append(name) or write(self, df, name))
    rows = [("hot", i // 4, str(i)) for i in range(2000)]
    want = [i for i in plain_machine([(sec, raw) for _, sec, raw in rows], fn, op, threshold, 10**5)]
    df = machine_rows(spark, rows, fn, op, threshold, 10**5)
    narrow = thresholds.keyed(df).withColumn("row", F.monotonically_increasing_id()).select(*thresholds._NARROW)
    got = thresholds._fired_in_parts(thresholds.Scratch(spark), narrow, 9, reopen).join(narrow.select("row", "event_uid"), "row")
    assert sorted(r["event_uid"] for r in got.collect()) == want and folds.count("folded") == 2


@pytest.mark.parametrize("seed", range(3))
def test_chains_against_the_fold(seed):
    """What the chains of a run say of the state after it is what folding it says."""
    rnd, used = random.Random(seed), 0
    for _ in range(3000):
        fn, op, threshold, frame, reopen = rnd.choice(("count", "sum", "min", "max", "uniquecount", "avg")), rnd.choice(list(thresholds.OPS)), rnd.randint(-5, 12), rnd.choice((5, 40)), rnd.random() < 0.5
        events = [(i * rnd.choice((1000, 100)), rnd.choice(["1", "2", "-3", "7", "x", None, str(2**63 - 1)])) for i in range(rnd.choice((3, 30, 300)))]
        events.sort(key=lambda e: e[0])
        state = rnd.choice([None, [0, {"count": rnd.randint(1, 4), "uniquecount": dict.fromkeys(rnd.sample("127x", 2), 1), "avg": [3, 2]}.get(fn, rnd.randint(-4, 9))]])
        c = thresholds.Chains((fn, op, threshold, frame), reopen)
        for ms, raw in events:
            c.add(ms, raw, c.spec)
        after = thresholds.followed(c.text(), json.loads(json.dumps(state)), reopen)
        if after is not None:
            used += 1
            for ms, raw in events:
                state, _ = advance(state, ms, raw, fn, op, threshold, frame, reopen)
            assert json.loads(json.dumps(state)) == after[0]
    assert used > 1000


@pytest.mark.parametrize("seed", range(3))
def test_summaries_against_the_fold(seed):
    """What a summary says of a run is what folding it says."""
    rnd, used = random.Random(seed), 0
    for _ in range(3000):
        fn, op, threshold, frame = rnd.choice(("count", "sum", "min", "max", "uniquecount", "avg")), rnd.choice(list(thresholds.OPS)), rnd.randint(-5, 12), rnd.choice((5, 40))
        events = [(i * 1000, rnd.choice(["1", "2", "-3", "7", "x", None, str(2**63 - 1)])) for i in range(rnd.randint(1, 12))]
        state = [0, {"count": rnd.randint(1, 4), "uniquecount": dict.fromkeys(rnd.sample("127x", 2), 1), "avg": [3, 2]}.get(fn, rnd.randint(-4, 9))]
        s = thresholds.Summary((fn, op, threshold, frame))
        for ms, raw in events:
            s.add(ms, raw, s.spec)
        after = thresholds.composed(s.text(), json.loads(json.dumps(state)))
        if after is not None:
            used += 1
            for ms, raw in events:
                state, value = advance(state, ms, raw, fn, op, threshold, frame)
                assert value is None
            assert state == after
    assert used > 300


@pytest.mark.parametrize("array_rows, keys", [(2000, 100_000), (3, 100_000), (0, 0)])
@pytest.mark.parametrize("reopen", [False, True])
def test_folds_agree(spark, monkeypatch, array_rows, keys, reopen):
    """All functions and operators at once, over arrays, streamed, and mixed, against `advance`; repeated rows count each."""
    monkeypatch.setattr(thresholds, "ARRAY_ROWS", array_rows)
    monkeypatch.setattr(thresholds, "BROADCAST_KEYS", keys)
    rnd, frames, want = random.Random(5), [], []
    for fn in AGGREGATIONS:
        for op, threshold in ((">", 3), ("<=", 2), ("=", 4)):
            name = f"{fn} {op}"
            rows = [(rnd.choice("ab") + str(rnd.randint(0, 5)), rnd.randint(0, 60), rnd.choice([None, "x", "1", "2", "-3", "7", "+4", " 5", "99999999999999999999", str(2**63 - 1)])) for _ in range(60)]
            rows = sorted(rows + rows[:20], key=lambda r: r[1])
            for k in {r[0] for r in rows}:
                state = None
                for i, (own, sec, raw) in enumerate(rows):
                    if own == k:
                        state, value = advance(state, sec * 1000, raw, fn, op, threshold, 15, reopen)
                        want += [(i, name, value)] if value is not None else []
            frames.append(machine_rows(spark, rows, fn, op, threshold, 15).withColumns({"rule_key": F.lit(name), "extra": F.concat("group_value", F.col("created").cast("string"))}))
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    got = fired(every, reopen, ("extra",))
    assert got.columns == ["event_uid", "rule_key", "agg_value", "extra"]
    rows = got.collect()
    assert sorted((r["event_uid"], r["rule_key"], r["agg_value"]) for r in rows) == sorted(want) and all(r["extra"] for r in rows)


def test_equal_events(spark):
    """Four equal texts and `count() > 1`: the second and the fourth fire, and it is one alert by its id."""
    text = json.dumps(logs(1)[0] | {"event": {"created": "2024-01-01T00:00:00.000Z", "code": "1"}, "user": {"name": "a"}})
    r = compile_rule(rule({"s": {"event.code": 1}, "condition": "s | count() by user.name > 1", "timeframe": "1h"}, fields=["user.name"]))
    got = run_batch(spark.createDataFrame([(text,)] * 4, "value string"), r).collect()
    assert [(r["agg_value"], r["fields"], r["rule_event"]) for r in got] == [(2, {"user.name": "a"}, text)] * 2 and len({r["alert_uid"] for r in got}) == 1


def job_folders(tmp_path, lines, batches=3):
    (tmp_path / "rules").mkdir(), (tmp_path / "in").mkdir()
    (tmp_path / "rules/r.yml").write_text(RULES)
    (tmp_path / "map.json").write_text(json.dumps({"user.name": {"t": [{"mispAttribute": "user", "type": "domain", "resolveName": True}]}}))
    n = len(lines) // batches
    for k in range(batches):
        yield lambda k=k: (tmp_path / f"in/{k}.json").write_text("\n".join(lines[k * n : k * n + n]) + "\n")


def test_job_with_retried_batches(spark, tmp_path):
    """The job of a configuration, killed after a batch's matches, events and alerts were written but not committed: nothing counts twice."""
    lines = [json.dumps(e) for e in logs(90)] + ["{broken"] * 3
    paths = {k: str(tmp_path / k) for k in ("match_table", "event_table", "alert_table", "checkpoint", "cache_table")}
    config = load_config_text(tmp_path, {"source": "text", "source_path": str(tmp_path / "in"), "rules": str(tmp_path / "rules"), "enrichment": "true", "intel_map": str(tmp_path / "map.json"), **paths})
    asked = tmp_path / "asked"
    asked.mkdir()

    def provider(rows):
        for v, _, _ in rows:
            (asked / f"{v}-{uuid.uuid4().hex}").touch()
        return [(v, t, k, json.dumps([{"event_id": f"i{v}", "category": "c", "attr_tags": ["x"]}]) if v == "a" else "") for v, t, k in rows]

    def go():
        for q in run(spark, config, provider):
            assert q.awaitTermination(300)
            assert q.exception() is None

    for write in job_folders(tmp_path, lines):
        write()
        go()
        for commits in (tmp_path / "checkpoint").rglob("commits"):  # as if the job had died just before it noted the batch
            for f in [f for f in commits.iterdir() if f.name.strip(".").split(".")[0] == str(max(int(f.name) for f in commits.iterdir() if f.name.isdigit()))]:
                f.unlink()
        go()
    loaded = RuleSet(str(tmp_path / "rules"))
    loaded.refresh()
    want = sorted(r["alert_uid"] for r in run_batch(spark.createDataFrame([(x,) for x in lines], "value string"), loaded.compiled()).collect())
    got = sorted(r["alert_uid"] for kind in ("plain", "fired") for r in spark.read.parquet(f"{tmp_path}/alert_table/{kind}").collect())
    assert got == want and len(want) > 40
    events = spark.read.parquet(f"{tmp_path}/event_table").collect()
    names = [json.loads(x)["user"]["name"] for x in lines[:90]]
    assert sorted(r["raw"] for r in events) == sorted(lines[:90])
    assert sum(r["intel_event_id"] == ["ia"] for r in events) == names.count("a") > 0 and all(r["intel_event_id"] is None for r in events if json.loads(r["raw"])["user"]["name"] != "a")
    assert sorted(f.name.rpartition("-")[0] for f in asked.iterdir()) == ["a", "b"]


def load_config_text(tmp_path, values):
    (tmp_path / "job.properties").write_text("".join(f"{k}={v}\n" for k, v in values.items()))
    return load_config(str(tmp_path / "job.properties"))


def test_forgotten_keys(spark, tmp_path):
    """A bounded state forgets idle keys; without a bound the batch result is kept (see above)."""
    lines = [json.dumps(e) for e in logs(40)]
    for write in job_folders(tmp_path, lines, 2):
        write()
        rules = RuleSet(str(tmp_path / "rules"))
        start_matching(event_source(spark, "text", str(tmp_path / "in"), streaming=True), rules, str(tmp_path / "m"), str(tmp_path / "c1")).awaitTermination(300)
        for q in start_alerting(spark, str(tmp_path / "m"), str(tmp_path / "alerts"), str(tmp_path / "c2"), max_files=1, forget_after_seconds=86400):
            assert q.awaitTermination(300)
            assert q.exception() is None
    rules = RuleSet(str(tmp_path / "rules"))
    rules.refresh()
    want = {r["alert_uid"] for r in run_batch(spark.createDataFrame([(x,) for x in lines], "value string"), rules.compiled()).collect()}
    assert {r["alert_uid"] for kind in ("plain", "fired") for r in read_alerts(spark, f"{tmp_path}/alerts/{kind}").collect()} == want
    shutil.rmtree(tmp_path / "m")


def test_no_rows_to_fold(spark):
    assert fired(machine_rows(spark, [("a", 1, "1")], "count", ">", 1, 5).limit(0)).count() == 0
