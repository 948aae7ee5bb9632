"""What the live job must not lose: addresses, lookups that fail, the cache, sinks under new checkpoints, lines that are no events."""

import ipaddress
import json
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sentrel.operators import enrich
from sentrel.operators.enrich import Limits, ask, look_up
from sentrel.operators.events import parse_events, rejected
from sentrel.plans.rules import RuleSet
from sentrel.sources.cache import BucketedCache
from sentrel.sources.config import Config, load_config
from sentrel.sources.readers import event_source, kafka_options
from sentrel.sources.sinks import read_alerts
from sentrel.streaming.pipeline import run, run_batch, start_alerting, start_matching


def spelled(rnd, a):
    """An address in one of the forms that it may be written in."""
    if a.version == 4:
        return str(a)
    forms = [a.compressed, a.exploded, a.compressed.upper()]
    groups = a.exploded.split(":")
    last = int(groups[6], 16), int(groups[7], 16)
    forms.append(":".join(g.lstrip("0") or "0" for g in groups[:6]) + ":" + ".".join(str(x) for n in last for x in (n >> 8, n & 255)))
    forms.append(a.compressed + "%eth0")
    return rnd.choice(forms)


def test_addresses_against_the_standard_library(spark):
    rnd = random.Random(1)
    texts = []
    for _ in range(5000):
        texts.append(spelled(rnd, ipaddress.IPv4Address(rnd.getrandbits(32))))
        n = rnd.getrandbits(128)
        for _ in range(rnd.randint(0, 3)):  # with runs of zeros
            at = rnd.randint(0, 7)
            n &= ~(((1 << 16 * rnd.randint(1, 8 - at)) - 1) << 16 * at)
        texts.append(spelled(rnd, ipaddress.IPv6Address(n)))
    bad = [":::::", "a:b", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.04", "::1::", "1::2::3", ":::", "::ffff:1.2.3", "::ffff:1.2.3.256", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "12345::", "g::", "::%", "::1%a%b", "1.2.3.4%eth0", "", " ", "::1 ", "1.2.3.4\n", "::1\n", "host", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7.8.9.10", "::1.2.3.4:5", "1.2.3.4::", "-1.2.3.4", "+1.2.3.4", "1..2.3", "..."]
    while len(bad) < 400:
        t = list(rnd.choice(texts))
        t[rnd.randrange(len(t))] = rnd.choice(":.%gf0 -")
        bad.append("".join(t))

    def want(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        raw = b"\0" * 10 + b"\xff\xff" + a.packed if a.version == 4 else a.packed
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, 16, 2)]

    assert sum(want(t) is None for t in bad) > 100
    got = spark.createDataFrame([(t,) for t in texts + bad], "ip string").select("ip", enrich.address(F.col("ip")).alias("a")).collect()
    assert [(r["ip"], r["a"]) for r in got if r["a"] != want(r["ip"])] == []


def test_public_addresses(spark):
    public = ["8.8.8.8", "172.32.0.1", "2001:db8::1", "192.169.1.1", "::ffff:8.8.8.8", "::2", "fc00::1"]
    other = ["::ffff:10.0.0.1", "::ffff:127.0.0.1", "0::1", ":::::", "a:b", "::FFFF:c0a8:0001", "fe80::1%eth0", "febf::1", "fec0::1", "ff02::1", "0:0:0:0:0:0:0:1", "010.1.1.1", None]
    rows = spark.createDataFrame([(x,) for x in public + other], "ip string").select("ip", enrich.is_public_ip(F.col("ip")).alias("p")).collect()
    assert [r["ip"] for r in rows if r["p"]] == public and all(r["p"] is not None for r in rows)


def test_calls_that_fail_cost_their_own_values():
    tried = []

    def provider(rows):
        v = rows[0][0]
        tried.append(v)
        if v == "raises":
            raise OSError("down")
        if v == "hangs":
            time.sleep(30)
        if v == "odd":
            return [("odd", "t")]
        if v == "recovers" and tried.count(v) == 1:
            raise OSError("once")
        return [(v, t, k, "ok") for v, t, k in rows]

    began = time.monotonic()
    asked = [(v, "t", "k") for v in ("a", "hangs", "raises", "odd", "recovers", *map(str, range(20)))]
    answers, failures = ask(provider, asked, Limits(seconds=0.5, threads=2, retries=1, values=1))
    assert time.monotonic() - began < 10
    assert sorted(a[0] for a in answers) == sorted(["a", "recovers", *map(str, range(20))])
    assert {f[0]: f[3] for f in failures} == {"raises": "OSError: down", "hangs": "no answer in 0.5 seconds", "odd": "ValueError: an answer isn't of value, tag, type and payload"}
    assert tried.count("raises") == tried.count("hangs") == 2
    assert ask(provider, []) == ([], [])


def test_failed_lookups_are_asked_again(spark):
    def provider(rows):
        if any(v == "bad" for v, *_ in rows):
            raise OSError("down")
        return [(v, t, k, f"of {v}") for v, t, k in rows]

    asked = spark.createDataFrame([("good", "t", "k"), ("bad", "t", "k"), ("kept", "t", "k")], "value string, tag string, attr_type string").coalesce(1)
    cache = spark.createDataFrame([("kept", "t", "k", "kept", datetime(2030, 1, 1))], enrich.CACHE)
    answers, new, failed = look_up(asked, cache, provider, F.lit(datetime(2025, 1, 1)), limits=Limits(values=1, retries=0))
    assert sorted(r["payload"] for r in answers.collect()) == ["kept", "of good"]
    assert [r["value"] for r in new.collect()] == ["good"] and [tuple(r) for r in failed.collect()] == [("bad", "t", "k", "OSError: down")]


def test_cache_in_buckets(spark, tmp_path):
    cache, at = BucketedCache(spark, f"file://{tmp_path}/cache", 16), lambda y: datetime(y, 1, 1)
    assert cache.read().count() == 0
    now = F.lit(at(2025))
    cache.add(spark.createDataFrame([(f"v{i}", "t", "k", f"p{i}", at(2024 if i % 10 == 0 else 2026)) for i in range(1000)], enrich.CACHE).repartition(7), now)
    assert cache.read().count() == 900 and len(cache.read().inputFiles()) == 16
    few = spark.createDataFrame([("v1",), ("v2",), ("none",)], "value string")
    files = cache.read(few).inputFiles()
    assert len(files) == few.select(cache.bucket(F.col("value")).alias("b")).distinct().count() < 16
    assert {r["payload"] for r in cache.read(few).where("value in ('v1', 'v2')").collect()} == {"p1", "p2"}
    cache.add(spark.createDataFrame([("v1", "t", "k", "later", at(2030)), ("v2", "t", "k", "sooner", at(2025)), ("new", "t", "k", "", at(2027))], enrich.CACHE), now)
    found = {r["value"]: r["payload"] for r in cache.read().collect()}
    assert (found["v1"], found["v2"], found["new"], len(found)) == ("later", "p2", "", 901)
    cache.add(spark.createDataFrame([(f"v{i}", "t", "k", "x", at(2028)) for i in range(1000)], enrich.CACHE), F.lit(at(2027)))
    assert cache.read().count() == 1000 and all(len(v) <= 2 for v in cache._versions().values())
    cache.add(spark.createDataFrame([(f"v{i}", "t", "k", "x", at(2029)) for i in range(1000)], enrich.CACHE), F.lit(at(2031)))
    assert cache.read().count() == 0 and BucketedCache(spark, f"file://{tmp_path}/cache", 8).read().count() == 0


RULE = "id: p\nfields: [user.name]\ndetection:\n  s: {event.code: '*'}\n  condition: s\n---\nid: q\ndetection:\n  s: {event.code: 1}\n  condition: s | count() by user.name > 1\n  timeframe: 1d\n"


def line(i, code="1", user="a"):
    return json.dumps({"n": i, "event": {"created": f"2024-01-0{1 + i % 5}T00:00:{i:02d}.000Z", "code": code}, "user": {"name": user}})


def alerts_of(spark, tmp_path, name="alerts"):
    return sorted(r["alert_uid"] for kind in ("plain", "fired") for r in read_alerts(spark, f"{tmp_path}/{name}/{kind}").collect())


def test_a_new_checkpoint_loses_nothing_and_doubles_nothing(spark, tmp_path):
    (tmp_path / "rules").mkdir(), (tmp_path / "in").mkdir()
    (tmp_path / "rules/r.yml").write_text(RULE)
    rules = RuleSet(str(tmp_path / "rules"))

    def match(checkpoint):
        q = start_matching(event_source(spark, "text", str(tmp_path / "in"), streaming=True), rules, str(tmp_path / "m"), str(tmp_path / checkpoint))
        assert q.awaitTermination(300) and q.exception() is None

    def alert(checkpoint):
        for q in start_alerting(spark, str(tmp_path / "m"), str(tmp_path / "alerts"), str(tmp_path / checkpoint)):
            assert q.awaitTermination(300) and q.exception() is None

    (tmp_path / "in/0.json").write_text(line(0) + "\n")
    match("c1"), alert("a1")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    (tmp_path / "in/0.json").unlink()
    (tmp_path / "in/1.json").write_text(line(1) + "\n")
    match("c2")  # batch 0 again, of another query
    assert sorted(json.loads(r["raw"])["n"] for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [0, 0, 1, 1]
    alert("a1")
    before = alerts_of(spark, tmp_path)
    assert len(before) == len(set(before)) == 2
    alert("a2")  # all matches once more, into the same table
    assert alerts_of(spark, tmp_path) == before


def test_events_and_rejected_lines_are_all_lines(spark, tmp_path):
    (tmp_path / "rules").mkdir(), (tmp_path / "in").mkdir()
    (tmp_path / "rules/r.yml").write_text(RULE)
    (tmp_path / "map.json").write_text(json.dumps({"user.name": {"t": [{"mispAttribute": "user", "type": "domain", "resolveName": True}]}}))
    lines = [line(i, user="abcd"[i % 4]) for i in range(20)] + ["{broken", "[1]", "7", "", "null"]
    names = {k: str(tmp_path / k) for k in ("match_table", "event_table", "alert_table", "checkpoint", "cache_table")}
    settings = {"source": "text", "source_path": str(tmp_path / "in"), "rules": str(tmp_path / "rules"), "enrichment": "true", "intel_map": str(tmp_path / "map.json"), "lookup_timeout_ms": 700, "lookup_values": 1, "lookup_retries": 0, "cache_buckets": 4, **names}
    (tmp_path / "job.properties").write_text("".join(f"{k}={v}\n" for k, v in settings.items()))

    def provider(rows):
        if rows[0][0] == "b":
            raise OSError("down")
        if rows[0][0] == "c":
            time.sleep(20)
        return [(v, t, k, json.dumps([{"event_id": f"i{v}", "category": "c", "attr_tags": []}])) for v, t, k in rows]

    def go():
        for q in run(spark, load_config(str(tmp_path / "job.properties")), provider):
            assert q.awaitTermination(300) and q.exception() is None

    (tmp_path / "in/0.json").write_text("\n".join(lines[:12]) + "\n")
    go()
    (tmp_path / "in/1.json").write_text("\n".join(lines[12:]) + "\n")
    go()
    for commits in (tmp_path / "checkpoint/events").rglob("commits"):  # the last batch is tried again
        for f in [f for f in commits.iterdir() if f.name.strip(".").split(".")[0] == str(max(int(f.name) for f in commits.iterdir() if f.name.isdigit()))]:
            f.unlink()
    go()
    events = spark.read.parquet(f"{tmp_path}/event_table").collect()
    bad = spark.read.parquet(f"{tmp_path}/event_table_rejected").collect()
    assert len(events) + len(bad) == len(lines)
    assert sorted((r["raw"], r["reason"]) for r in bad) == sorted([("{broken", "not JSON"), ("", "not JSON"), ("[1]", "no object"), ("7", "no object"), ("null", "no object")])
    assert all("/in/1.json:0" in r["origin"] for r in bad)
    for r in events:
        user = json.loads(r["raw"])["user"]["name"]
        assert r["intel_event_id"] == ([f"i{user}"] if user in "ad" else None)


def test_rejected_lines(spark):
    got = rejected(parse_events(spark.createDataFrame([("{}", "o1"), (None, "o2"), ("x", "o3")], "value string, origin string"), keep=("origin",))).collect()
    assert sorted((r["origin"], r["raw"], r["reason"]) for r in got) == [("o2", None, "no text"), ("o3", "x", "not JSON")]


def test_offsets_as_a_start():
    c = Config(topics="a", start='{"a": {"1": 5, "0": -2}}')
    assert json.loads(kafka_options(c)["startingOffsets"]) == {"a": {"0": -2, "1": 5}}
    for bad in ('{"a": 5}', '{"a": {"x": 1}}', '{"a": {"0": -3}}', "{"):
        with pytest.raises(ValueError):
            kafka_options(Config(topics="a", start=bad))


def test_rules_see_enriched_events_and_alerts_tell_of_their_rule(spark, tmp_path):
    (tmp_path / "rules").mkdir(), (tmp_path / "in").mkdir()
    (tmp_path / "rules/r.yml").write_text("id: e\ndescription: known bad\nauthor: me\nreferences: [u1, u2]\nfalsepositives: none\ndetection:\n  s: {enriched.intel_attribute_category|contains: c2}\n  d: {enriched.dns_resolved_address: '*'}\n  condition: s and not d\n")
    (tmp_path / "map.json").write_text(json.dumps({"user.name": {"t": [{"mispAttribute": "user", "type": "domain", "resolveName": True}]}}))
    spark.createDataFrame([("t", "user", u, f"i{u}", c, ["x"]) for u, c in (("a", "c1"), ("a", "c2"), ("b", "c1"), ("d", "c2"))], "tag string, attr_type string, value string, event_id string, category string, attr_tags array<string>").write.parquet(f"{tmp_path}/intel")
    names = {k: str(tmp_path / k) for k in ("match_table", "event_table", "alert_table", "checkpoint", "cache_table")}
    values = {"source": "text", "source_path": str(tmp_path / "in"), "rules": str(tmp_path / "rules"), "enrichment": "true", "match_enriched": "true", "alert_details": "true", "intel_map": str(tmp_path / "map.json"), "intel_table": f"{tmp_path}/intel", **names}
    (tmp_path / "job.properties").write_text("".join(f"{k}={v}\n" for k, v in values.items()))
    (tmp_path / "in/0.json").write_text("\n".join(line(i, user="abcd"[i % 4]) for i in range(8)) + "\n")
    for q in run(spark, load_config(str(tmp_path / "job.properties"))):
        assert q.awaitTermination(300) and q.exception() is None
    got = read_alerts(spark, f"{tmp_path}/alert_table/plain", details=True).collect()
    assert sorted(json.loads(r["rule_event"])["user"]["name"] for r in got) == ["a", "a", "d", "d"]
    assert {(r["rule_description"], r["rule_author"], tuple(r["rule_references"]), tuple(r["rule_falsepositives"])) for r in got} == {("known bad", "me", ("u1", "u2"), ("none",))}
