"""Registered queries of the detection engine and their DuckDB counterparts.

The star-schema `events` table stands in for security events: `COLUMNS` gives the path of each field as an expression
that both engines read alike. A query is a rule; its SQL is written by hand, not derived from the rule.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.operators import enrich
from sentrel.operators.alerts import build_alerts
from sentrel.operators.events import column_resolver, fan_out, parse_events, quarantine, utc, variant_resolver
from sentrel.operators.matching import match_rules
from sentrel.operators.near import near_matches
from sentrel.operators.rule_index import match_rules_indexed
from sentrel.operators.thresholds import fired, threshold_matches
from sentrel.plans.rules import FieldMap, compile_documents, compile_rule
from sentrel.sources.readers import replay
from sentrel.streaming.pipeline import detect, run_batch

COLUMNS = {
    "event.code": "event_type",
    "user.name": "concat('u', user_id)",
    "client.ip": "concat('10.0.', user_id % 4, '.', user_id % 250)",
    "source.ip": "CASE WHEN user_id % 3 = 0 THEN concat('203.0.113.', user_id % 250) WHEN user_id % 3 = 1 THEN concat('172.16.0.', user_id % 250) ELSE concat('198.51.100.', user_id % 250) END",
    "dns.name": "concat('host', user_id % 20, '.example')",
    "client.bytes": "floor(value)",
    "destination.port": "get_json_object(props, '$.k')",
    "rare": "nullif(get_json_object(props, '$.k'), '9')",
    "blank": "translate(get_json_object(props, '$.k'), '7', '')",
    "text64": "base64(encode(concat('id=', user_id, ';', event_type), 'UTF-8'))",
    "message": "concat(event_type, ' user=', user_id, ' k=', get_json_object(props, '$.k'))",
    "url.query": "concat('k?', get_json_object(props, '$.k'))",
    "ended": "concat(event_type, CASE WHEN user_id % 2 = 0 THEN chr(10) ELSE '' END)",
}
PRODUCT = "CASE WHEN user_id % 2 = 0 THEN 'windows' ELSE 'linux' END"
CATEGORY = "CASE event_type WHEN 'error' THEN 'application' WHEN 'purchase' THEN 'webserver' ELSE 'proxy' END"
RESOLVE = column_resolver(COLUMNS)

#: The same view in DuckDB.
EVENTS = """e AS (
  SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, event_type AS code, 'u' || user_id AS usr, '10.0.' || (user_id % 4) || '.' || (user_id % 250) AS ip, user_id,
         CASE WHEN user_id % 3 = 0 THEN '203.0.113.' || (user_id % 250) WHEN user_id % 3 = 1 THEN '172.16.0.' || (user_id % 250) ELSE '198.51.100.' || (user_id % 250) END AS src,
         'host' || (user_id % 20) || '.example' AS dns, CAST(floor(value) AS BIGINT) AS bytes, json_extract_string(props, '$.k') AS port,
         nullif(json_extract_string(props, '$.k'), '9') AS rare, base64(encode('id=' || user_id || ';' || event_type)) AS text64,
         event_type || ' user=' || user_id || ' k=' || json_extract_string(props, '$.k') AS message, 'k?' || json_extract_string(props, '$.k') AS query, event_type || CASE WHEN user_id % 2 = 0 THEN chr(10) ELSE '' END AS ended,
         CASE WHEN user_id % 2 = 0 THEN 'windows' ELSE 'linux' END AS product,
         CASE event_type WHEN 'error' THEN 'application' WHEN 'purchase' THEN 'webserver' ELSE 'proxy' END AS category
  FROM events)"""


def events_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumns({"event_uid": F.col("event_id"), "created": utc(F.col("ts")), "logsource": F.struct(F.expr(CATEGORY).alias("category"), F.expr(PRODUCT).alias("product"))})


def rule(detection: dict, ruleid: str = "r", **more) -> dict:
    return {"id": ruleid, "title": f"rule {ruleid}", "detection": detection, **more}


def matches(spark: SparkSession, sf_dir: str, *rules: dict, fields: FieldMap | None = None) -> DataFrame:
    return match_rules(events_frame(spark, sf_dir), [c for r in rules for c in compile_rule(r, fields)], RESOLVE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _search(name: str, detection: dict, where: str) -> None:
    """Ids of the events that a rule without aggregation matches."""
    QUERIES[name] = lambda spark, sf_dir: matches(spark, sf_dir, rule(detection)).select(F.col("event_uid").alias("event_id"), "condition_idx")
    ORACLES[name] = f"WITH {EVENTS} SELECT event_id, CAST(0 AS INT) AS condition_idx FROM e WHERE {where}"


def _one(field: str, value, condition: str = "s") -> dict:
    return {"s": {field: value}, "condition": condition}


_b64 = lambda s: base64.b64encode(s.encode()).decode()

_search("eq_string", _one("event.code", "error"), "code = 'error'")
_search("eq_number", _one("destination.port", 7), "port = '7'")
_search("eq_empty", _one("blank", ""), "translate(port, '7', '') = ''")
_search("is_null", _one("rare", None), "rare IS NULL")
_search("null_in_list", _one("rare", [None, 3]), "rare IS NULL OR rare = '3'")
_search("not_null_wildcard", _one("rare", "*"), "rare IS NOT NULL")
_search("wild_both", _one("user.name", "*12*"), "contains(usr, '12')")
_search("wild_prefix", _one("user.name", "u1*"), "starts_with(usr, 'u1')")
_search("wild_suffix", _one("user.name", "*7"), "ends_with(usr, '7')")
_search("wild_inner", _one("client.ip", "10.*.1*"), "regexp_full_match(ip, '10\\..*\\.1.*')")
_search("wild_literal", {"s": {"url.query": "k?1*"}, "f": {"url.query": ["k?7", "kk1", "*k?8"]}, "condition": "s or f"}, "starts_with(query, 'k?1') OR query IN ('k?7', 'k?8')")
_search("mod_contains", _one("event.code|contains", "rr"), "contains(code, 'rr')")
_search("mod_contains_list", _one("event.code|contains", ["rr", "cli"]), "contains(code, 'rr') OR contains(code, 'cli')")
_search("mod_startswith", _one("event.code|startswith", "pur"), "starts_with(code, 'pur')")
_search("mod_endswith", _one("event.code|endswith", ["up", "ew"]), "ends_with(code, 'up') OR ends_with(code, 'ew')")
_search("mod_all", _one("user.name|contains|all", ["1", "2"]), "contains(usr, '1') AND contains(usr, '2')")
_search("mod_number", _one("destination.port|startswith", 1), "starts_with(port, '1')")
_search("mod_re", _one("client.ip|re", r"10\.0\.[13]\.\d+"), "regexp_full_match(ip, '10\\.0\\.[13]\\.\\d+')")
_search("mod_base64", _one("text64|base64", "id=4;error"), f"text64 = '{_b64('id=4;error')}'")
_search("mod_base64offset", _one("text64|base64offset|contains", "error"), "contains(text64, 'ZXJyb3') OR contains(text64, 'Vycm9y') OR contains(text64, 'lcnJvc')")
_search("keywords_or", {"keywords": ["error user=1", "k=7"], "condition": "keywords"}, "contains(message, 'error user=1') OR contains(message, 'k=7')")
_search("keywords_all", {"s": {"keywords|contains|all": ["error", "k=7"]}, "t": {"|all": ["view", "k=3"]}, "condition": "1 of them"}, "(contains(message, 'error') AND contains(message, 'k=7')) OR (contains(message, 'view') AND contains(message, 'k=3'))")
_search("field_is_message", _one("message", "signup"), "contains(message, 'signup')")
_search("full_match_line_end", {"s": {"ended|re": "err.r"}, "t": {"ended": ["vi*w", "*ur*ase"]}, "condition": "1 of them"}, "ended IN ('error', 'view', 'purchase')")
_search("sel_map_and", {"s": {"event.code": "error", "destination.port": 7}, "condition": "s"}, "code = 'error' AND port = '7'")
_search("field_list_or", _one("event.code", ["error", "signup"]), "code IN ('error', 'signup')")
_search("list_of_maps", {"s": [{"event.code": ["error", "view"], "destination.port": 7}, {"user.name": "u3"}], "condition": "s"}, "(code IN ('error', 'view') AND port = '7') OR usr = 'u3'")
_search("cond_not", {"s": {"event.code": "error"}, "f": {"rare": 3}, "condition": "s and not f"}, "code = 'error' AND NOT coalesce(rare = '3', false)")
_search("cond_paren", {"a": {"event.code": "error"}, "b": {"event.code": "view"}, "c": {"destination.port": 7}, "condition": "(a or b) AND NOT c"}, "(code = 'error' OR code = 'view') AND port <> '7'")
_search("cond_precedence", {"a": {"event.code": "error"}, "b": {"event.code": "view"}, "c": {"destination.port": 7}, "condition": "a or b and c"}, "code = 'error' OR (code = 'view' AND port = '7')")
_search("one_of_them", {"a": {"event.code": "error"}, "b": {"destination.port": 7}, "condition": "1 of them"}, "code = 'error' OR port = '7'")
_search("all_of_them", {"a": {"event.code": "error"}, "b": {"destination.port": 7}, "condition": "all of them"}, "code = 'error' AND port = '7'")
_search("one_of_prefix", {"sel1": {"event.code": "error"}, "sel2": {"user.name": "u3"}, "other": {"destination.port": 7}, "condition": "1 of sel* and other"}, "(code = 'error' OR usr = 'u3') AND port = '7'")
_search("all_of_prefix", {"sel1": {"event.code": "error"}, "sel2": {"user.name|startswith": "u1"}, "other": {"destination.port": 7}, "condition": "all of sel* and not other"}, "code = 'error' AND starts_with(usr, 'u1') AND port <> '7'")
_search("one_of_name", {"sel1": {"event.code": "error", "destination.port": 7}, "other": {"user.name": "u3"}, "condition": "1 of sel1 or other"}, "(code = 'error' AND port = '7') OR usr = 'u3'")
_search("not_one_of", {"a": {"event.code": "error"}, "b": {"rare": 3}, "condition": "not 1 of them"}, "NOT (code = 'error' OR coalesce(rare = '3', false))")


def cond_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    detection = {"a": {"event.code": "error"}, "b": {"destination.port": 7}, "condition": ["a and b", "a and not b"]}
    return matches(spark, sf_dir, rule(detection)).select(F.col("event_uid").alias("event_id"), "condition_idx")


QUERIES["cond_list"] = cond_list
ORACLES["cond_list"] = f"WITH {EVENTS} SELECT event_id, CAST(CASE WHEN port = '7' THEN 0 ELSE 1 END AS INT) AS condition_idx FROM e WHERE code = 'error'"

def _indexed_rule(i: int) -> dict:
    """Rules of six kinds: values, texts inside values, exclusions, patterns, alternatives of two log sources, nulls."""
    kinds = (
        {"s": {"destination.port": [i % 10, f"x{i}"], "user.name|endswith": str(i % 100)}, "condition": "s"},
        {"s": {"message|contains": f"user={i} "}, "condition": "s"},
        {"s": {"client.ip|startswith": f"10.0.{i % 4}.{i % 25}"}, "f": {"event.code": ["error", "view"]}, "condition": "s and not f"},
        {"s": {"user.name|re": rf"u{i % 7}\d+{i % 10}"}, "condition": "s"},
        {"s": [{"user.name": f"u{i}"}, {"event.code": "purchase", "destination.port": i % 12}], "condition": "s"},
        {"s": {"event.code": "signup", "user.name|contains": str(i % 50)}, "f": {"rare": None}, "condition": "s and not f"},
    )
    return rule(kinds[i % 6], f"r{i}", logsource={"product": ("windows", "linux")[i // 6 % 2]} if i % 6 == 4 else {})


INDEXED = [_indexed_rule(i) for i in range(240)]


def rule_index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_rules_indexed(events_frame(spark, sf_dir), [c for r in INDEXED for c in compile_rule(r)], RESOLVE)
    return found.select(F.col("event_uid").alias("event_id"), "rule_key")


QUERIES["rule_index_match"] = rule_index_match
ORACLES["rule_index_match"] = f"""WITH {EVENTS} SELECT event_id, 'r' || i || '#0' AS rule_key FROM e, range(240) r(i) WHERE CASE i % 6
  WHEN 0 THEN port = (i % 10)::varchar AND ends_with(usr, (i % 100)::varchar) WHEN 1 THEN contains(message, 'user=' || i || ' ')
  WHEN 2 THEN starts_with(ip, '10.0.' || (i % 4) || '.' || (i % 25)) AND code NOT IN ('error', 'view') WHEN 3 THEN regexp_full_match(usr, 'u' || (i % 7) || '\\d+' || (i % 10))
  WHEN 4 THEN product = CASE i // 6 % 2 WHEN 0 THEN 'windows' ELSE 'linux' END AND (usr = 'u' || i OR (code = 'purchase' AND port = (i % 12)::varchar))
  ELSE code = 'signup' AND contains(usr, (i % 50)::varchar) AND rare IS NOT NULL END"""

NEAR = rule({"s": {"event.code": "error"}, "b": {"event.code": "purchase"}, "c": {"event.code": "signup"}, "condition": ["s | near b and not c by user.name within 12h", "s | near (b and c) or not b"], "timeframe": "5m"}, "near")


def near_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with a purchase but no signup of their user within 12 hours; errors that have both, or no purchase, within 5 minutes."""
    rules = compile_rule(NEAR)
    found = match_rules(events_frame(spark, sf_dir), rules, RESOLVE).select("event_uid", "created", "rule_key", "group_value", "condition_idx")
    return near_matches(found, rules).select(F.col("event_uid").alias("event_id"), "condition_idx")


_other = lambda code, ms, same="": f"EXISTS (SELECT 1 FROM e o WHERE o.code = '{code}' AND o.ms BETWEEN e.ms - {ms} AND e.ms + {ms}{same})"
QUERIES["near_within"] = near_within
ORACLES["near_within"] = f"""WITH {EVENTS} SELECT event_id, CAST(0 AS INT) AS condition_idx FROM e WHERE code = 'error' AND {_other('purchase', 43200000, ' AND o.usr = e.usr')} AND NOT {_other('signup', 43200000, ' AND o.usr = e.usr')}
  UNION ALL SELECT event_id, CAST(1 AS INT) FROM e WHERE code = 'error' AND (({_other('purchase', 300000)} AND {_other('signup', 300000)}) OR NOT {_other('purchase', 300000)})"""

ROUTED = [rule(_one("destination.port", 7), "both", logsource={"category": "Application", "product": "windows"}), rule(_one("destination.port", 7), "cat", logsource={"category": "proxy", "service": "x"}), rule(_one("destination.port", 7), "prod", logsource={"product": "linux"}), rule(_one("destination.port", 7), "any")]


def logsource_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir, *ROUTED).select(F.col("event_uid").alias("event_id"), "ruleid")


def logsource_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = {("application", "windows"), ("proxy", None), (None, "linux")}
    return fan_out(events_frame(spark, sf_dir), active).select("event_id", F.col("route.category").alias("category"), F.col("route.product").alias("product"))


QUERIES |= {"logsource_route": logsource_route, "logsource_fanout": logsource_fanout}
ORACLES["logsource_route"] = f"""WITH {EVENTS}, r(ruleid, c, p) AS (VALUES ('both', 'application', 'windows'), ('cat', 'proxy', NULL), ('prod', NULL, 'linux'), ('any', NULL, NULL))
SELECT event_id, ruleid FROM e JOIN r ON (c IS NULL OR c = category) AND (p IS NULL OR p = product) WHERE port = '7'"""
ORACLES["logsource_fanout"] = f"""WITH {EVENTS}, f AS (SELECT event_id, category, product FROM e UNION ALL SELECT event_id, category, NULL FROM e UNION ALL SELECT event_id, NULL, product FROM e)
SELECT * FROM f WHERE (category = 'application' AND product = 'windows') OR (category = 'proxy' AND product IS NULL) OR (category IS NULL AND product = 'linux')"""


#: A shared part, two rules under its id for other log sources, a list of conditions, and a rule of its own id.
DOCUMENTS = """
action: global
id: shared
status: test
detection:
  s: {event.code: [error, purchase]}
  condition: s
---
logsource: {category: application}
detection:
  s: {destination.port: 7}
---
logsource: {category: webserver}
detection:
  condition: [s and not f, s and f]
  f: {destination.port: 7}
---
id: own
logsource: {category: proxy, product: linux}
detection:
  s: {event.code: view}
"""


def multi_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, errors = compile_documents(DOCUMENTS)
    assert not errors
    return match_rules(events_frame(spark, sf_dir), rules, RESOLVE).select(F.col("event_uid").alias("event_id"), "rule_key", "condition_idx")


QUERIES["multi_document"] = multi_document
ORACLES["multi_document"] = f"""WITH {EVENTS}, m AS (
  SELECT event_id, 'shared#0' AS rule_key, 0 AS i FROM e WHERE category = 'application' AND code = 'error' AND port = '7'
  UNION ALL SELECT event_id, CASE WHEN port = '7' THEN 'shared#1#1' ELSE 'shared#1#0' END, CASE WHEN port = '7' THEN 1 ELSE 0 END FROM e WHERE category = 'webserver' AND code = 'purchase'
  UNION ALL SELECT event_id, 'own#0', 0 FROM e WHERE category = 'proxy' AND product = 'linux' AND code = 'view')
SELECT event_id, rule_key, CAST(i AS INT) AS condition_idx FROM m"""


def multi_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule(_one("destination.port", k), f"port{k}") for k in range(50)] + [rule(_one("event.code", c), c) for c in ("error", "view")]
    return matches(spark, sf_dir, *rules).groupBy("ruleid").agg(F.count("*").alias("n"))


QUERIES["multi_rule_match"] = multi_rule_match
ORACLES["multi_rule_match"] = f"WITH {EVENTS}, m AS (SELECT 'port' || port AS ruleid FROM e WHERE CAST(port AS INT) BETWEEN 0 AND 49 UNION ALL SELECT code FROM e WHERE code IN ('error', 'view')) SELECT ruleid, count(*) AS n FROM m GROUP BY ruleid"


def field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the rule are mapped; a name without a mapping is a path already."""
    r = rule({"s": {"EventCode": "error", "destination.port": 7}, "condition": "s"})
    return matches(spark, sf_dir, r, fields=FieldMap({"EventCode": "event.code"})).select(F.col("event_uid").alias("event_id"))


QUERIES["field_mapping"] = field_mapping
ORACLES["field_mapping"] = f"WITH {EVENTS} SELECT event_id FROM e WHERE code = 'error' AND port = '7'"

# ---- thresholds -------------------------------------------------------------------------------------------------

#: SQL of the accumulator: opening value, next value and tested value; x is the event's number or text, NULL if it has none.
_SQL_AGG = {
    "count": ("1", "acc + 1", "acc"),
    "sum": ("x", "acc + x", "acc"),
    "min": ("x", "least(acc, x)", "acc"),
    "max": ("x", "greatest(acc, x)", "acc"),
    "avg": ("{'s': x, 'n': CAST(1 AS BIGINT)}", "{'s': acc.s + x, 'n': acc.n + 1}", "acc.s // acc.n"),
    "uniquecount": ("[x]", "CASE WHEN list_contains(acc, x) THEN acc ELSE list_append(acc, x) END", "len(acc)"),
}


def _threshold_sql(where: str, key: str, x: str, fn: str, op: str, threshold: int, seconds: int, tail: str = "", reopen: bool = False) -> str:
    init, step, value = _SQL_AGG[fn]
    at = "ARRAY" if fn == "uniquecount" else fn
    return f"""WITH RECURSIVE {EVENTS},
o AS (SELECT event_id, ms, {key} AS key, {x} AS x, row_number() OVER (PARTITION BY {key} ORDER BY ms, event_id) AS rn FROM e WHERE {where}),
r AS (
  SELECT key, rn, event_id, ms AS t0, {init} AS acc, false AS fired, CAST(NULL AS BIGINT) AS v FROM o WHERE rn = 1
  UNION ALL
  SELECT key, rn, event_id,
         CASE WHEN t0 IS NULL OR ({reopen} AND late) THEN ms WHEN late OR hit THEN NULL ELSE t0 END,
         CASE WHEN t0 IS NULL OR ({reopen} AND late) THEN first ELSE next END,
         coalesce(t0 IS NOT NULL AND NOT late AND hit, false),
         CASE WHEN t0 IS NOT NULL AND NOT late AND hit THEN CAST(nv AS BIGINT) END
  FROM (SELECT *, (SELECT {value} FROM (SELECT next AS acc)) AS nv, (SELECT {value} FROM (SELECT next AS acc)) {op} {threshold} AS hit
        FROM (SELECT o.key, o.rn, o.event_id, o.ms, r.t0, (o.ms - r.t0) // 1000 >= {seconds} AS late, {init.replace('x', 'o.x') if fn != 'count' else init} AS first,
                     {step.replace('acc', 'r.acc').replace('x)', 'o.x)').replace(' x', ' o.x') if fn != 'count' else 'r.acc + 1'} AS next
              FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1)))
SELECT event_id, v AS agg_value{tail} FROM r WHERE fired  -- {at}"""


def _threshold(name: str, condition: str, seconds: str, frame: int, where: str, key: str, x: str, fn: str, op: str, threshold: int) -> None:
    detection = {"s": {"event.code": where.split("'")[1]}, "condition": f"s | {condition}", "timeframe": seconds}
    QUERIES[name] = lambda spark, sf_dir: fired(matches(spark, sf_dir, rule(detection))).select(F.col("event_uid").alias("event_id"), "agg_value")
    ORACLES[name] = _threshold_sql(where, key, x, fn, op, threshold, frame)


_ERR, _BUY = "code = 'error'", "code = 'purchase'"
_threshold("agg_count_by", "count() by user.name > 3", "3d", 259200, _ERR, "usr", "1", "count", ">", 3)
_threshold("agg_count", "count() > 20", "6h", 21600, _ERR, "1", "1", "count", ">", 20)
_threshold("agg_count_field", "count(destination.port) >= 3", "1d", 86400, _ERR, "port", "1", "count", ">=", 3)
_threshold("agg_count_field_by", "count(destination.port) by client.ip > 1", "10d", 864000, _ERR, "port || '|' || ip", "1", "count", ">", 1)
_threshold("agg_uniquecount_by", "uniquecount(destination.port) by client.ip > 2", "5d", 432000, _ERR, "ip", "port", "uniquecount", ">", 2)
_threshold("agg_uniquecount", "uniquecount(user.name) >= 10", "12h", 43200, _ERR, "1", "usr", "uniquecount", ">=", 10)
_threshold("agg_sum_by", "sum(client.bytes) by user.name > 100", "4d", 345600, _BUY, "usr", "bytes", "sum", ">", 100)
_threshold("agg_sum", "sum(client.bytes) >= 500", "1d", 86400, _BUY, "1", "bytes", "sum", ">=", 500)
_threshold("agg_min_by", "min(client.bytes) by client.ip < 5", "6d", 518400, _BUY, "ip", "bytes", "min", "<", 5)
_threshold("agg_min", "min(client.bytes) <= 1", "2h", 7200, _BUY, "1", "bytes", "min", "<=", 1)
_threshold("agg_max_by", "max(client.bytes) by user.name > 40", "6d", 518400, _BUY, "usr", "bytes", "max", ">", 40)
_threshold("agg_max", "max(client.bytes) > 90", "3h", 10800, _BUY, "1", "bytes", "max", ">", 90)
_threshold("agg_avg_by", "avg(client.bytes) by user.name >= 20", "8d", 691200, _BUY, "usr", "bytes", "avg", ">=", 20)
_threshold("agg_avg", "avg(client.bytes) > 30", "1d", 86400, _BUY, "1", "bytes", "avg", ">", 30)

_OPS = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "="}


def agg_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule({"s": {"event.code": "error"}, "condition": f"s | count() by user.name {op} 3", "timeframe": "3d"}, name) for name, op in _OPS.items()]
    return fired(matches(spark, sf_dir, *rules)).select(F.col("event_uid").alias("event_id"), "agg_value", F.split_part("rule_key", F.lit("#"), F.lit(1)).alias("ruleid"))


def timeframe_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [rule({"s": {"event.code": "error"}, "condition": "s | count() by client.ip > 2", "timeframe": t}, t) for t in ("9000s", "900m", "60h", "9d", "1M", "1y")]
    return fired(matches(spark, sf_dir, *rules)).select(F.col("event_uid").alias("event_id"), "agg_value", F.split_part("rule_key", F.lit("#"), F.lit(1)).alias("ruleid"))


QUERIES |= {"agg_ops": agg_ops, "timeframe_units": timeframe_units}
ORACLES["agg_ops"] = " UNION ALL ".join(f"SELECT * FROM ({_threshold_sql(_ERR, 'usr', '1', 'count', op, 3, 259200, f''', '{name}' AS ruleid''').partition('  --')[0]})" for name, op in _OPS.items())
ORACLES["timeframe_units"] = " UNION ALL ".join(f"SELECT * FROM ({_threshold_sql(_ERR, 'ip', '1', 'count', '>', 2, s, f''', '{t}' AS ruleid''').partition('  --')[0]})" for t, s in (("9000s", 9000), ("900m", 54000), ("60h", 216000), ("9d", 777600), ("1M", 2592000), ("1y", 31536000)))


def reopen_on_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    detection = {"s": {"event.code": "error"}, "condition": "s | count() by user.name > 2", "timeframe": "2d"}
    return fired(matches(spark, sf_dir, rule(detection)), reopen_on_expiry=True).select(F.col("event_uid").alias("event_id"), "agg_value")


QUERIES["reopen_on_expiry"] = reopen_on_expiry
ORACLES["reopen_on_expiry"] = _threshold_sql(_ERR, "usr", "1", "count", ">", 2, 172800, reopen=True)


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice: each counts, and each that fires is one row."""
    e = events_frame(spark, sf_dir)
    r = compile_rule(rule({"s": {"event.code": "error"}, "condition": "s | count() by user.name > 3", "timeframe": "3d"}))
    return fired(match_rules(e.unionAll(e), r, RESOLVE)).select(F.col("event_uid").alias("event_id"), "agg_value")


QUERIES["repeated_events"] = repeated_events
ORACLES["repeated_events"] = _threshold_sql(_ERR, "usr", "1", "count", ">", 3, 259200).replace("FROM events)", "FROM (SELECT * FROM events UNION ALL SELECT * FROM events))")


def half_a_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregation without a timeframe, or the other way round, never alerts; the third rule does."""
    a, b, c = ({"s": {"event.code": "error"}, "condition": x} for x in ("s | count() by user.name > 1", "s", "s"))
    found = matches(spark, sf_dir, rule(a, "a"), rule(b | {"timeframe": "1d"}, "b"), rule(c, "c"))
    return threshold_matches(found).select(F.col("event_uid").alias("event_id"), "ruleid")


QUERIES["half_a_threshold"] = half_a_threshold
ORACLES["half_a_threshold"] = f"WITH {EVENTS} SELECT event_id, 'c' AS ruleid FROM e WHERE code = 'error'"


def lineitem_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same engine on another table: quantity of a supplier within 30 days of shipping."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"event_uid": F.format_string("%d-%d", "l_orderkey", "l_linenumber"), "created": utc(F.col("l_shipdate")), "logsource": F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("product"))})
    resolve = column_resolver({"flag": "l_returnflag", "supplier": "l_suppkey", "quantity": "cast(floor(l_quantity) as bigint)"})
    r = compile_rule(rule({"s": {"flag": "R"}, "condition": "s | sum(quantity) by supplier > 200", "timeframe": "1M"}))
    found = fired(match_rules(t, r, resolve))
    return found.select(F.col("event_uid").alias("event_id"), "agg_value")


QUERIES["lineitem_sum"] = lineitem_sum
ORACLES["lineitem_sum"] = _threshold_sql("flag = 'R'", "supp", "qty", "sum", ">", 200, 2592000).replace(EVENTS, "e AS (SELECT l_orderkey || '-' || l_linenumber AS event_id, epoch_us(l_shipdate) // 1000 AS ms, l_returnflag AS flag, l_suppkey AS supp, CAST(floor(l_quantity) AS BIGINT) AS qty FROM lineitem)")

# ---- alerts, enrichment, replay -----------------------------------------------------------------------------------

ALERT_RULE = rule(_one("event.code", "error"), "al", status="test", level="high", tags=["b", "a", "b"], fields=["user.name", "rare", "absent"])


def alert_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = build_alerts(matches(spark, sf_dir, ALERT_RULE), payload=None, clock=False)
    return a.select("alert_uid", "rule_id", "rule_name", "rule_status", "rule_level", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("fields"))


def alerts_of_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    detection = {"s": {"event.code": "error"}, "condition": "s | count() by user.name > 3", "timeframe": "3d"}
    a = detect(events_frame(spark, sf_dir), compile_rule(rule(detection, "th", fields=["user.name"])), RESOLVE, payload="props", clock=False)
    return a.select("alert_uid", "rule_status", F.col("fields")["user.name"].alias("usr"), "agg_value")


QUERIES |= {"alert_projection": alert_projection, "alerts_of_thresholds": alerts_of_thresholds}
ORACLES["alert_projection"] = f"""WITH {EVENTS} SELECT sha256('al#0|' || event_id) AS alert_uid, 'al' AS rule_id, 'rule al' AS rule_name, 'test' AS rule_status, 'high' AS rule_level, 'b,a' AS tags,
  CASE WHEN rare IS NULL THEN '' ELSE 'rare=' || rare || ',' END || 'user.name=' || usr AS fields FROM e WHERE code = 'error'"""
ORACLES["alerts_of_thresholds"] = f"SELECT sha256('th#0|' || event_id) AS alert_uid, 'experimental' AS rule_status, 'u' || user_id AS usr, agg_value FROM ({ORACLES['agg_count_by'].partition('  --')[0]}) JOIN events USING (event_id)"

INTEL_MAP = {"source.ip": {"tor": [{"mispAttribute": "ip-src", "type": "ip", "enrichPublicOnly": True}], "c2": [{"mispAttribute": "ip-dst", "type": "ip", "enrichPublicOnly": False}]}, "dns.name": {"c2d": [{"mispAttribute": "domain", "type": "domain", "resolveName": True}, {"mispAttribute": "x", "type": "domain"}]}}


def _asked(spark: SparkSession, e: DataFrame) -> DataFrame:
    return enrich.requests(e, enrich.attributes_frame(spark, INTEL_MAP), list(INTEL_MAP), RESOLVE)


def _enriched(spark: SparkSession, e: DataFrame, intel: DataFrame | None = None, dns: DataFrame | None = None, **more) -> DataFrame:
    return enrich.enrich_values(e, enrich.attributes_frame(spark, INTEL_MAP), list(INTEL_MAP), RESOLVE, intel, dns, **more)


def _intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table made of customers: one address or name each."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    tag = F.when(k % 3 == 0, "tor").when(k % 3 == 1, "c2").otherwise("c2d")
    value = F.when(k % 3 == 2, F.concat(F.lit("host"), k % 20, F.lit(".example"))).otherwise(F.concat(F.when(k % 2 == 0, "203.0.113.").otherwise("172.16.0."), k % 250))
    return c.select(tag.alias("tag"), F.when(tag == "tor", "ip-src").when(tag == "c2", "ip-dst").otherwise("domain").alias("attr_type"), value.alias("value"), k.cast("string").alias("event_id"), F.col("c_mktsegment").alias("category"), F.array(F.concat(F.lit("n"), F.col("c_nationkey")), F.lit("t")).alias("attr_tags"))


def enrich_public_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, events_frame(spark, sf_dir)).groupBy("field", "tag", "value").agg(F.count("*").alias("n"))


def enrich_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_frame(spark, sf_dir)
    names = ("intel_event_id", "intel_attribute_category", "intel_attribute_tags")
    return _enriched(spark, e, _intel(spark, sf_dir), text=lambda c: F.array_join(c, ",")).select("event_id", *names)


def enrich_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_frame(spark, sf_dir)
    dns = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("host"), F.col("n_nationkey"), F.lit(".example")).alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.array(F.concat(F.lit("192.0.2."), F.col("n_nationkey")))).otherwise(F.array().cast("array<string>")).alias("addresses"))
    return _enriched(spark, e, dns=dns).select("event_id", F.array_join("dns_resolved_address", ",").alias("address"))


def enriched_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules may also be held against enriched events."""
    e = events_frame(spark, sf_dir)
    rich = _enriched(spark, e, _intel(spark, sf_dir))
    resolve = column_resolver(COLUMNS | {"intel.category": "array_join(intel_attribute_category, ' ')"})
    r = compile_rule(rule({"s": {"event.code": "error", "intel.category|contains": "BUILDING"}, "condition": "s"}))
    return match_rules(rich, r, resolve).select(F.col("event_uid").alias("event_id"))


def replay_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = replay(events_frame(spark, sf_dir), "2024-01-05", "2024-01-12")
    return match_rules(past, compile_rule(rule(_one("event.code", "error"))), RESOLVE).select(F.col("event_uid").alias("event_id"))


QUERIES |= {"enrich_public_ip": enrich_public_ip, "enrich_intel": enrich_intel, "enrich_dns": enrich_dns, "enriched_then_match": enriched_then_match, "replay_by_date": replay_by_date}
_ASKED = "q AS (SELECT event_id, 'source.ip' AS field, src AS value, 'tor' AS tag, 'ip-src' AS kind FROM e WHERE NOT starts_with(src, '172.16.') UNION ALL SELECT event_id, 'source.ip', src, 'c2', 'ip-dst' FROM e UNION ALL SELECT event_id, 'dns.name', dns, 'c2d', 'domain' FROM e)"
_INTEL = """i AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'tor' WHEN 1 THEN 'c2' ELSE 'c2d' END AS tag, CAST(c_custkey AS VARCHAR) AS eid, c_mktsegment AS category, 'n' || c_nationkey AS t,
  CASE WHEN c_custkey % 3 = 2 THEN 'host' || (c_custkey % 20) || '.example' WHEN c_custkey % 2 = 0 THEN '203.0.113.' || (c_custkey % 250) ELSE '172.16.0.' || (c_custkey % 250) END AS value FROM customer)"""
_HITS = """h AS (SELECT event_id, string_agg(eid, ',' ORDER BY eid) AS ids, list_sort(list_distinct(list(category))) AS cats, list_sort(list_distinct(flatten(list([t, 't'])))) AS tags FROM q JOIN i USING (tag, value) GROUP BY event_id)"""
ORACLES["enrich_public_ip"] = f"WITH {EVENTS}, {_ASKED} SELECT field, tag, value, count(*) AS n FROM q GROUP BY ALL"
ORACLES["enrich_intel"] = f"WITH {EVENTS}, {_ASKED}, {_INTEL}, {_HITS} SELECT event_id, ids AS intel_event_id, array_to_string(cats, ',') AS intel_attribute_category, array_to_string(tags, ',') AS intel_attribute_tags FROM e LEFT JOIN h USING (event_id)"
ORACLES["enrich_dns"] = f"WITH {EVENTS} SELECT event_id, '192.0.2.' || n_nationkey AS address FROM e LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON dns = 'host' || n_nationkey || '.example'"
ORACLES["enriched_then_match"] = f"WITH {EVENTS}, {_ASKED}, {_INTEL}, {_HITS} SELECT event_id FROM e JOIN h USING (event_id) WHERE code = 'error' AND list_contains(cats, 'BUILDING')"
ORACLES["replay_by_date"] = f"WITH {EVENTS} SELECT event_id FROM e WHERE code = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"


def keyword_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and wildcard rules over document texts and page addresses."""
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("product"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("event_uid"), F.col("text").alias("message"), F.lit(None).cast("string").alias("url"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), "page_id").alias("event_uid"), F.lit(None).cast("string").alias("message"), "url")
    rules = compile_rule(rule({"keywords": ["token = ", "password"], "url": {"url": "https*/*1*"}, "condition": "1 of them"}))
    return match_rules(d.unionByName(p).withColumn("logsource", none), rules, column_resolver({"message": "message", "url": "url"})).select(F.col("event_uid").alias("event_id"))


QUERIES["keyword_documents"] = keyword_documents
ORACLES["keyword_documents"] = "SELECT 'd' || doc_id AS event_id FROM documents WHERE contains(text, 'token = ') OR contains(text, 'password') UNION ALL SELECT 'p' || page_id FROM pages WHERE regexp_full_match(url, 'https(?s:.*)/(?s:.*)1(?s:.*)')"

# ---- events as JSON text --------------------------------------------------------------------------------------------


def _json_text(k: str, created: str) -> str:
    """An event as JSON, or a line that is none, in words that both engines read: a number that may be a number, a string or inside an array, and a
    field that may be null or missing."""
    return f"""CASE event_id % 50 WHEN 0 THEN '{{"broken' WHEN 1 THEN '[1, 2]' ELSE concat('{{"event":{{"created":"', {created}, '","code":"', event_type, '"}},"logsource":{{"product":"',
  CASE WHEN user_id % 2 = 0 THEN 'windows' ELSE 'linux' END, '","service":"s"}},"user":{{"name":"u', user_id, '"}},"client":{{"bytes":', CAST(floor(value) AS BIGINT), '}},"port":',
  CASE CAST({k} AS INT) % 3 WHEN 0 THEN {k} WHEN 1 THEN concat('"', {k}, '"') ELSE concat('[', {k}, ']') END,
  CASE {k} WHEN '9' THEN ',"rare":null' WHEN '8' THEN '' ELSE concat(',"rare":"', {k}, '"') END, '}}') END"""


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_json_text("get_json_object(props, '$.k')", created)).alias("value"))


_TEXT = f"""t AS (SELECT event_id, json_extract_string(props, '$.k') AS k, 'u' || user_id AS usr, user_id, event_type AS code, CAST(floor(value) AS BIGINT) AS bytes,
  {_json_text("json_extract_string(props, '$.k')", "strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z'")} AS text FROM events),
j AS (SELECT *, CASE WHEN CAST(k AS INT) % 3 < 2 THEN k END AS port, CASE WHEN k NOT IN ('8', '9') THEN k END AS rare FROM t WHERE event_id % 50 > 1)"""


def _json_search(name: str, rules: dict[str, tuple[dict, str]]) -> None:
    """Which events which of the rules (by id: rule, where) match; events are told by the hash of their text."""
    compiled = [c for i, (r, _) in rules.items() for c in compile_rule(r | {"id": i})]
    QUERIES[name] = lambda spark, sf_dir: match_rules(parse_events(json_lines(spark, sf_dir)).where("v is not null"), compiled, variant_resolver()).select("event_uid", "ruleid")
    ORACLES[name] = f"WITH {_TEXT} " + " UNION ALL ".join(f"SELECT sha256(text) AS event_uid, '{i}' AS ruleid FROM j WHERE {where}" for i, (_, where) in rules.items())


def _leaf(field: str, value, condition: str = "s", **more) -> dict:
    return {"detection": _one(field, value, condition)} | more


_json_search("json_leaves", {
    "number": (_leaf("port", 7), "port = '7'"), "numbers": (_leaf("port", [3, "4", 5]), "port IN ('3', '4')"), "start": (_leaf("port|startswith", 1), "starts_with(port, '1')"),
    "other": (_leaf("port", 3, "not s"), "port IS DISTINCT FROM '3'"), "bytes": (_leaf("client.bytes", 12), "bytes = 12"), "name": (_leaf("user.name|contains|all", ["1", "2"]), "contains(usr, '1') AND contains(usr, '2')"),
    "object": (_leaf("user", "*"), "false"), "linux": (_leaf("event.code", "err*", logsource={"product": "linux", "service": "other"}), "code = 'error' AND user_id % 2 = 1"),
})
_json_search("json_null_vs_missing", {
    "null": (_leaf("rare", None), "rare IS NULL"), "some": (_leaf("rare", "*"), "rare IS NOT NULL"), "either": (_leaf("rare", [None, 3]), "rare IS NULL OR rare = '3'"), "array": (_leaf("port", None), "false"),
    "no_array": (_leaf("port", None, "not s"), "true"), "absent": (_leaf("no.such.path", None), "true"), "text": (_leaf("rare", "null"), "false"),
})


def json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine(parse_events(json_lines(spark, sf_dir))).groupBy("raw").agg(F.count("*").alias("n"))


def json_alert_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of JSON text carry the text and those of the rule's fields that it has."""
    r = compile_rule(_leaf("event.code", "error", id="ja", status="stable", fields=["user.name", "rare", "port", "absent"]))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return run_batch(json_lines(spark, sf_dir), r, clock=False).select("alert_uid", "rule_id", "rule_status", fields.alias("fields"), "rule_event")


def json_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of rules over JSON text in one run."""
    rules = compile_rule({"id": "js", "detection": {"s": {"event.code": "purchase"}, "condition": "s | sum(client.bytes) by user.name > 100", "timeframe": "4d"}}) + compile_rule(_leaf("port", 7, id="plain"))
    return run_batch(json_lines(spark, sf_dir), rules, clock=False).select("alert_uid", "rule_id", "agg_value")


QUERIES |= {"json_quarantine": json_quarantine, "json_alert_event": json_alert_event, "json_threshold": json_threshold}
ORACLES["json_quarantine"] = f"WITH {_TEXT} SELECT text AS raw, count(*) AS n FROM t WHERE event_id % 50 < 2 GROUP BY text"
ORACLES["json_alert_event"] = f"""WITH {_TEXT} SELECT sha256('ja#0|' || sha256(text)) AS alert_uid, 'ja' AS rule_id, 'stable' AS rule_status,
  concat(CASE WHEN port IS NOT NULL THEN 'port=' || port || ',' END, CASE WHEN rare IS NOT NULL THEN 'rare=' || rare || ',' END, 'user.name=', usr) AS fields, text AS rule_event FROM j WHERE code = 'error'"""
ORACLES["json_threshold"] = f"""WITH {_TEXT}, f AS ({_threshold_sql("code = 'purchase' AND event_id % 50 > 1", "usr", "bytes", "sum", ">", 100, 345600).partition('  --')[0]})
SELECT sha256('js#0|' || sha256(text)) AS alert_uid, 'js' AS rule_id, agg_value FROM f JOIN t USING (event_id) UNION ALL SELECT sha256('plain#0|' || sha256(text)), 'plain', NULL FROM j WHERE port = '7'"""
