"""Alerts: a projection of matches with an id that a replay repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.plans.rules import CompiledRule


def utc_text(at: Column) -> Column:
    """A timestamp in ISO form with milliseconds, in UTC whatever the session's zone."""
    ms = F.unix_millis(at)
    whole = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms - F.pmod(ms, F.lit(1000))) / 1000)
    return F.concat(F.translate(F.substring(whole.cast("string"), 1, 19), " ", "T"), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


def event_fields(matches: DataFrame) -> Column:
    """Those of the rule's fields that the event has, by path."""
    names = [f.name for f in matches.schema["f"].dataType.fields if not f.name.endswith("#nested") and f.name != "none"]
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col("f")[n] for n in names])) if names else F.create_map().cast("map<string,string>")
    return F.map_filter(every, lambda k, v: v.isNotNull() & F.array_contains("useful", k))


def build_alerts(matches: DataFrame, payload: str | None = "raw", clock: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """alert_uid, rule_id, rule_name, rule_status, rule_level, tags, fields (those of the rule that the event has), rule_event.

    alert_uid is the SHA-256 of rule key and event id, so writing an alert twice is the same as once. matches needs `fields`, or `f` to make
    them of, and, if named, the payload column. keep: further columns of matches that go along.
    """
    fields = F.col("fields") if "fields" in matches.columns else event_fields(matches)
    out = matches.select(
        F.sha2(F.concat_ws("|", "rule_key", F.col("event_uid").cast("string")), 256).alias("alert_uid"), F.col("ruleid").alias("rule_id"), "condition_idx", "rule_name", "rule_status", "rule_level",
        "tags", fields.alias("fields"), *([F.col(payload).cast("string").alias("rule_event")] if payload else []), *(["agg_value"] if "agg_value" in matches.columns else []), *keep,
    )
    return out.withColumn("alert_processing_time", utc_text(F.current_timestamp())) if clock else out


def with_rule_details(alerts: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """alerts with what their rule says of itself: rule_description, rule_author, rule_references, rule_falsepositives. Those of rules that are gone have nulls."""
    rows = {r.ruleid: (r.ruleid, r.description, r.author, list(r.references), list(r.falsepositives)) for r in rules}
    schema = "rule_id string, rule_description string, rule_author string, rule_references array<string>, rule_falsepositives array<string>"
    return alerts.join(F.broadcast(alerts.sparkSession.createDataFrame(list(rows.values()), schema)), "rule_id", "left")  # of the rule set's size
