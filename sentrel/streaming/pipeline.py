"""The whole job, on past and on live events."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrel.operators import enrich
from sentrel.operators.alerts import build_alerts, event_fields, utc_text, with_rule_details
from sentrel.operators.events import Resolver, parse_events, rejected, variant_resolver, with_columns
from sentrel.operators.near import near_matches
from sentrel.operators.rule_index import match
from sentrel.operators.thresholds import fired, threshold_matches
from sentrel.plans.rules import CompiledRule, RuleSet, load_rules
from sentrel.scratch import Scratch, settings
from sentrel.sources.config import Config
from sentrel.sources.readers import event_source
from sentrel.sources.sinks import Sink, append_events, to_format, upsert_alerts, write_once

from .thresholds import ROCKSDB, fired_stream

log = logging.getLogger(__name__)

#: Columns of a match that a threshold or an alert needs; `fields` holds the rule's useful fields by then.
_KEY = "event_uid string, created timestamp, rule_key string"
_THRESHOLD = "agg_fn string, agg_field boolean, agg_by boolean, agg_raw string, group_value string, op string, threshold long, timeframe_sec long"
_ALERT = "ruleid string, condition_idx int, rule_name string, rule_status string, rule_level string, tags array<string>, fields map<string,string>, raw string, event_day string"
MATCH_ROW = f"{_KEY}, {_THRESHOLD}, {_ALERT}"
_names = lambda ddl: [x.strip().partition(" ")[0] for x in ddl.replace("map<string,string>", "map").split(",")]


def match_rows(events: DataFrame, rules: list[CompiledRule], resolve: Resolver, payload: str = "raw") -> DataFrame:
    """Matches with what a threshold or an alert needs of them, and no more."""
    found = match(events, rules, resolve)
    day = F.substring(utc_text(F.col("created")), 1, 10)
    return found.withColumns({"fields": event_fields(found), "raw": F.col(payload).cast("string"), "event_day": day}).select(*_names(MATCH_ROW))


def detect(events: DataFrame, rules: list[CompiledRule], resolve: Resolver | None = None, payload: str = "raw", clock: bool = True, reopen_on_expiry: bool = False) -> DataFrame:
    """Alerts of a batch of events: match, threshold, project. Events are read and held against the rules once."""
    found = match_rows(events, rules, resolve or variant_resolver(), payload)
    if any(r.near for r in rules):
        found = near_matches(Scratch(events.sparkSession).write(found, "found"), rules)
        rules = [r for r in rules if not r.term_of]
    if not any(r.agg or r.timeframe_sec is not None for r in rules):
        return build_alerts(found.withColumn("agg_value", F.lit(None).cast("long")), "raw", clock)
    if all(r.agg or r.timeframe_sec is not None for r in rules):
        return build_alerts(fired(found, reopen_on_expiry, tuple(_names(_ALERT))), "raw", clock)
    return build_alerts(threshold_matches(Scratch(events.sparkSession).write(found, "found"), reopen_on_expiry), "raw", clock)


def run_batch(raw: DataFrame, rules: list[CompiledRule], clock: bool = True) -> DataFrame:
    """Alerts of raw JSON text."""
    return detect(parse_events(raw).where("v is not null"), rules, clock=clock)


def live_rules(rules: RuleSet) -> list[CompiledRule]:
    """Rules that can be decided from one event and the state of a key. Those with `near` need the events after theirs: `detect` has them."""
    found = rules.compiled()
    for r in found:
        if r.near:
            log.warning("rule %s has `near` and is left out of the live job", r.key)
    return [r for r in found if not r.near and not r.term_of]


#: What a rule may call the columns that an enrichment adds; a list is its values, one behind another with spaces between.
ENRICHED = {f"enriched.{c}": f"array_join({c}, ' ')" for c in ("intel_event_id", "intel_attribute_category", "intel_attribute_tags", "dns_resolved_address")}


def start_matching(raw: DataFrame, rules: RuleSet, match_table: str, checkpoint: str, resolve: Resolver | None = None, trigger: dict | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """First stage: matches of each micro-batch, under the rules of that moment, to a table. Changed rule files count from the next micro-batch on.

    A batch that is tried again after its matches were written leaves them as they are, so the second stage reads each batch once. prepare: what is
    done to the parsed events before rules are held against them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rules.refresh()
        events = parse_events(batch).where("v is not null")
        write_once(match_rows(prepare(events) if prepare else events, live_rules(rules), resolve or variant_resolver()), match_table, batch_id)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_alerting(spark: SparkSession, match_table: str, alert_table: str, checkpoint: str, trigger: dict | None = None, sink: Callable[[str], Sink] | None = None, details: RuleSet | None = None, max_files: int | None = None, reopen_on_expiry: bool = False, forget_after_seconds: int | None = None, event_time: bool = False, delay_seconds: int = 0) -> list[StreamingQuery]:
    """Second stage: matches without aggregation become alerts as they are; the others pass the stateful fold.

    details: rules that alerts are to tell of in full (see `with_rule_details`). max_files: files of the match table that a micro-batch takes at most, so that a backlog is folded over the keyed state bit by bit.
    """
    reader = spark.readStream.schema(MATCH_ROW).option("recursiveFileLookup", "true")
    found = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(match_table)
    when = trigger or {"availableNow": True}
    plain = found.where("agg_fn is null and timeframe_sec is null").withColumn("agg_value", F.lit(None).cast("long"))
    sink = sink or upsert_alerts

    columns = _names(_ALERT)
    carried = found.select(*columns).schema
    hit = fired_stream(found.withColumn("payload", F.to_json(F.struct(*columns))), reopen_on_expiry, forget_after_seconds, event_time, delay_seconds)
    hit = hit.withColumn("p", F.from_json("payload", carried)).select("event_uid", "rule_key", "agg_value", "p.*")

    def start(rows: DataFrame, kind: str) -> StreamingQuery:
        write = sink(f"{alert_table}/{kind}")
        told = lambda alerts: with_rule_details(alerts, details.compiled()) if details else alerts
        return rows.writeStream.foreachBatch(lambda b, i: write(told(build_alerts(b, keep=("event_day",))), i)).option("checkpointLocation", f"{checkpoint}/{kind}").outputMode("append").trigger(**when).start()

    # without new rows a batch would only wait for keys to be idle by the clock, for ever where what is there now is worked on
    idle = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if "availableNow" in when and not event_time else {}
    with settings(spark, ROCKSDB | idle):
        return [start(plain, "plain"), start(hit, "fired")]


Lookup = Callable[[DataFrame], DataFrame | None]


def enriched(events: DataFrame, mapping: dict | None, intel: Lookup, dns: Lookup, resolve: Resolver | None = None, all_columns: bool = False) -> DataFrame:
    """Every event once, with what the lookups say about the values of mapped fields. A lookup gets the requests and gives its table, or None.

    all_columns: those of a lookup without table too, as nulls.
    """
    if not mapping:
        return events
    if all_columns:
        rich = enriched(events, mapping, intel, dns, resolve)
        return rich.withColumns({n: F.lit(None).cast("array<string>") for c in ENRICHED if (n := c.split(".")[1]) not in rich.columns})
    return enrich.enrich_values(events, enrich.attributes_frame(events.sparkSession, mapping), list(mapping), resolve or variant_resolver(), intel, dns)


def start_events(raw: DataFrame, sink: Sink, checkpoint: str, mapping: dict | None = None, intel: Lookup = lambda asked: None, dns: Lookup = lambda asked: None, trigger: dict | None = None, rejected_table: str | None = None) -> StreamingQuery:
    """The event branch: parsed events, enriched if there is a mapping, to the event sink; lines that are no events, with the reason and the column
    `origin` of raw if it has one, to a table of their own. Lookup tables are read anew for each micro-batch.
    """
    keep = tuple(c for c in ("origin",) if c in raw.columns)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the source is read once for both outputs
        try:
            parsed = parse_events(batch, keep=keep)
            sink(enriched(parsed.where("v is not null").drop(*keep), mapping, intel, dns).drop("v"), batch_id)
            if rejected_table:
                write_once(rejected(parsed), rejected_table, batch_id)
        finally:
            batch.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run(spark: SparkSession, c: Config, provider: enrich.Provider | None = None) -> list[StreamingQuery]:
    """Starts what the configuration describes: a source, the event branch with its sink, matching, and alerting with its sink.

    Enrichment needs its flag. It is on the event branch; with `match_enriched` rules see its columns too, as the paths in ENRICHED. Threat intelligence is a
    table, or asked of `provider` through the cache table, within the configured deadline. Lines that are no events go to a table beside the events.
    """
    where = c if c.source == "kafka" else c.source_path
    rules = load_rules(c.rules, maps=c.maps, global_map=json.loads(Path(c.global_map).read_text())["map"] if c.global_map else None)
    table = lambda path: (lambda asked: spark.read.parquet(path) if path else None)
    intel = enrich.cached_intel(spark, c.cache_table, provider, c.cache_ttl_seconds, c.cache_buckets, enrich.Limits(c.lookup_timeout_ms / 1000, c.lookup_threads, c.lookup_retries, c.lookup_values)) if provider else table(c.intel_table)
    when = {"processingTime": c.trigger} if c.trigger else {"availableNow": True}
    mapping = json.loads(Path(c.intel_map).read_text()) if c.enrichment and c.intel_map else None
    events = append_events(c.event_table, c.event_index, c.flush_rows) if c.sink == "parquet" else to_format(c.sink, c.sink_options, c.event_index)
    alerts = (lambda path: upsert_alerts(path, c.alert_index, c.flush_rows)) if c.sink == "parquet" else (lambda path: to_format(c.sink, c.sink_options, c.alert_index, status=True))
    source = lambda origin=False: event_source(spark, c.source, where, streaming=True, origin=origin)
    enrich_first = c.match_enriched and mapping
    prepare = (lambda events: enriched(events, mapping, intel, table(c.dns_table), all_columns=True)) if enrich_first else None
    resolve = with_columns(variant_resolver(), ENRICHED) if enrich_first else None
    matching = start_matching(source(), rules, c.match_table, f"{c.checkpoint}/matching", resolve, when, prepare)
    if not c.trigger:  # what is there now: matches first, then their alerts
        matching.awaitTermination()
    return [
        start_events(source(True), events, f"{c.checkpoint}/events", mapping, intel, table(c.dns_table), when, c.rejected_table or f"{c.event_table}_rejected"),
        matching,
        *start_alerting(spark, c.match_table, c.alert_table, f"{c.checkpoint}/alerting", when, alerts, rules if c.alert_details else None, c.max_files or None, c.reopen_on_expiry, c.forget_after_seconds or None, c.event_time, c.delay_seconds),
    ]
