"""Matching: all rules of a snapshot in one projection, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.predicates import field_sql
from sentrel.plans.rules import CompiledRule

from .events import Resolver, project_fields

MATCH = "struct<rule_no:int,agg_raw:string,group_value:string>"
#: Rules up to which an event is first held against all of them in a filter, which Catalyst pushes to the source.
PUSHED_RULES = 16
META = "rule_no int, rule_key string, ruleid string, condition_idx int, rule_name string, rule_status string, rule_level string, tags array<string>, useful array<string>, agg_fn string, agg_field boolean, agg_by boolean, op string, threshold long, timeframe_sec long"


def rules_frame(spark, rules: list[CompiledRule]) -> DataFrame:
    """Metadata of the rules, one row each; its size is that of the rule set, never of the data."""
    rows = [(i, r.key, r.ruleid, r.condition_idx, r.title, r.status, r.level, list(r.tags), list(r.useful), r.agg.fn if r.agg else None, bool(r.agg and r.agg.field), bool(r.agg and r.agg.group), r.agg.op if r.agg else None, r.agg.threshold if r.agg else None, r.timeframe_sec) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, META)


def hit_of(i: int, r: CompiledRule) -> Column:
    """The match of an event with rule i, or null."""
    ref = lambda path: F.expr(field_sql(path)) if path else F.lit(None).cast("string")
    return F.when(F.expr(r.predicate), F.struct(F.lit(i).alias("rule_no"), ref(r.agg_path).alias("agg_raw"), ref(r.group_path).alias("group_value")))


def here_of(r: CompiledRule) -> Column:
    """Whether an event is of the rule's log source."""
    here = F.lit(True)
    for name, value in (("category", r.category), ("product", r.product)):
        if value is not None:
            here = here & (F.col("logsource")[name] == value)
    return here


def match_rules(events: DataFrame, rules: list[CompiledRule], resolve: Resolver) -> DataFrame:
    """One row per event and rule that it meets: the event's columns, `f`, and the rule's metadata.

    events needs logsource (struct of category, product). Rules are grouped by log source, so an event is only held against the rules
    of its own ones; parts that a rule doesn't name, and any `service`, don't matter.
    """
    paths = {p for r in rules for p in (*r.paths, *r.useful)}
    own = project_fields(events, paths, resolve, {p for r in rules for p in r.null_paths})
    by_source: dict[tuple, list] = {}
    for i, r in enumerate(rules):
        by_source.setdefault((r.category, r.product), []).append((i, r))
    groups, some_rule, none = [], F.lit(False), F.array().cast(f"array<{MATCH}>")
    for some in by_source.values():
        here = here_of(some[0][1])
        groups.append(F.when(here, F.array(*[hit_of(i, r) for i, r in some])).otherwise(none))
        some_rule = some_rule | (here & reduce(or_, [F.expr(r.prefilter) for _, r in some]))
    if 0 < len(rules) <= PUSHED_RULES:
        own = own.where(some_rule)
    hits = F.filter(F.flatten(F.array(*groups)), lambda h: h.isNotNull()) if groups else none
    found = own.withColumn("hit", F.explode(hits)).select("*", "hit.*").drop("hit")
    return found.join(F.broadcast(rules_frame(events.sparkSession, rules)), "rule_no").drop("rule_no")
