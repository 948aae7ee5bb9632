"""Rules with `near`: a match counts if events that meet other selections of the rule are close to it in time.

The matches of such a rule's terms are summed up by key and time, in buckets as long as the rule's timeframe: of each bucket the first and the
last time. An event's neighbours are then in its own bucket, all of which is near, or in the one before or after, of which the last or
first time tells. So the join is one on equal keys and buckets, with a row per bucket, whatever the number of events in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.predicates import Leaf
from sentrel.plans.conditions import Tree
from sentrel.plans.rules import CompiledRule

from .enrich import checked


def _holds(tree: Tree, near: Column) -> Column:
    if isinstance(tree, Leaf):
        return F.array_contains(near, tree.path)
    word, parts = tree
    each = [_holds(p, near) for p in parts]
    if word == "not":
        return ~each[0]
    out = F.lit(word == "and")
    for x in each:
        out = out & x if word == "and" else out | x
    return out


def near_matches(matches: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """matches (event_uid, created, rule_key, group_value and any others) without those of `near` terms, and of the rules with `near` those only
    whose condition on the terms holds.

    Near is at most the rule's timeframe before or after, by created, and of the same value of the rule's group if it has one. An event may be its own
    neighbour. Matches without created, or without the group that their rule needs, have no neighbours and are none. Matches of other
    rules pass as they are. matches is read three times: write it first, unless it is cheap.
    """
    anchors = {r.key: r for r in rules if r.near}
    if not anchors:
        return matches
    spark = matches.sparkSession
    terms = [(r.key, r.term_of, r.key[len(r.term_of) + 1 :], 1000 * max(0, anchors[r.term_of].near.within), bool(r.group_path)) for r in rules if r.term_of]
    wide = lambda ms: F.greatest(ms, F.lit(1))
    known = F.broadcast(spark.createDataFrame(terms, "rule_key string, of string, term string, within long, grouped boolean"))  # as many as the rules have terms
    ms, group = F.unix_millis(F.col("created").cast("timestamp")), F.when(F.col("grouped"), F.col("group_value")).otherwise("")
    seen = matches.select("rule_key", "created", "group_value").join(known, "rule_key")
    seen = seen.select("of", "term", "within", group.alias("near_group"), ms.alias("ms")).where("ms is not null and near_group is not null")
    spans = seen.groupBy("of", "term", "within", "near_group", F.floor(F.col("ms") / wide(F.col("within"))).cast("long").alias("b")).agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    told = spans.select("of", "near_group", "term", F.explode(F.expr("array(struct(b AS at, NULL AS before, NULL AS after, true AS same), struct(b + 1 AS at, last AS before, NULL AS after, false AS same), struct(b - 1 AS at, NULL AS before, first AS after, false AS same))")).alias("x"))
    told = told.groupBy("of", "near_group", F.col("x.at").alias("at"), "term").agg(F.max("x.before").alias("before"), F.min("x.after").alias("after"), F.max("x.same").alias("same"))
    told = told.groupBy("of", "near_group", "at").agg(F.collect_list(F.struct("term", "before", "after", "same")).alias("around"))  # a row per term of the rule at most

    own = F.broadcast(spark.createDataFrame([(k, 1000 * max(0, r.near.within), bool(r.group_path)) for k, r in anchors.items()], "rule_key string, within long, grouped boolean"))
    some = matches.join(own, "rule_key").withColumns({"near_group": group, "ms": ms})
    some = some.withColumn("at", F.floor(F.col("ms") / wide(F.col("within"))).cast("long"))
    met = some.where("ms is not null and near_group is not null").join(checked(told).withColumnRenamed("of", "rule_key"), ["rule_key", "near_group", "at"], "left")
    close = F.filter("around", lambda x: x["same"] | F.coalesce(F.col("ms") - x["before"] <= F.col("within"), F.lit(False)) | F.coalesce(x["after"] - F.col("ms") <= F.col("within"), F.lit(False)))
    near = F.coalesce(F.transform(close, lambda x: x["term"]), F.array().cast("array<string>"))
    holds = F.lit(False)
    for k, r in anchors.items():
        holds = F.when(F.col("rule_key") == k, _holds(r.near.tree, F.col("near_terms"))).otherwise(holds)
    kept = met.withColumn("near_terms", near).where(holds).select(*matches.columns)
    others = matches.where(~F.col("rule_key").isin([*anchors, *[t[0] for t in terms]]))
    return others.unionByName(kept)
