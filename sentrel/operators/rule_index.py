"""Matching of large rule sets through an inverted index of rules.

Every rule is filed under tests of which one must hold wherever the rule does: a value that a field equals, or a text that a field
contains, starts or ends with. Of the choices that a rule offers, the one that fewest rules share is taken. Texts are filed by one of their
parts of at most GRAM characters. An event is exploded to its own keys (the values of indexed fields and their parts), which meet the index in
a broadcast join, so the work for an event follows the rules that it might meet, not the number of all rules.

A candidate is decided by the rule's program: its tests and connectives in postfix order, as an array that one SQL expression runs over a
stack of bits. The expression is the same for any number of rules. Rules that offer no key (only negations, nulls or patterns) are
evaluated in the projection, as all rules are by `match_rules`, and join the others by a key of their own.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.predicates import Leaf
from sentrel.plans.conditions import Tree
from sentrel.plans.rules import CompiledRule

from .events import Resolver, project_fields
from .matching import here_of, match_rules, rules_frame

GRAM = 4
#: Rules from which `match` goes through the index: there both ways cost alike.
INDEXED_RULES = 100
AND, OR, NOT, TRUE, FALSE = "and", "or", "not", "true", "false"
#: (length of the part, 0 for whole values; path; in lower case; text)
Key = tuple[int, str, bool, str]
_INDEX = "rule_key_text string, rule_no int, rule_logsource struct<category:string,product:string>, rule_program array<struct<op:string,at:int,text:string,fold:boolean>>, rule_agg_at int, rule_group_at int, rule_earlier array<string>"
DEEPEST = 60  # of a program's stack, which is a long


def choices(tree: Tree) -> list[list[list[Key]]]:
    """Ways to file a tree. Each is a list of tests of which one must hold, each as the parts of it that could stand for it; empty: there is none."""
    if isinstance(tree, Leaf):
        if tree.kind == "equals":
            return [[[(0, tree.path, tree.fold, tree.text)]]]
        if tree.kind in ("contains", "starts", "ends") and tree.text:
            n = min(GRAM, len(tree.text))
            return [[[(n, tree.path, tree.fold, tree.text[i : i + n]) for i in range(len(tree.text) - n + 1)]]]
        return []
    word, parts = tree
    if word == "and":
        return [c for p in parts for c in choices(p)]
    if word == "or":
        each = [choices(p) for p in parts]
        if len(each) == 1:
            return each[0]
        # of every part the choice of fewest tests; one part without any leaves the whole without
        return [[t for c in each for t in min(c, key=len)]] if each and all(each) else []
    return []


def file_rules(rules: list[CompiledRule]) -> tuple[list[list[Key]], list[int]]:
    """For each rule the keys that it is filed under, and the rules without any."""
    offers = [choices(r.tree) for r in rules]
    shared = Counter(k for o in offers for k in {k for c in o for t in c for k in t})
    # parts of equal rank: the longer one, then by itself so that the choice is settled
    rank = lambda k: (shared[k], k[0] != 0, -len(k[3]), k)
    best = lambda c: sorted({min(t, key=rank) for t in c})
    filed = [min((best(c) for c in o), key=lambda ks: (sum(shared[k] for k in ks), ks), default=[]) for o in offers]
    return filed, [i for i, ks in enumerate(filed) if not ks]


def program(tree: Tree, at: dict[str, int]) -> list[tuple[str, int, str, bool]]:
    """Postfix form of a tree: tests by the place of their field, and connectives of two (of one for not)."""
    if isinstance(tree, Leaf):
        return [(tree.kind, at[tree.path], tree.text, tree.fold)]
    word, parts = tree
    if word == "not":
        return [*program(parts[0], at), (NOT, 0, "", False)]
    if not parts:
        return [(TRUE if word == "and" else FALSE, 0, "", False)]
    out = program(parts[0], at)
    for p in parts[1:]:
        out += [*program(p, at), (word, 0, "", False)]
    return out


def depth(steps: list[tuple[str, int, str, bool]]) -> int:
    now = most = 0
    for op, *_ in steps:
        now += 0 if op == NOT else -1 if op in (AND, OR) else 1
        most = max(most, now)
    return most


def runs(values: str, nested: str, steps: str) -> Column:
    """The program over the fields' values (an array of strings) and whether each holds an array or object. The stack is a long, its top the last bit."""
    v = f"CASE WHEN t.fold THEN lower({values}[t.at]) ELSE {values}[t.at] END"
    test = f"""CASE t.op WHEN 'equals' THEN {v} = t.text WHEN 'contains' THEN contains({v}, t.text) WHEN 'starts' THEN startswith({v}, t.text)
      WHEN 'ends' THEN endswith({v}, t.text) WHEN 'regex' THEN {v} RLIKE t.text WHEN 'present' THEN {values}[t.at] IS NOT NULL
      WHEN 'null' THEN {values}[t.at] IS NULL AND NOT coalesce({nested}[t.at], false) WHEN 'true' THEN true ELSE false END"""
    step = f"""CASE t.op WHEN 'and' THEN shiftleft(shiftright(s, 2), 1) | (s & shiftright(s, 1) & 1) WHEN 'or' THEN shiftleft(shiftright(s, 2), 1) | ((s | shiftright(s, 1)) & 1)
      WHEN 'not' THEN s ^ 1 ELSE shiftleft(s, 1) | CASE WHEN {test} THEN 1L ELSE 0L END END"""
    return F.expr(f"aggregate({steps}, 0L, (s, t) -> {step}) = 1")


def _prefix(k: Key, at: dict[str, int]) -> str:
    """What stands before the text of a key: one string makes sets of keys and the join cheap."""
    return f"{k[0]}{'i' if k[2] else ''}.{at[k[1]]}."


def _keys(filed: list[list[Key]], at: dict[str, int]) -> Column:
    """An event's own keys that the index has, each once: what it lacks isn't exploded."""
    known = sorted({_prefix(k, at) + k[3] for ks in filed for k in ks})
    parts = []
    for n, path, fold in sorted({k[:3] for ks in filed for k in ks}):
        value = f"lower(`values`[{at[path]}])" if fold else f"`values`[{at[path]}]"
        one = lambda text, p=_prefix((n, path, fold, ""), at): f"concat('{p}', {text})"
        grams = f"transform(sequence(1, length({value}) - {n - 1}), i -> {one(f'substring({value}, i, {n})')})"
        parts.append(f"CASE WHEN length({value}) >= {n} THEN {grams} END" if n else f"CASE WHEN {value} IS NOT NULL THEN array({one(value)}) END")
    none = "CAST(array() AS array<string>)"
    own = F.expr(f"flatten(array({', '.join(f'coalesce({p}, {none})' for p in parts) or none}))")
    return F.array_distinct(F.filter(own, lambda k: k.isin(known)))


def match_rules_indexed(events: DataFrame, rules: list[CompiledRule], resolve: Resolver) -> DataFrame:
    """The rows and columns of `match_rules`, made through the index. Each event and rule that it meets comes once.

    What is broadcast has the size of the rule set. A rule whose program needs a stack of more than DEEPEST bits is evaluated in the projection.
    """
    filed, bare = file_rules(rules)
    places = sorted({p for r in rules for p in (*r.paths, *r.useful)})
    at = {p: i for i, p in enumerate(places)}
    programs = [program(r.tree, at) for r in rules]
    for i, steps in enumerate(programs):
        if filed[i] and depth(steps) > DEEPEST:
            filed[i] = []
            bare.append(i)
    nulls = {p for r in rules for p in r.null_paths}
    own = project_fields(events, places, resolve, nulls)
    own = own.withColumn("values", F.array(*[F.col("f")[p] for p in places]).cast("array<string>"))
    own = own.withColumn("nested", F.array(*[F.col("f")[p + "#nested"] if p in nulls else F.lit(False) for p in places]).cast("array<boolean>"))
    keys = own.withColumn("keys", _keys(filed, at))
    kept = F.col("keys")
    if bare:
        found = [F.when(here_of(rules[i]) & F.expr(rules[i].predicate), F.lit(f"rule.{i}")) for i in sorted(bare)]
        kept = F.concat("keys", F.filter(F.array(*found), lambda x: x.isNotNull()))

    rows = []
    for i, r in enumerate(rules):
        agg, group = (at[p] if p else None for p in (r.agg_path, r.group_path))
        own_keys = [_prefix(k, at) + k[3] for k in filed[i]]
        if not filed[i]:
            rows.append((f"rule.{i}", i, (None, None), [(TRUE, 0, "", False)], agg, group, []))
        rows += [(k, i, (r.category, r.product), programs[i], agg, group, own_keys[:j]) for j, k in enumerate(own_keys)]
    index = F.broadcast(events.sparkSession.createDataFrame(rows, _INDEX))
    near = keys.withColumn("rule_key_text", F.explode(kept)).join(index, "rule_key_text")
    same = lambda part: F.col(f"rule_logsource.{part}").isNull() | (F.col(f"rule_logsource.{part}") == F.col(f"logsource.{part}"))
    # an event that has several of a rule's keys meets it by the first only
    first = ~F.coalesce(F.arrays_overlap("keys", "rule_earlier"), F.lit(False))
    met = near.where(same("category") & same("product") & first).where(runs("`values`", "nested", "rule_program"))
    value = lambda c: F.when(F.col(c).isNotNull(), F.expr(f"`values`[{c}]"))
    met = met.withColumns({"agg_raw": value("rule_agg_at"), "group_value": value("rule_group_at")})
    met = met.drop("values", "nested", "keys", *[c for c in index.columns if c != "rule_no"])
    return met.join(F.broadcast(rules_frame(events.sparkSession, rules)), "rule_no").drop("rule_no")


def match(events: DataFrame, rules: list[CompiledRule], resolve: Resolver) -> DataFrame:
    """`match_rules` or, for many rules, the same through the index."""
    return (match_rules_indexed if len(rules) >= INDEXED_RULES else match_rules)(events, rules, resolve)
