"""Conditions: the boolean part becomes SQL by putting each selection's SQL in its place; Spark's own parser reads it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from sentrel.functions.predicates import Leaf

FUNCTIONS = ("uniquecount", "count", "min", "max", "avg", "sum")
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "M": 30 * 86400, "y": 365 * 86400}
_TOKEN = re.compile(r"[()]|[^\s()]+")
_AGG = re.compile(rf"(?i)({'|'.join(FUNCTIONS)})\s*(?:\(\s*([^()\s]*)\s*\))?\s*(?:\bby\s+(\S+?))?\s*(<=|>=|==|=|<|>)\s*(-?\d+)")


#: A test, or (and | or | not, parts): no parts are true for `and` and false for `or`.
Tree = Leaf | tuple[str, list]


class ConditionError(ValueError):
    pass


class UnsupportedAggregation(ConditionError):
    pass


@dataclass(frozen=True)
class AggSpec:
    fn: str
    field: str | None
    group: str | None
    op: str
    threshold: int


@dataclass(frozen=True)
class Near:
    """What must be near an event: `terms` are selections, `tree` says which of them must have an event within `within` seconds before or after."""

    terms: tuple[str, ...]
    tree: Tree
    within: int
    group: str | None


def _parts(text: str, names: list[str]) -> Iterator[tuple[str, list[str]]]:
    """`text` as words: (, ), and, or, not; any or all, with the selections meant."""
    tokens, i = _TOKEN.findall(text), 0
    if not tokens:
        raise ConditionError("empty condition")
    while i < len(tokens):
        t = tokens[i]
        low = t.lower()
        if t in "()" or low in ("and", "or", "not"):
            yield low, []
            i += 1
        elif low in ("1", "any", "all") and i + 2 < len(tokens) and tokens[i + 1].lower() == "of":
            of = tokens[i + 2]
            found = list(names) if of.lower() == "them" else [n for n in names if fnmatchcase(n, of)]
            if not found:
                raise ConditionError(f"no selection is named {of}")
            yield "all" if low == "all" else "any", found
            i += 3
        elif t in names:
            yield "one", [t]
            i += 1
        else:
            raise ConditionError(f"unknown selection {t}")


def condition_sql(text: str, selections: dict[str, str]) -> str:
    """`text` without its aggregation. Keywords are whole words in either case; quantifiers are over selection names."""
    out = []
    for word, names in _parts(text, list(selections)):
        if not names:
            out.append(word.upper())
        elif word == "one":
            out.append(f"({selections[names[0]]})")
        else:
            out.append("(" + (" AND " if word == "all" else " OR ").join(f"({selections[n]})" for n in names) + ")")
    return " ".join(out)


def condition_tree(text: str, selections: dict[str, Tree]) -> Tree:
    """The same condition as nested (and | or | not, parts), with the precedence that SQL gives it."""
    words = [*_parts(text, list(selections)), ("end", [])]

    def take() -> str:
        return words.pop(0)[0]

    def chain(word: str, part: Callable[[], Tree]) -> Tree:
        parts = [part()]
        while words[0][0] == word:
            take()
            parts.append(part())
        return (word, parts) if len(parts) > 1 else parts[0]

    def unit() -> Tree:
        word, names = words.pop(0)
        if word == "not":
            return ("not", [unit()])
        if word == "(":
            inner = either()
            if take() != ")":
                raise ConditionError(f"a bracket isn't closed in {text}")
            return inner
        if not names:
            raise ConditionError(f"{word} stands in the wrong place in {text}")
        return ("and" if word == "all" else "or", [selections[n] for n in names])

    def either() -> Tree:
        return chain("or", lambda: chain("and", unit))

    found = either()
    if take() != "end":
        raise ConditionError(f"something is left over in {text}")
    return found


def split_condition(text: str) -> tuple[str, AggSpec | None]:
    """The boolean part, and the aggregation behind `|` if there is one."""
    search, bar, agg = text.partition("|")
    if not bar:
        return search, None
    if not (m := _AGG.fullmatch(agg.strip())):
        raise UnsupportedAggregation(agg.strip())
    fn, field, group, op, value = m.groups()
    return search, AggSpec(fn.lower(), field or None, group, "=" if op == "==" else op, int(value))


_NEAR = re.compile(r"(?is)\s*near\s+(.+?)(?:\s+by\s+(\S+))?(?:\s+within\s+(\d+\s*[a-zA-Z]))?\s*")


def split_near(text: str, names: list[str], timeframe: int | None) -> tuple[str, Near | None]:
    """The boolean part, and what stands behind `| near`: selections with and, or, not, then `by FIELD` and `within 5m`, both optional.

    Without `within` the rule's timeframe counts; there must be one of them. A name stands for "an event that meets this selection is near".
    """
    search, bar, rest = text.partition("|")
    if not bar or not (m := _NEAR.fullmatch(rest)):
        return text, None
    within = timeframe_seconds(m[3]) if m[3] else timeframe
    if within is None:
        raise ConditionError("near needs a timeframe")
    used: dict[str, None] = {}
    for _, some in _parts(m[1], names):
        used.update(dict.fromkeys(some))
    tree = condition_tree(m[1], {n: Leaf("term", n) for n in used} | {n: Leaf("term", n) for n in names})
    return search, Near(tuple(used), tree, within, m[2])


def timeframe_seconds(text: str) -> int:
    if not (m := re.fullmatch(r"\s*(\d+)\s*([smhdMy])\s*", str(text))):
        raise ConditionError(f"timeframe {text}")
    return int(m[1]) * UNITS[m[2]]
