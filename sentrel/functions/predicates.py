"""Leaf predicates: one field, one value and its modifiers become a Spark SQL boolean expression.

Fields are string columns of a struct `f` (see operators.events.project_fields). Every predicate is two-valued:
a missing field makes it false, so that NOT above it keeps the row.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, replace

MESSAGE = "message"


class UnsupportedModifier(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    """Text to match. literal: `*` is no wildcard; open_left, open_right: anything may stand before, after."""

    text: str
    literal: bool = False
    open_left: bool = False
    open_right: bool = False
    regex: bool = False


Modifier = Callable[[list[Pattern]], list[Pattern]]


def _each(change: Callable[[Pattern], Pattern]) -> Modifier:
    return lambda patterns: [change(p) for p in patterns]


def _b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def base64_offsets(text: str) -> list[str]:
    """The forms that the text takes inside base64 of a longer string, by its place modulo 3, without what depends on its neighbours."""
    raw, out = text.encode(), []
    for pad in range(3):
        tail = (pad + len(raw)) % 3
        code = _b64(b"\0" * pad + raw).rstrip("=")
        out.append(code[(0, 2, 3)[pad] : len(code) - (1 if tail else 0)])
    return out


_MODIFIERS: dict[str, Modifier] = {
    # also where the value itself starts or ends with `*`: the sign adds nothing then
    "contains": _each(lambda p: replace(p, open_left=True, open_right=True)),
    "startswith": _each(lambda p: replace(p, open_right=True)),
    "endswith": _each(lambda p: replace(p, open_left=True)),
    "re": _each(lambda p: replace(p, regex=True)),
    "base64": _each(lambda p: replace(p, text=_b64(p.text.encode()), literal=True)),
    "base64offset": lambda patterns: [replace(p, text=t, literal=True) for p in patterns for t in base64_offsets(p.text)],
}


def register_modifier(name: str, change: Modifier) -> None:
    """Adds or replaces a value modifier; several patterns of one value are alternatives."""
    _MODIFIERS[name] = change


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def field_sql(path: str) -> str:
    return f"f.`{path.replace('`', '``')}`"


def regex_escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


@dataclass(frozen=True)
class Leaf:
    """One comparison of a field. kind: null, present, equals, contains, starts, ends or regex; fold: of the field's value in lower case."""

    kind: str
    path: str
    text: str = ""
    fold: bool = False


def _pattern_leaf(path: str, p: Pattern, fold: bool) -> Leaf:
    if p.regex:
        return Leaf("regex", path, ("(?i)" if fold else "") + "^(?:" + p.text + r")\z")
    text = p.text
    left, right = p.open_left, p.open_right
    if not p.literal:
        left, right = left or text.startswith("*"), right or text.endswith("*")
        text = text.strip("*")
    if fold:
        text = text.lower()
    if "*" in text and not p.literal:
        body = ".*".join(regex_escape(x) for x in text.split("*"))
        return Leaf("regex", path, "(?s)^" + ".*" * left + body + ".*" * right + r"\z", fold)
    if not text and (left or right):
        return Leaf("present", path)
    return Leaf("contains" if left and right else "ends" if left else "starts" if right else "equals", path, text, fold)


def leaf_sql(t: Leaf) -> str:
    """May be null where the field is."""
    ref, text = field_sql(t.path), sql_string(t.text)
    if t.fold:
        ref = f"lower({ref})"
    if t.kind == "null":
        return f"({ref} IS NULL AND NOT coalesce({field_sql(t.path + '#nested')}, false))"
    if t.kind == "present":
        return f"{ref} IS NOT NULL"
    if t.kind in ("equals", "regex"):
        return f"{ref} {'=' if t.kind == 'equals' else 'RLIKE'} {text}"
    return f"{'contains' if t.kind == 'contains' else t.kind + 'with'}({ref}, {text})"


def scalar_text(value) -> str:
    """Numbers count by their whole part, as text: events hold the same number as a number or as a string."""
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) else str(value)


def value_leaves(path: str, value, modifiers: list[str], fold: bool = False) -> list[Leaf]:
    """One value of a field, as tests of which any may hold. Null matches a missing or null field; a field that is an array or object matches nothing."""
    if value is None:
        return [Leaf("null", path)]
    patterns = [Pattern(scalar_text(value))]
    for m in modifiers:
        if m == "all":
            continue
        if m not in _MODIFIERS:
            raise UnsupportedModifier(m)
        patterns = _MODIFIERS[m](patterns)
    if path == MESSAGE:
        patterns = [replace(p, open_left=True, open_right=True) if not p.regex else p for p in patterns]
    return [_pattern_leaf(path, p, fold) for p in patterns]


def value_sql(path: str, value, modifiers: list[str], fold: bool = False, plain: bool = False) -> str:
    """The tests of a value as SQL. plain: may be null instead of false, which a filter takes alike and can hand on to the source."""
    tests = value_leaves(path, value, modifiers, fold)
    if value is None:
        return leaf_sql(tests[0])
    parts = " OR ".join(map(leaf_sql, tests))
    return f"({parts})" if plain else f"coalesce({parts}, false)"


def field_values_sql(path: str, values, modifiers: list[str], fold: bool = False, plain: bool = False) -> str:
    """A field with one value or a list of them: any of the list, or all with the modifier `all`."""
    if isinstance(values, dict):
        raise ValueError(f"nested map under {path}")
    if not isinstance(values, list):
        return value_sql(path, values, modifiers, fold, plain)
    if not values:
        return "false"
    return "(" + (" AND " if "all" in modifiers else " OR ").join(value_sql(path, v, modifiers, fold, plain) for v in values) + ")"
