"""Rules: read from YAML, named by field maps, compiled to Spark SQL text. All of this is driver-side metadata."""

from __future__ import annotations

import copy
import json
import logging
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml

from sentrel.functions.predicates import MESSAGE, field_values_sql, value_sql, value_leaves
from sentrel.sources.files import LocalFiles, SharedFiles, files_of, sibling

from .conditions import AggSpec, Near, Tree, condition_sql, condition_tree, split_condition, split_near, timeframe_seconds

log = logging.getLogger(__name__)

KEYWORDS = "keywords"  # as a field, like a field without name: the message, unless mapped


class RuleError(ValueError):
    pass


@dataclass
class FieldMap:
    """Rule names to event paths; None as a whole: names are paths."""

    detection: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)

    def beside(self, other: FieldMap | None, only: dict[str, str] | None = None) -> FieldMap:
        """This map, and of the names that it lacks those of the other (that `only` knows, if given)."""
        if other is None:
            return self
        more = lambda own, new: {k: v for k, v in new.items() if only is None or k in only} | own
        return FieldMap(more(self.detection, other.detection), more(self.fields, other.fields))


@dataclass(frozen=True)
class CompiledRule:
    key: str
    ruleid: str
    condition_idx: int
    title: str
    status: str
    level: str | None
    tags: tuple[str, ...]
    category: str | None
    product: str | None
    predicate: str
    prefilter: str  # true wherever the predicate is; without NOT it is in a form that a source's filter takes
    tree: Tree = field(compare=False, repr=False)  # the predicate's tests
    paths: tuple[str, ...]
    null_paths: tuple[str, ...]
    agg: AggSpec | None
    agg_path: str | None
    group_path: str | None
    timeframe_sec: int | None
    useful: tuple[str, ...]
    near: Near | None = None  # of a rule whose matches count only near others
    term_of: str | None = None  # the key of such a rule, of whose terms this is one
    description: str | None = None
    author: str | None = None
    references: tuple[str, ...] = ()
    falsepositives: tuple[str, ...] = ()

    @property
    def never_alerts(self) -> bool:
        """A rule with only one of aggregation and timeframe gives no alert."""
        return (self.agg is None) != (self.timeframe_sec is None)


def merge_documents(base: dict, doc: dict) -> dict:
    """Deep merge: maps are merged, lists joined without repeats, anything else is the later document's."""
    out = copy.deepcopy(base)
    for k, v in doc.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge_documents(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + [x for x in v if x not in out[k]]
        else:
            out[k] = copy.deepcopy(v)
    return out


def parse_documents(text: str) -> list[dict]:
    """Every document is a rule, but one with `action: global`, which is merged into all after it.

    Its id counts for those that have none of their own; rules that share an id are told apart by their place in the file.
    """
    shared, rules = {}, []
    for doc in yaml.safe_load_all(text):
        if not isinstance(doc, dict):
            continue
        if doc.get("action") == "global":
            shared = merge_documents(shared, {k: v for k, v in doc.items() if k != "action"})
        else:
            rules.append(merge_documents(shared, doc))
    return rules


def strings(value) -> list[str]:
    items = value if isinstance(value, list) else [] if value is None else [value]
    return list(dict.fromkeys(str(x) for x in items))


def _selections(rule: dict) -> dict:
    return {k: v for k, v in (rule.get("detection") or {}).items() if k not in ("condition", "timeframe")}


def _conditions(rule: dict) -> list[str]:
    c = (rule.get("detection") or {}).get("condition")
    return [str(x) for x in (c if isinstance(c, list) else [c])] if c is not None else []


def build_field_map(rule: dict, global_map: dict[str, str]) -> FieldMap:
    """Paths of all names that the rule uses; a name that the global map lacks goes to the message."""
    names: list[str] = []
    for name, sel in _selections(rule).items():
        for part in sel if isinstance(sel, list) else [sel]:
            names += [k.split("|")[0] for k in part] if isinstance(part, dict) else [name]
    for c in _conditions(rule):
        near = split_near(c, list(_selections(rule)), 0)[1]
        agg = None if near else split_condition(c)[1]
        names += [x for x in (agg.field, agg.group) if x] if agg else [near.group] if near and near.group else []
    look = lambda xs: {x: global_map.get(x, MESSAGE) for x in dict.fromkeys(xs)}
    return FieldMap(look(names), look(strings(rule.get("fields"))))


def read_field_map(text: str) -> FieldMap:
    m = json.loads(text)["map"]
    return FieldMap(m.get("detection") or {}, m.get("fields") or {})


def field_map_text(rule: dict, m: FieldMap) -> str:
    return json.dumps({"id": rule.get("id"), "map": {"detection": m.detection, "fields": m.fields}}, indent=2)


class _Sql:
    """Selections as SQL text."""

    def __init__(self, fold: bool, plain: bool = False):
        self.fold, self.plain = fold, plain

    def value(self, path: str, value, modifiers: list[str]) -> str:
        return value_sql(path, value, modifiers, self.fold, self.plain)

    def values(self, path: str, values, modifiers: list[str]) -> str:
        return field_values_sql(path, values, modifiers, self.fold, self.plain)

    def every(self, parts: list[str]) -> str:
        return "(" + " AND ".join(parts) + ")" if parts else "true"

    def some(self, parts: list[str]) -> str:
        return "(" + " OR ".join(parts) + ")" if parts else "false"


class _Trees:
    """Selections as trees of tests."""

    def __init__(self, fold: bool):
        self.fold = fold

    def value(self, path: str, value, modifiers: list[str]) -> Tree:
        return ("or", value_leaves(path, value, modifiers, self.fold))

    def values(self, path: str, values, modifiers: list[str]) -> Tree:
        if not isinstance(values, list):
            return self.value(path, values, modifiers)
        return ("and" if "all" in modifiers and values else "or", [self.value(path, v, modifiers) for v in values])

    def every(self, parts: list[Tree]) -> Tree:
        return ("and", parts)

    def some(self, parts: list[Tree]) -> Tree:
        return ("or", parts)


class _Compiler:
    def __init__(self, fields: FieldMap | None, form: _Sql | _Trees):
        self.fields, self.form, self.paths, self.nulls = fields, form, {}, {}

    def path(self, name: str) -> str:
        found = None if self.fields is None else self.fields.detection.get(name)
        if found is None:
            if self.fields is not None and isinstance(self.form, _Sql):
                log.warning("field %s is not mapped; its own name is used", name)
            found = MESSAGE if name in ("", KEYWORDS) else name
        self.paths[found] = None
        return found

    def keyword(self, name: str, value):
        path = MESSAGE if self.fields is None else self.fields.detection.get(name, MESSAGE)
        self.paths[path] = None
        return self.form.value(path, value, ["contains"])

    def fields_of(self, sel: dict):
        parts = []
        for key, value in sel.items():
            name, *modifiers = str(key).split("|")
            path = self.path(name)
            if value is None or isinstance(value, list) and None in value:
                self.nulls[path] = None
            parts.append(self.form.values(path, value, modifiers))
        return self.form.every(parts)

    def selection(self, name: str, sel):
        if isinstance(sel, dict):
            return self.fields_of(sel)
        return self.form.some([self.fields_of(x) if isinstance(x, dict) else self.keyword(name, x) for x in (sel if isinstance(sel, list) else [sel])])

    def selections(self, rule: dict) -> dict:
        return {n: self.selection(n, s) for n, s in _selections(rule).items()}


def compile_rule(rule: dict, fields: FieldMap | None = None, case_insensitive: bool = False, part: int = 0) -> list[CompiledRule]:
    """One compiled rule per condition, with the key id#condition, or id#part#condition for a later rule of a file that repeats the id.

    A condition with `near` has one more for each of its terms, with the key of its own, `~` and the term. Raises RuleError with the reason.
    """
    try:
        if not rule.get("id"):
            raise RuleError("no id")
        detection, source = rule.get("detection") or {}, rule.get("logsource") or {}
        if not _conditions(rule):
            raise RuleError("no condition")
        frame = timeframe_seconds(detection["timeframe"]) if detection.get("timeframe") is not None else None
        names = strings(rule.get("fields"))
        useful = tuple(dict.fromkeys(names if fields is None else [fields.fields[n] for n in names if n in fields.fields]))
        lower = lambda x: str(x).lower() if x is not None else None
        text_of = lambda x: None if x is None else str(x)
        told = {"description": text_of(rule.get("description")), "author": text_of(rule.get("author")), "references": tuple(strings(rule.get("references"))), "falsepositives": tuple(strings(rule.get("falsepositives")))}
        about = (str(rule.get("title") or ""), str(rule.get("status") or "experimental"), rule.get("level"), tuple(strings(rule.get("tags"))), lower(source.get("category")), lower(source.get("product")))

        def searched(key: str, k: int, text: str, agg: AggSpec | None, frame: int | None, group: str | None = None, **more) -> CompiledRule:
            c = _Compiler(fields, _Sql(case_insensitive))
            predicate = condition_sql(text, c.selections(rule))
            tree = condition_tree(text, _Compiler(fields, _Trees(case_insensitive)).selections(rule))
            plain = _Compiler(fields, _Sql(case_insensitive, plain=True))
            prefilter = predicate if re.search(r"(?i)\bnot\b", text) else condition_sql(text, plain.selections(rule))
            agg_path = c.path(agg.field) if agg and agg.field else None
            group = agg.group if agg else group
            group_path = c.path(group) if group else None
            return CompiledRule(key, str(rule["id"]), k, *about, predicate, prefilter, tree, tuple(c.paths), tuple(c.nulls), agg, agg_path, group_path, frame, useful, **more, **told)

        out = []
        for k, text in enumerate(_conditions(rule)):
            key = f"{rule['id']}#{part}#{k}" if part else f"{rule['id']}#{k}"
            search, near = split_near(text, list(_selections(rule)), frame)
            if near:
                out.append(searched(key, k, search, None, None, near.group, near=near))
                out += [searched(f"{key}~{n}", k, n, None, None, near.group, term_of=key) for n in near.terms]
                continue
            search, agg = split_condition(text)
            out.append(searched(key, k, search, agg, frame))
            if out[-1].never_alerts:
                log.warning("rule %s never alerts: it has only one of aggregation and timeframe", key)
        return out
    except RuleError:
        raise
    except Exception as e:
        raise RuleError(f"{type(e).__name__}: {e}") from e


def compile_documents(text: str, fields_of: Callable[[dict], FieldMap | None] = lambda doc: None, case_insensitive: bool = False) -> tuple[list[CompiledRule], list[str]]:
    """(rules of all documents of a file, reasons why some don't compile). One that fails stops no other."""
    out, errors, seen = [], [], Counter()
    for doc in parse_documents(text):
        name = str(doc.get("id"))
        try:
            out += compile_rule(doc, fields_of(doc), case_insensitive, seen[name])
        except (RuleError, ValueError) as e:
            errors.append(f"{name}: {e}")
        seen[name] += 1
    return out, errors


@dataclass
class RuleSet:
    """Rules of a folder, local or on a shared file system (given as a URI), read again by `refresh`.

    What has changed is told by the content of a rule's file and of its map, on a shared file system by their length and time of change.
    """

    folder: str
    maps: str | None = None
    global_map: dict[str, str] | None = None
    write_maps: bool = False
    case_insensitive: bool = False
    rules: dict[str, list[CompiledRule]] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    seen: dict[str, tuple] = field(default_factory=dict)

    def _map_path(self, path: str) -> str | None:
        return sibling(self.maps, path, ".json") if self.maps else None

    def _stamps(self, files: LocalFiles | SharedFiles, paths: list[str]) -> dict[str, tuple]:
        maps = files_of(self.maps) if self.maps else None
        own, beside = files.stamps(paths), maps.stamps([self._map_path(p) for p in paths]) if maps else {}
        return {p: (own.get(p), beside.get(self._map_path(p)) if maps else None) for p in paths}

    def refresh(self) -> dict[str, list[str]]:
        """Paths that were added, changed and removed. One rule's failure is reported in `errors` and stops no other."""
        files = files_of(self.folder)
        paths = files.list(self.folder, ".yml")
        out: dict[str, list[str]] = {"added": [], "changed": [], "removed": [p for p in self.seen if p not in set(paths)]}
        for p in out["removed"]:
            self.seen.pop(p), self.rules.pop(p, None), self.errors.pop(p, None)
            if self.write_maps and (m := self._map_path(p)) and files_of(self.maps).stamps([m]):
                files_of(self.maps).delete(m)
        now = self._stamps(files, paths)
        changed = [p for p in paths if self.seen.get(p) != now[p]]
        for p in changed:
            out["changed" if p in self.seen else "added"].append(p)
            self._load(p, files.read(p))
        self.seen |= self._stamps(files, changed)  # maps may have been written
        return out

    def _load(self, name: str, text: str) -> None:
        m = self._map_path(name)
        maps = files_of(self.maps) if m else None
        written = maps.read(m) if m and maps.stamps([m]) else None
        made_here: list[FieldMap] = []

        def fields_of(doc: dict) -> FieldMap | None:
            made = build_field_map(doc, self.global_map) if self.global_map is not None else None
            if written is not None:
                return read_field_map(written).beside(made, self.global_map)
            if made and m and self.write_maps:  # documents of one file share its map
                made = made_here[-1].beside(made) if made_here else made
                made_here.append(made)
                maps.write(m, field_map_text(doc, made))
            return made

        self.errors.pop(name, None)
        try:
            self.rules[name], errors = compile_documents(text, fields_of, self.case_insensitive)
        except yaml.YAMLError as e:
            self.rules[name], errors = [], [f"YAML: {e}"]
        if errors:
            self.errors[name] = "\n".join(errors)

    def compiled(self) -> list[CompiledRule]:
        """Of rules with one key in several files, the last by path counts: see `replaced`."""
        return list({r.key: r for p in sorted(self.rules) for r in self.rules[p]}.values())

    def replaced(self) -> dict[str, list[str]]:
        """Keys that several files have, with the files."""
        files: dict[str, list[str]] = {}
        for p in sorted(self.rules):
            for r in self.rules[p]:
                files.setdefault(r.key, []).append(p)
        return {k: ps for k, ps in files.items() if len(ps) > 1}

    def logsources(self) -> set[tuple[str | None, str | None]]:
        return {(r.category, r.product) for r in self.compiled()}


def load_rules(folder: str, **options) -> RuleSet:
    found = RuleSet(folder, **options)
    found.refresh()
    return found
