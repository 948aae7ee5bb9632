import json
from pathlib import Path

import pytest

from sentrel.functions.predicates import UnsupportedModifier, base64_offsets, register_modifier, value_sql
from sentrel.plans.conditions import AggSpec, ConditionError, UnsupportedAggregation, condition_sql, condition_tree, split_condition, timeframe_seconds
from sentrel.sources.files import SharedFiles
from sentrel.plans.rules import FieldMap, RuleError, build_field_map, compile_documents, compile_rule, load_rules, merge_documents, parse_documents

S = {"a": "A", "b": "B", "sel1": "X", "sel2": "Y", "notepad": "N"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("a and not b", "(A) AND NOT (B)"),
        ("a AND\n (b Or sel1)", "(A) AND ( (B) OR (X) )"),
        ("1 of sel*", "((X) OR (Y))"),
        ("all of sel*", "((X) AND (Y))"),
        ("not 1 of sel* and any of them", "NOT ((X) OR (Y)) AND ((A) OR (B) OR (X) OR (Y) OR (N))"),
        ("all of sel1 or notepad", "((X)) OR (N)"),
    ],
)
def test_condition(text, want):
    assert condition_sql(text, S) == want


@pytest.mark.parametrize("text", ["a and c", "1 of z*", "", "a near b"])
def test_condition_errors(text):
    with pytest.raises(ConditionError):
        condition_sql(text, S)


@pytest.mark.parametrize(
    "text, want",
    [
        ("count() > 5", AggSpec("count", None, None, ">", 5)),
        ("count(a.b-c) by d_e <= 5", AggSpec("count", "a.b-c", "d_e", "<=", 5)),
        ("UniqueCount(x)by y==3", AggSpec("uniquecount", "x", "y", "=", 3)),
        ("count by y >= 3", AggSpec("count", None, "y", ">=", 3)),
        ("min(x) by y<-1", AggSpec("min", "x", "y", "<", -1)),
    ],
)
def test_aggregation(text, want):
    assert split_condition("sel | " + text) == ("sel ", want)


def test_near_and_unknown_aggregations():
    for text in ("a | near b", "a | median(x) > 3", "a | count() > x"):
        with pytest.raises(UnsupportedAggregation):
            split_condition(text)


def test_timeframes():
    assert [timeframe_seconds(x) for x in ("5s", "5m", "5h", "5d", "5M", "5y")] == [5, 300, 18000, 432000, 12960000, 157680000]
    with pytest.raises(ConditionError):
        timeframe_seconds("5w")


def test_base64_offsets_find_the_text_wherever_it_stands():
    import base64

    for text in ("error", "foobar", "ab", "tester!"):
        forms = base64_offsets(text)
        for pad in range(3):
            for tail in ("", "x", "yz"):
                assert forms[pad] in base64.b64encode(("p" * pad + text + tail).encode()).decode()


def test_modifiers():
    with pytest.raises(UnsupportedModifier):
        value_sql("x", "a", ["nope"])
    register_modifier("upper", lambda ps: [p.__class__(p.text.upper()) for p in ps])
    assert value_sql("x", "a", ["upper"]) == "coalesce(f.`x` = 'A', false)"
    assert value_sql("x", "it's\\*", []) == "coalesce(startswith(f.`x`, 'it\\'s\\\\'), false)"


def test_field_maps():
    rule = {"id": "1", "fields": ["EventCode", "Lost"], "detection": {"s": {"EventCode|contains": 1}, "keywords": ["x"], "condition": "s or keywords | count(Image) by User > 3"}}
    m = build_field_map(rule, {"EventCode": "event.code", "User": "user.name"})
    assert m == FieldMap({"EventCode": "event.code", "keywords": "message", "Image": "message", "User": "user.name"}, {"EventCode": "event.code", "Lost": "message"})
    r = compile_rule(rule | {"detection": rule["detection"] | {"timeframe": "1m"}}, m)[0]
    assert (r.agg_path, r.group_path, r.useful, r.timeframe_sec) == ("message", "user.name", ("event.code", "message"), 60)


def test_documents_and_merge():
    text = "action: global\nid: g\ndetection:\n  c: [1]\n---\ntitle: one\ndetection: {c: [1, 2]}\n---\ntitle: two\nid: own\n"
    assert parse_documents(text) == [{"id": "g", "detection": {"c": [1, 2]}, "title": "one"}, {"id": "own", "detection": {"c": [1]}, "title": "two"}]
    assert parse_documents("title: a\n---\ntitle: b") == [{"title": "a"}, {"title": "b"}]
    assert merge_documents({"a": {"b": 1}}, {"a": {"b": 2, "c": 3}}) == {"a": {"b": 2, "c": 3}}


def test_documents_of_one_file_and_files_of_one_id(tmp_path):
    """No document is lost: those that share an id have keys of their own, and what other files replace is reported."""
    doc = "logsource: {{category: c{0}}}\ndetection:\n  s: {{a: {0}}}\n"
    shared = "action: global\nid: g\ndetection:\n  condition: s\n"
    (tmp_path / "a.yml").write_text(shared + "".join("---\n" + doc.format(k) for k in range(4)))
    (tmp_path / "b.yml").write_text(shared + "---\n" + doc.format(7) + "---\nid: own\n" + doc.format(8) + "---\nid: bad\ndetection:\n  s: {a|zz: 1}\n---\nid: worse\ndetection:\n  s: 1\n  condition: t\n")
    rs = load_rules(str(tmp_path))
    assert {r.key: r.category for r in rs.compiled()} == {"g#0": "c7", "g#1#0": "c1", "g#2#0": "c2", "g#3#0": "c3", "own#0": "c8"}
    assert {k: [Path(p).name for p in ps] for k, ps in rs.replaced().items()} == {"g#0": ["a.yml", "b.yml"]}
    assert [[e.partition(":")[0] for e in x.split("\n")] for x in rs.errors.values()] == [["bad", "worse"]]
    (tmp_path / "b.yml").unlink()
    rs.refresh()
    assert sorted(r.category for r in rs.compiled()) == ["c0", "c1", "c2", "c3"] and not rs.errors and not rs.replaced()


def test_names_without_a_map_entry(tmp_path):
    """Keywords as a field are the message; what a rule's own map lacks is looked up in the global one; documents of a file share its map."""
    plain = compile_rule({"id": "k", "detection": {"s": {"keywords|contains|all": ["a", "b"]}, "t": {"|all": ["c"]}, "condition": "s or t"}})[0]
    assert plain.paths == ("message",)
    (tmp_path / "rules").mkdir(), (tmp_path / "maps").mkdir()
    (tmp_path / "rules/r.yml").write_text("id: r\nfields: [Known, Lost]\ndetection:\n  s: {Own: 1}\n  condition: s | count(Known) by Lost > 3\n  timeframe: 1m\n")
    (tmp_path / "maps/r.json").write_text(json.dumps({"id": "r", "map": {"detection": {"Own": "own.path"}, "fields": {}}}))
    r = load_rules(str(tmp_path / "rules"), maps=str(tmp_path / "maps"), global_map={"Known": "known.path", "Own": "other"}).compiled()[0]
    assert (r.paths, r.agg_path, r.group_path, r.useful) == (("own.path", "known.path", "Lost"), "known.path", "Lost", ("known.path",))
    (tmp_path / "rules/two.yml").write_text("id: x\ndetection:\n  s: {A: 1}\n  condition: s\n---\nid: y\ndetection:\n  s: {B: 1}\n  condition: s\n")
    rs = load_rules(str(tmp_path / "rules"), maps=str(tmp_path / "maps"), global_map={"A": "a.path", "B": "b.path"}, write_maps=True)
    assert {r.ruleid: r.paths for r in rs.compiled()} | {"r": 0} == {"x": ("a.path",), "y": ("b.path",), "r": 0}
    assert json.loads((tmp_path / "maps/two.json").read_text())["map"]["detection"] == {"A": "a.path", "B": "b.path"}


def test_compile_reports():
    for bad in ({"id": "x"}, {"detection": {"s": {"a": 1}, "condition": "s"}}, {"id": "x", "detection": {"s": {"a|zz": 1}, "condition": "s"}}, {"id": "x", "detection": {"s": {"a": {"b": 1}}, "condition": "s"}}):
        with pytest.raises(RuleError):
            compile_rule(bad)
    two = compile_rule({"id": "x", "status": "stable", "logsource": {"category": "DNS"}, "detection": {"s": {"a": 1}, "condition": ["s | count() > 1", "not s"]}})
    assert [(r.key, r.status, r.category, r.never_alerts) for r in two] == [("x#0", "stable", "dns", True), ("x#1", "stable", "dns", False)]


def test_rule_folder(tmp_path):
    good = "id: {0}\ndetection:\n  s: {{EventCode: 1}}\n  condition: s\n"
    (tmp_path / "rules/sub").mkdir(parents=True), (tmp_path / "maps").mkdir()
    (tmp_path / "rules/a.yml").write_text(good.format("a"))
    (tmp_path / "rules/sub/b.yml").write_text(good.format("b"))
    (tmp_path / "rules/bad.yml").write_text("id: [")
    (tmp_path / "rules/no.txt").write_text("id: x")
    rs = load_rules(str(tmp_path / "rules"), maps=str(tmp_path / "maps"), global_map={"EventCode": "event.code"}, write_maps=True)
    assert sorted(r.ruleid for r in rs.compiled()) == ["a", "b"] and len(rs.errors) == 1 and rs.compiled()[0].paths == ("event.code",)
    assert json.loads((tmp_path / "maps/a.json").read_text())["map"]["detection"] == {"EventCode": "event.code"}
    assert rs.refresh() == {"added": [], "changed": [], "removed": []}
    (tmp_path / "maps/a.json").write_text(json.dumps({"id": "a", "map": {"detection": {"EventCode": "winlog.event_id"}, "fields": {}}}))
    (tmp_path / "rules/bad.yml").write_text(good.format("fixed"))
    (tmp_path / "rules/sub/b.yml").unlink()
    changes = rs.refresh()
    assert [len(changes[k]) for k in ("added", "changed", "removed")] == [0, 2, 1] and not rs.errors
    assert {r.ruleid: r.paths for r in rs.compiled()} == {"a": ("winlog.event_id",), "fixed": ("event.code",)}


def near_rule(condition, timeframe="30s", **more):
    return {"id": "n", "detection": {"a": {"x": 1}, "b": {"x": 2}, "c": {"x": 3}, "condition": condition} | ({"timeframe": timeframe} if timeframe else {}), **more}


@pytest.mark.parametrize(
    "text, timeframe, terms, within, group",
    [
        ("a | near b", "30s", ("b",), 30, None),
        ("( a and not c ) | near b", "15s ", ("b",), 15, None),
        ("a | near b and c", "1m", ("b", "c"), 60, None),
        ("a | near b and not c by user within 2h", None, ("b", "c"), 7200, "user"),
        ("a | NEAR 1 of them within 5m", "1d", ("a", "b", "c"), 300, None),
    ],
)
def test_near(text, timeframe, terms, within, group):
    anchor, *others = compile_rule(near_rule(text, timeframe))
    assert (anchor.key, anchor.near.terms, anchor.near.within, anchor.group_path) == ("n#0", terms, within, group) and not anchor.never_alerts
    assert [(r.key, r.term_of, r.predicate) for r in others] == [(f"n#0~{t}", "n#0", f"((coalesce(f.`x` = '{'abc'.index(t) + 1}', false)))") for t in terms]


@pytest.mark.parametrize("text, timeframe", [("a | near b", None), ("a | near d", "5s"), ("a | near", "5s"), ("a | near b and", "5s"), ("a | near b c", "5s"), ("a | near ( b", "5s")])
def test_near_errors(text, timeframe):
    with pytest.raises(RuleError):
        compile_rule(near_rule(text, timeframe))


def test_near_in_a_file_with_a_shared_document():
    text = """
action: global
id: tor
detection: {service_install: {EventID: 7045}, timeframe: 5m, condition: service_install | near process}
---
logsource: {product: windows}
detection: {process: {Image: ['a*', 'b']}}
"""
    rules, errors = compile_documents(text, lambda doc: build_field_map(doc, {"EventID": "event.code", "Image": "process.executable"}))
    assert not errors and [r.key for r in rules] == ["tor#0", "tor#0~process"] and rules[1].paths == ("event.code", "process.executable")


@pytest.mark.parametrize("text", ["a and", "a b", "( a", "a )", "not", "or a"])
def test_what_no_tree_can_be_made_of(text):
    with pytest.raises(ConditionError):
        condition_tree(text, S)


def test_tree_has_the_precedence_of_sql():
    t = {n: ("or", []) for n in "abc"}
    a, b, c = ("or", [t["a"]]), ("or", [t["b"]]), ("or", [t["c"]])
    assert condition_tree("a or not b and c", t) == ("or", [a, ("and", [("not", [b]), c])])
    assert condition_tree("not (a or b) and all of them", t) == ("and", [("not", [("or", [a, b])]), ("and", [*t.values()])])


def test_a_folder_on_a_shared_file_system(spark, tmp_path):
    """Rules and maps by URI, with the same refreshes as by local path."""
    for d in ("rules/sub", "maps"):
        (tmp_path / d).mkdir(parents=True)
    one = "id: {}\nfields: [X]\ndetection: {{s: {{X: {}}}, condition: s}}\n"
    (tmp_path / "rules/a.yml").write_text(one.format("a", 1))
    (tmp_path / "rules/sub/b c.yml").write_text(one.format("b", 2))
    (tmp_path / "rules/no.txt").write_text("x")
    rules = load_rules(f"file://{tmp_path}/rules", maps=f"file://{tmp_path}/maps", global_map={"X": "x.y"}, write_maps=True)
    names = lambda: sorted((r.key, r.paths) for r in rules.compiled())
    assert names() == [("a#0", ("x.y",)), ("b#0", ("x.y",))] and len(list((tmp_path / "maps").glob("*.json"))) == 2
    assert rules.refresh() == {"added": [], "changed": [], "removed": []}
    (tmp_path / "rules/a.yml").write_text(one.format("a", 100))
    (tmp_path / "rules/c.yml").write_text("id: [")
    changed = rules.refresh()
    assert [len(changed[k]) for k in ("added", "changed", "removed")] == [1, 1, 0] and "YAML" in next(iter(rules.errors.values()))
    SharedFiles(spark).write(f"file://{tmp_path}/maps/a.json", json.dumps({"id": "a", "map": {"detection": {"X": "other.path"}}}))
    assert len(rules.refresh()["changed"]) == 1 and ("a#0", ("other.path",)) in names()
    (tmp_path / "rules/a.yml").unlink(), (tmp_path / "rules/c.yml").unlink()
    assert len(rules.refresh()["removed"]) == 2 and names() == [("b#0", ("x.y",))] and not (tmp_path / "maps/a.json").exists()
    assert load_rules(f"file://{tmp_path}/nothing").compiled() == []
