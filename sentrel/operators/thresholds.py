"""Threshold aggregations anchored at a first event.

State of a key is (time of its first event, accumulator). The first event is never tested. An event within the
timeframe steps the accumulator, which is then tested; if it fires, the event is emitted and the state goes. An event
at or beyond the timeframe ends the state and is itself dropped (or, if asked, opens the next one). Every row is an
event: equal ones count as often as they come.

The order of a key's events decides, so a key is folded in order. Keys of ordinary size are folded inside the JVM, over a sorted
array each; larger ones are streamed through `advance` in Arrow batches, as the stream does; keys that would fill a task
are cut into parts. All three give the same result.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.scratch import Scratch

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}
_INT = re.compile(r"[+-]?[0-9]+")


@dataclass(frozen=True)
class Aggregation:
    """init returns None where the event can't open a state; numeric ones get an int of 64 bits or None (no such number).

    A state may be changed in place; it must be what JSON can hold.
    """

    init: Callable
    step: Callable
    value: Callable
    numeric: bool = True


def _quotient(a: int, b: int) -> int:
    return abs(a) // b * (1 if a >= 0 else -1)


def _or_same(change: Callable) -> Callable:
    return lambda acc, x: acc if x is None else change(acc, x)


def _is_long(x: int) -> bool:
    return -(2**63) <= x < 2**63


def _added(acc: int, x: int) -> int:
    """A sum that would leave 64 bits stays as it is."""
    return acc + x if _is_long(acc + x) else acc


def _seen(acc: dict, x: str | None) -> dict:
    if x is not None:
        acc[x] = 1
    return acc


AGGREGATIONS: dict[str, Aggregation] = {
    "count": Aggregation(lambda x: 1, lambda n, x: n + 1, lambda n: n, numeric=False),
    "uniquecount": Aggregation(lambda x: None if x is None else {x: 1}, _seen, len, numeric=False),
    "sum": Aggregation(lambda x: x, _or_same(_added), lambda s: s),
    "min": Aggregation(lambda x: x, _or_same(min), lambda s: s),
    "max": Aggregation(lambda x: x, _or_same(max), lambda s: s),
    "avg": Aggregation(lambda x: None if x is None else [x, 1], _or_same(lambda s, x: [_added(s[0], x), s[1] + 1]), lambda s: _quotient(s[0], s[1])),
}


_BUILT_IN = dict(AGGREGATIONS)


def register_aggregation(name: str, aggregation: Aggregation) -> None:
    AGGREGATIONS[name] = aggregation


def registered() -> dict[str, Aggregation]:
    """Aggregations that aren't built in, for tasks to know them as the driver does."""
    return {n: a for n, a in AGGREGATIONS.items() if _BUILT_IN.get(n) is not a}


def learn(more: dict[str, Aggregation]) -> None:
    AGGREGATIONS.update(more)


def advance(state: list | None, ms: int, raw: str | None, fn: str, op: str, threshold: int, timeframe: int, reopen: bool = False) -> tuple[list | None, int | None]:
    """(new state, value if the event fires). state: [first event's milliseconds, accumulator] or None."""
    agg = AGGREGATIONS[fn]
    x = (int(raw) if raw is not None and _INT.fullmatch(raw) and _is_long(int(raw)) else None) if agg.numeric else raw
    late = state is not None and int((ms - state[0]) / 1000) >= timeframe
    if state is None or (late and reopen):
        acc = agg.init(x)
        return (None if acc is None else [ms, acc]), None
    if late:
        return None, None
    acc = agg.step(state[1], x)
    value = agg.value(acc)
    return (None, value) if OPS[op](value, threshold) else ([state[0], acc], None)


def keyed(matches: DataFrame) -> DataFrame:
    """Rows that aggregate, with created_ms and state_key; those without a value or group that they need are left out."""
    own_value = (F.col("agg_fn") == "count") & F.col("agg_field")
    null_value = own_value & F.col("agg_raw").isNull()
    rows = matches.where(F.col("agg_fn").isNotNull() & F.col("timeframe_sec").isNotNull() & F.col("created").isNotNull() & ~(F.col("agg_by") & F.col("group_value").isNull()) & ~null_value)
    part = lambda use, value: F.when(use, F.concat(F.octet_length(value), F.lit(":"), value)).otherwise("-")
    return rows.withColumns({"created_ms": F.unix_millis(F.col("created").cast("timestamp")), "state_key": F.concat(part(F.col("agg_by"), F.col("group_value")), part(own_value, F.col("agg_raw")))})


_NARROW = ("rule_key", "state_key", "created_ms", "event_uid", "row", "agg_raw", "agg_fn", "op", "threshold", "timeframe_sec")
_ORDER = ("rule_key", "state_key", "created_ms", "event_uid", "row")
_FIRED = T.StructType([T.StructField("row", T.LongType()), T.StructField("rule_key", T.StringType()), T.StructField("agg_value", T.LongType())])

#: Rows of a key up to which it is folded over an array in the JVM.
ARRAY_ROWS = 2_000
#: Keys, or rows that fire, up to which a list of them is broadcast.
BROADCAST_KEYS = 100_000

_NUMBER = "CASE WHEN agg_fn NOT IN ('count', 'uniquecount') AND e.agg_raw RLIKE '^[+-]?[0-9]+\\\\z' THEN try_cast(e.agg_raw AS bigint) END"
#: A first event opens a state, if it has the value that the function needs.
_OPEN = f"""named_struct('t0', CASE WHEN agg_fn = 'count' OR (agg_fn = 'uniquecount' AND e.agg_raw IS NOT NULL) OR (agg_fn NOT IN ('count', 'uniquecount') AND e.x IS NOT NULL) THEN e.created_ms END,
  'n', 1L, 's', e.x, 'seen', CASE WHEN agg_fn = 'uniquecount' THEN array(e.agg_raw) ELSE CAST(array() AS array<string>) END, 'fired', acc.fired)"""
_CLOSED = "named_struct('t0', CAST(NULL AS bigint), 'n', 0L, 's', CAST(NULL AS bigint), 'seen', CAST(array() AS array<string>), 'fired', acc.fired)"
_STEPPED = """named_struct('n', acc.n + CASE WHEN agg_fn = 'count' OR e.x IS NOT NULL THEN 1L ELSE 0L END,
  's', CASE agg_fn WHEN 'min' THEN least(acc.s, e.x) WHEN 'max' THEN greatest(acc.s, e.x) ELSE coalesce(try_add(acc.s, e.x), acc.s) END,
  'seen', CASE WHEN agg_fn = 'uniquecount' AND e.agg_raw IS NOT NULL THEN array_union(acc.seen, array(e.agg_raw)) ELSE acc.seen END)"""
_VALUE = "CASE agg_fn WHEN 'count' THEN z.n WHEN 'uniquecount' THEN CAST(size(z.seen) AS bigint) WHEN 'avg' THEN z.s div z.n ELSE z.s END"
_TEST = "CASE op WHEN '>' THEN v > threshold WHEN '>=' THEN v >= threshold WHEN '<' THEN v < threshold WHEN '<=' THEN v <= threshold ELSE v = threshold END"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` bound to `value`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _array_fold(narrow: DataFrame, reopen: bool) -> DataFrame:
    """The fold as one aggregate over each key's sorted array; built-in functions only."""
    keys = narrow.groupBy("rule_key", "state_key").agg(
        *[F.first(c).alias(c) for c in ("agg_fn", "op", "threshold", "timeframe_sec")], F.array_sort(F.collect_list(F.struct("created_ms", "event_uid", "row", "agg_raw"))).alias("events")
    )
    empty = "CAST(array() AS array<struct<row: bigint, agg_value: bigint>>)"
    tested = _let("v", _VALUE, f"CASE WHEN {_TEST} THEN named_struct('t0', CAST(NULL AS bigint), 'n', 0L, 's', CAST(NULL AS bigint), 'seen', CAST(array() AS array<string>), 'fired', array_append(acc.fired, named_struct('row', e.row, 'agg_value', v))) ELSE named_struct('t0', acc.t0, 'n', z.n, 's', z.s, 'seen', z.seen, 'fired', acc.fired) END")
    late = "(e.created_ms - acc.t0) div 1000 >= timeframe_sec"
    step = f"CASE WHEN acc.t0 IS NULL THEN {_OPEN} WHEN {late} THEN {_OPEN if reopen else _CLOSED} ELSE {_let('z', _STEPPED, tested)} END"
    events = f"transform(events, e -> named_struct('created_ms', e.created_ms, 'row', e.row, 'agg_raw', e.agg_raw, 'x', {_NUMBER}))"
    start = f"named_struct('t0', CAST(NULL AS bigint), 'n', 0L, 's', CAST(NULL AS bigint), 'seen', CAST(array() AS array<string>), 'fired', {empty})"
    found = keys.select("rule_key", F.expr(f"aggregate({events}, {start}, (acc, e) -> {step}, acc -> acc.fired)").alias("fired"))
    return found.select("rule_key", F.inline("fired")).select("row", "rule_key", "agg_value")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in _NARROW), strict=True)


def _fold(reopen: bool):
    more = registered()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn(more)
        key, state = None, None
        for batch in batches:
            found = []
            for rule, sub, ms, _, row, raw, fn, op, threshold, frame in _rows(batch):
                if (rule, sub) != key:
                    key, state = (rule, sub), None
                state, value = advance(state, ms, raw, fn, op, threshold, frame, reopen)
                if value is not None:
                    found.append((row, rule, value))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["row", "rule_key", "agg_value"])

    return run


class Summary:
    """What a run of one key's events does to a state that it neither fires nor lets expire, so that runs compose without being folded again.

    Tested values move between bounds that follow from the entry state: if the test holds for none of them, nothing fires.
    """

    def __init__(self, spec: tuple[str, str, int, int]):
        self.spec, self.n, self.last = spec, 0, None
        self.known = spec[0] in ("count", "sum", "min", "max", "uniquecount") and _BUILT_IN.get(spec[0]) is AGGREGATIONS.get(spec[0])
        self.total = self.least = self.most = 0  # of sums up to each event
        self.first = self.low = self.high = None  # numbers
        self.values: dict[str, int] = {}

    def add(self, ms: int, raw: str | None, spec: tuple[str, str, int, int]) -> None:
        self.known &= spec == self.spec and len(self.values) <= SUMMARY_VALUES
        if not self.known:
            return
        self.n, self.last = self.n + 1, ms
        if spec[0] == "uniquecount":
            if raw is not None:
                self.values[raw] = 1
        elif spec[0] != "count":
            x = int(raw) if raw is not None and _INT.fullmatch(raw) and _is_long(int(raw)) else None
            if self.n == 1:
                self.first = x
            if x is not None:
                self.low, self.high = x if self.low is None else min(self.low, x), x if self.high is None else max(self.high, x)
                self.total += x
            self.least, self.most = (self.total, self.total) if self.n == 1 else (min(self.least, self.total), max(self.most, self.total))

    def text(self) -> str | None:
        return json.dumps([self.spec, self.n, self.last, self.total, self.least, self.most, self.first, self.low, self.high, list(self.values)]) if self.known and self.n else None


#: Values of uniquecount that a summary holds at most; a run with more is folded again.
SUMMARY_VALUES = 10_000


def composed(summary: str | None, state: list) -> list | None:
    """The state after a summarised run that `state` enters, or None if something may fire or expire in it."""
    if summary is None:
        return None
    (fn, op, threshold, frame), n, last, total, least, most, first, low, high, values = json.loads(summary)
    t0, acc = state
    if int((last - t0) / 1000) >= frame:
        return None
    pick = lambda f, *xs: f(x for x in xs if x is not None)
    if fn == "count":
        bounds, after = (acc + 1, acc + n), acc + n
    elif fn == "sum":
        bounds, after = (acc + least, acc + most), acc + total
        if not (_is_long(bounds[0]) and _is_long(bounds[1])):
            return None
    elif fn == "uniquecount":
        after = acc | dict.fromkeys(values, 1)
        bounds = (len(acc), len(after))
    else:
        f = min if fn == "min" else max
        after = pick(f, acc, low if fn == "min" else high)
        bounds = sorted((pick(f, acc, first), after))
    lowest, highest = bounds
    quiet = {">": highest <= threshold, ">=": highest < threshold, "<": lowest >= threshold, "<=": lowest > threshold, "=": not lowest <= threshold <= highest}[op]
    return [t0, after] if quiet else None


#: Events at the start of a part that an entry state may end at for `Chains` to know what follows.
HEAD_EVENTS = 256
#: Values that the states of one part's chains hold at most, together.
CHAIN_VALUES = 50_000


class Chains:
    """The state at the end of a run of one key's events for each place near its start at which a state may end.

    Once a state has ended, all that follows depends on the place alone. So the run is folded from each of its first places at once; folds that end at
    the same event go on as one, and there are never more of them than HEAD_EVENTS. A run whose first fold doesn't end among its first events, or
    whose states grow too large, isn't known.
    """

    def __init__(self, spec: tuple[str, str, int, int], reopen: bool):
        self.spec, self.reopen, self.n, self.known = spec, reopen, 0, True
        self.head: list[tuple[int, str | None]] = []
        self.folds: list[list] = []  # state, places
        self.ended = False

    def add(self, ms: int, raw: str | None, spec: tuple[str, str, int, int]) -> None:
        self.known &= spec == self.spec and (self.ended or self.n < HEAD_EVENTS)
        if not self.known:
            return
        if self.n < HEAD_EVENTS:
            self.head.append((ms, raw))
            self._join([None, [self.n]], self.folds, lambda f: f[0] is None)
        fn, op, threshold, frame = spec
        folds, opened = [], None
        for fold in self.folds:
            before, places = fold
            anew = before is None or (self.reopen and _late(before, ms, frame))
            if anew and opened is not None:  # as one that has done the same at this event
                opened[1] += places
                continue
            state, _ = advance(before, ms, raw, fn, op, threshold, frame, self.reopen)
            self.ended |= before is not None and (state is None or anew) and 0 in places
            fold = self._join([state, places], folds, lambda f: f[0] is None and state is None)  # noqa: B023
            opened = fold if anew else opened
        self.folds = folds
        self.n += 1
        if self.n % 512 == 0:
            self._bounded()

    @staticmethod
    def _join(fold: list, folds: list[list], same: Callable) -> list:
        for f in folds:
            if same(f):
                f[1] += fold[1]
                return f
        folds.append(fold)
        return fold

    def _bounded(self) -> None:
        size = lambda f: len(f[0][1]) if f[0] is not None and hasattr(f[0][1], "__len__") else 1
        self.known &= sum(map(size, self.folds)) <= CHAIN_VALUES
        if not self.known:
            self.folds = []

    def text(self) -> str | None:
        self._bounded()
        if not (self.known and self.ended and self.n):
            return None
        of = {place: i for i, (_, places) in enumerate(self.folds) for place in places}
        return json.dumps([self.spec, self.n, self.head, [of[i] for i in range(len(self.head))], [state for state, _ in self.folds]])


def _late(state: list, ms: int, frame: int) -> bool:
    return int((ms - state[0]) / 1000) >= frame


def followed(chains: str | None, state: list | None, reopen: bool) -> tuple[list | None] | None:
    """The state after a run that `state` enters, in a tuple, or None if its chains don't tell."""
    if chains is None:
        return None
    (fn, op, threshold, frame), n, head, of, ends = json.loads(chains)
    if state is None:
        return (ends[of[0]],)
    state = json.loads(json.dumps(state))
    for i, (ms, raw) in enumerate(head):
        late = _late(state, ms, frame)
        state, _ = advance(state, ms, raw, fn, op, threshold, frame, reopen)
        if late and reopen:  # as a state that opens here
            return (ends[of[i]],)
        if state is None:
            return (ends[of[i + 1]],) if i + 1 < len(head) else (None,) if n == len(head) else None
    return (state,) if n == len(head) else None


def _fold_parts(reopen: bool, entries, chained: bool):
    """Folds whole parts, each from the state that its entry names. Besides the rows that fire, one row per part: its first and last key, its last
    state, a summary of its first key's events and, if asked and there is no other key, their chains."""
    more = registered()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn(more)
        part, first, key, state, head, chains = None, None, None, None, None, None
        last = lambda: (None, None, None, part, first, json.dumps(key), json.dumps(state), head.text(), chains.text() if chains and at_head else None, None)
        for batch in batches:
            out = []
            for here, values in zip(batch.column("part").to_pylist(), _rows(batch), strict=True):
                rule, sub, ms, _, row, raw, fn, op, threshold, frame = values
                if here != part:
                    if part is not None:
                        out.append(last())
                    part, key, first, at_head = here, (rule, sub), json.dumps((rule, sub)), True
                    state = json.loads(json.dumps(entries.value.get(part)))  # its own, as it may be changed in place
                    head, chains = Summary((fn, op, threshold, frame)), Chains((fn, op, threshold, frame), reopen) if chained else None
                elif (rule, sub) != key:
                    key, state, at_head = (rule, sub), None, False
                if at_head:
                    head.add(ms, raw, (fn, op, threshold, frame))
                    if chains:
                        chains.add(ms, raw, (fn, op, threshold, frame))
                state, value = advance(state, ms, raw, fn, op, threshold, frame, reopen)
                if value is not None:
                    out.append((row, rule, value, part, None, None, None, None, None, at_head))
            yield _part_batch(out)
        if part is not None:
            yield _part_batch([last()])

    return run


_PART = {"row": pa.int64(), "rule_key": pa.string(), "agg_value": pa.int64(), "part": pa.int32(), "first_key": pa.string(), "last_key": pa.string(), "state": pa.string(), "summary": pa.string(), "chains": pa.string(), "head": pa.bool_()}


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PART.values())], list(_PART))


def _fired_in_parts(scratch: Scratch, narrow: DataFrame, parts: int, reopen: bool) -> DataFrame:
    """The fold of few, large keys: their rows are cut into even parts in order, whatever key they are of.

    All parts are folded from no state at once. Then the true entry states are carried through in order: where a part's summary shows that nothing
    fires or expires under its entry state, the state after it follows at once, and what the fold of its first key gave is void; the others are folded
    again, until none differs. A wrong entry state is forgotten at the first alert or expiry that both runs share; where runs never share one, as counts of a
    dense key don't, the part's chains give the state after it, so that all parts have their entry states after the first pass and a second settles all.
    A key that never fires takes one, however many parts it has. What the driver holds is one state, one summary and the chains of HEAD_EVENTS events per part.
    """
    spark = scratch.spark
    cut = scratch.write(narrow.repartitionByRange(parts, *_ORDER).withColumn("part", F.spark_partition_id()), "parts")
    schema = T.StructType([*_FIRED.fields, T.StructField("part", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("first_key", "last_key", "state", "summary", "chains")], T.StructField("head", T.BooleanType())])
    entries: dict[int, list | None] = {}
    ends: dict[int, tuple] = {}
    latest: dict[int, DataFrame] = {}
    void: set[int] = set()
    chains: dict[int, str | None] = {}
    todo: list[int] | None = None
    while todo is None or todo:
        some = cut if todo is None else cut.where(F.col("part").isin(todo))
        folded = some.repartition(parts, "part").sortWithinPartitions("part", *_ORDER).mapInArrow(_fold_parts(reopen, spark.sparkContext.broadcast(dict(entries)), todo is None), schema)
        folded = scratch.write(folded, "folded")
        for r in folded.where("first_key is not null").collect():
            ends[r["part"]], latest[r["part"]] = (r["first_key"], r["last_key"], json.loads(r["state"]), r["summary"]), folded
            void.discard(r["part"])
            chains.setdefault(r["part"], r["chains"])
        todo, before = [], None
        for part in sorted(ends):
            first, last, state, summary = ends[part]
            carried = ends[before][2] if before is not None and ends[before][1] == first else None
            if carried != entries.get(part):
                after = composed(summary, carried) if carried is not None else None
                entries[part] = carried
                if after is None:
                    todo.append(part)
                    if known := followed(chains[part], carried, reopen):
                        ends[part] = (first, last, known[0], summary)
                else:
                    void.add(part)
                    ends[part] = (first, last, after if first == last else state, summary)
            before = part
    found = []
    for t in {id(t): t for t in latest.values()}.values():
        own = [p for p, of in latest.items() if of is t]
        rows = t.where(F.col("first_key").isNull() & F.col("part").isin(own))
        found.append(rows.where(~(F.col("head") & F.col("part").isin([p for p in own if p in void]))).select("row", "rule_key", "agg_value"))
    return reduce(DataFrame.unionByName, found)


def fired(matches: DataFrame, reopen_on_expiry: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """event_uid, rule_key, agg_value, and the columns named in `keep`, of the matches that fire, in order of (created, event_uid) in each key.

    The matches that aggregate are written once, with a number for each row, so the events are read and held against the rules once.
    Only narrow rows move; what is kept joins those that fire by row. Keys are counted first: ordinary ones are folded over arrays, larger ones as a
    stream of sorted rows. One with more than half a partition's share of all rows is cut into parts, so that no task gets a hot key whole; there are
    at most twice as many of them as partitions.
    """
    spark = matches.sparkSession
    scratch = Scratch(spark)
    rows = keyed(matches).withColumn("row", F.monotonically_increasing_id())
    keep = tuple(c for c in keep if c not in ("event_uid", "rule_key", "agg_value"))
    rows = scratch.write(rows.select(*_NARROW, *[F.col(c).alias(f"keep_{c}") for c in keep]), "matches")
    narrow = rows.select(*_NARROW)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = scratch.write(narrow.groupBy("rule_key", "state_key").count(), "sizes")
    sums = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)), F.count(F.when(F.col("count") > ARRAY_ROWS, 1))).first()
    key, ordered = ["rule_key", "state_key"], lambda some: some.repartition("rule_key", "state_key").sortWithinPartitions(*_ORDER)
    changed = bool(registered())  # the array fold knows the built-in ones only
    if sums[1] <= ARRAY_ROWS and not changed:
        found = _array_fold(narrow, reopen_on_expiry)
    else:
        large = sizes.where((F.col("count") > ARRAY_ROWS) & (F.col("count") * 2 * parts <= sums[0])).select(*key)
        hot = sizes.where((F.col("count") > ARRAY_ROWS) & (F.col("count") * 2 * parts > sums[0])).select(*key)
        rest, found = narrow, []
        if hot.take(1):
            found.append(_fired_in_parts(scratch, narrow.join(F.broadcast(hot), key, "left_semi").select(*_NARROW), parts, reopen_on_expiry))
            rest = rest.join(F.broadcast(hot), key, "left_anti").select(*_NARROW)
        streamed = lambda some: ordered(some).mapInArrow(_fold(reopen_on_expiry), _FIRED)
        if changed or sums[2] > BROADCAST_KEYS:
            found.append(streamed(rest))
        else:
            if large.take(1):
                found.append(streamed(rest.join(F.broadcast(large), key, "left_semi").select(*_NARROW)))
            found.append(_array_fold(rest.join(F.broadcast(large), key, "left_anti").select(*_NARROW), reopen_on_expiry))
        found = reduce(DataFrame.unionByName, found)
    found = scratch.write(found.select("row", "agg_value"), "fired")
    found = F.broadcast(found) if found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else found  # else what is kept would move for every match
    own = rows.select("row", "event_uid", "rule_key", *[F.col(f"keep_{c}").alias(c) for c in keep])
    return own.join(found, "row").drop("row").select("event_uid", "rule_key", "agg_value", *keep)


def threshold_matches(matches: DataFrame, reopen_on_expiry: bool = False) -> DataFrame:
    """The matches that alert: those of rules without aggregation as they are, of the others those that fire (with agg_value).

    matches is read for each of the two kinds: write it first, unless it is cheap or of one kind.
    """
    names = [c for c in matches.columns if c != "agg_value"]
    plain = matches.where(F.col("agg_fn").isNull() & F.col("timeframe_sec").isNull()).select(*names, F.lit(None).cast("long").alias("agg_value"))
    return plain.unionByName(fired(matches, reopen_on_expiry, tuple(names)).select(*names, "agg_value"))


def threshold_test(value: Column, op: str, threshold: int) -> Column:
    """The threshold test alone, on a column."""
    return OPS[op](value, F.lit(threshold))
