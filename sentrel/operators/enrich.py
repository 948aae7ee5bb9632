"""Enrichment: values of mapped fields are looked up in threat-intelligence and DNS tables."""

from __future__ import annotations

import itertools
import logging
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.scratch import Scratch
from sentrel.sources.cache import BucketedCache

from .events import Resolver

log = logging.getLogger(__name__)

#: Rows up to which a lookup table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
ATTRIBUTES = "field string, tag string, attr_type string, kind string, public_only boolean, resolve boolean"


def attribute_rows(mapping: dict) -> list[tuple]:
    """Flattens {path: {tag: [{mispAttribute, type, enrichPublicOnly | resolveName}]}}; entries without their option are skipped."""
    out = []
    for path, tags in mapping.items():
        for tag, entries in tags.items():
            for e in entries:
                kind = e.get("type")
                if kind == "ip" and "enrichPublicOnly" in e:
                    out.append((path, tag, e["mispAttribute"], "ip", bool(e["enrichPublicOnly"]), False))
                elif kind == "domain" and "resolveName" in e:
                    out.append((path, tag, e["mispAttribute"], "domain", False, bool(e["resolveName"])))
    return list(dict.fromkeys(out))


def attributes_frame(spark: SparkSession, mapping: dict) -> DataFrame:
    return spark.createDataFrame(attribute_rows(mapping), ATTRIBUTES)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_GROUPS = "(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(v4: Column) -> Column:
    """The two numbers of 16 bits of an address in IPv4 form."""
    return _let(F.transform(F.split(v4, r"\."), lambda x: x.cast("int")), lambda o: F.array(o[0] * 256 + o[1], o[2] * 256 + o[3]))


def _six(w: Column) -> Column:
    """The eight numbers of an address in IPv6 form without an IPv4 tail."""
    parts = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))
    numbers = lambda g: F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))
    both = F.struct(parts(F.substring_index(w, "::", 1)).alias("head"), parts(F.substring(w, F.instr(w, "::") + 2, F.length(w))).alias("tail"))
    left = lambda s: 8 - F.size(s["head"]) - F.size(s["tail"])
    filled = _let(both, lambda s: F.when(left(s) >= 1, numbers(F.concat(s["head"], F.array_repeat(F.lit("0"), left(s)), s["tail"]))))
    full = _let(F.split(w, ":"), lambda g: F.when(F.size(g) == 8, numbers(g)))
    return F.when(w.rlike(f"^{_GROUPS}(?:::)?{_GROUPS}\\z"), F.when(F.instr(w, "::") > 0, filled).otherwise(full))


def address(ip: Column) -> Column:
    """An address as eight numbers of 16 bits, null for text that is none. IPv4 is in its mapped form, ::ffff:a.b.c.d.

    IPv6 may be compressed (`::` once, for one group or more), end in an IPv4 address and name a scope behind `%`; octets have no leading zeros.
    """
    head = F.array(*[F.lit(x) for x in (0, 0, 0, 0, 0, 65535)])

    def six(base: Column) -> Column:
        tail = F.regexp_extract(base, r"([0-9]+\.[0-9.]*)\z", 1)
        groups = lambda q: F.array_join(F.transform(_pair(q), lambda x: F.hex(x)), ":")
        return _let(tail, lambda q: F.when(q == "", _six(base)).when(q.rlike(_V4), _six(F.concat(F.substring(base, F.lit(1), F.length(base) - F.length(q)), groups(q)))))

    scoped = F.when(ip.rlike(r"^[^%]*:[^%]*(?:%[^%]+)?\z"), _let(F.substring_index(ip, "%", 1), six))
    return F.when(ip.rlike(_V4), F.concat(head, _pair(ip))).otherwise(scoped)


def is_public_ip(ip: Column) -> Column:
    """Not site-local, loopback, link-local or multicast; IPv4 in a mapped IPv6 address counts by itself. Text that is no address isn't public."""

    def public(g: Column) -> Column:
        a, b = F.floor(g[6] / 256), g[6] % 256
        mapped = (g[5] == 65535) & (g[0] + g[1] + g[2] + g[3] + g[4] == 0)
        private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254)) | a.between(224, 239)
        loopback = (g[7] == 1) & (g[0] + g[1] + g[2] + g[3] + g[4] + g[5] + g[6] == 0)
        local = loopback | g[0].between(0xFE80, 0xFEFF) | (g[0] >= 0xFF00)
        return F.when(mapped, ~private).otherwise(~local)

    return F.coalesce(_let(address(ip), public), F.lit(False))


def requests(events: DataFrame, attributes: DataFrame, paths: list[str], resolve: Resolver) -> DataFrame:
    """event_uid, field, value, tag, attr_type, kind, resolve: what is to be looked up, once per event."""
    pairs = F.array(*[F.struct(F.lit(p).alias("field"), resolve(p)[0].alias("value")) for p in paths])
    found = events.select("event_uid", F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("x")).select("event_uid", "x.*")
    asked = found.join(F.broadcast(attributes), "field")  # the map's size is that of a configuration file
    return asked.where(~F.col("public_only") | is_public_ip(F.col("value"))).drop("public_only").distinct()


def checked(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def lookup_intel(asked: DataFrame, intel: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per event that has any hit: event ids (not de-duplicated), distinct categories and tags, each in order.

    intel: tag, attr_type, value, event_id, category, attr_tags. Its lists are made once per value, whatever the number of events that
    ask for it; the table's own rows, not its values, decide on a broadcast, as they bound the lists' size.
    """
    key = ["tag", "attr_type", "value"]
    flat = lambda c: F.flatten(F.collect_list(c))
    known = intel.groupBy(*key).agg(F.collect_list("event_id").alias("ids"), F.collect_set("category").alias("categories"), F.array_distinct(F.flatten(F.collect_set("attr_tags"))).alias("tags"))
    hits = asked.join(F.broadcast(known) if intel.limit(broadcast_rows + 1).count() <= broadcast_rows else known, key)
    lists = hits.groupBy("event_uid").agg(F.array_sort(flat("ids")).alias("ids"), F.array_sort(F.array_distinct(flat("categories"))).alias("categories"), F.array_sort(F.array_distinct(flat("tags"))).alias("tags"))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    return lists.select("event_uid", full("ids").alias("intel_event_id"), full("categories").alias("intel_attribute_category"), full("tags").alias("intel_attribute_tags"))


def lookup_dns(asked: DataFrame, dns: DataFrame) -> DataFrame:
    """Per event with a name to resolve that is known: the first address of each name. dns: name, addresses."""
    names = asked.where("kind = 'domain' and resolve").select("event_uid", F.col("value").alias("name")).distinct()
    hits = names.join(checked(dns), "name").where(F.size("addresses") > 0)
    return hits.groupBy("event_uid").agg(F.array_sort(F.collect_set(F.element_at("addresses", 1))).alias("dns_resolved_address"))


def enrich(events: DataFrame, asked: DataFrame, intel: DataFrame | None = None, dns: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """events with the lookups' columns; every event comes out once, with nulls where there is nothing."""
    out = events
    if enabled and intel is not None:
        out = out.join(lookup_intel(asked, intel), "event_uid", "left")
    if enabled and dns is not None:
        out = out.join(lookup_dns(asked, dns), "event_uid", "left")
    return out


Lookup = DataFrame | Callable[[DataFrame], DataFrame | None] | None


#: Of a partition of rows that repeat texts. A Parquet writer keeps a text once in a file whose different texts stay below 1 MB, and else one for every
#: row. So a partition ends before TEXT_BYTES of different texts, unless its rows hold less than REPEATS times these and ROW_BYTES, and before ROWS rows.
TEXT_BYTES, ROW_BYTES, REPEATS, ROWS = 1_000_000, 64_000_000, 4, 500_000
#: Hash values by which combinations of values are counted; at most so many rows of four numbers pass the driver.
CELLS = 1 << 16


def deal(cells: list[tuple[int, int, int, int]], text_bytes: int, row_bytes: int, rows: int) -> tuple[list[tuple[int, int, int]], int]:
    """((cell, its first partition, how many it has), the number of partitions). cells: cell, bytes of its texts, rows, bytes of texts in its rows.

    A cell of more rows than a partition may have is dealt over several, which it shares with no other.
    """
    out, n, held = [], 0, None  # held: what the last partition has, if it takes more
    for cell, *own in sorted(cells):
        if own[1] > rows:
            parts = -(-own[1] // rows)
            out.append((cell, n, parts))
            n, held = n + parts, None
            continue
        more = [x + y for x, y in zip(held, own, strict=True)] if held else None
        if not more or more[1] > rows or (more[0] > text_bytes and more[2] > min(row_bytes, REPEATS * more[0])):
            n, more = n + 1, own
        out.append((cell, n - 1, 1))
        held = more
    return out, n


def _dealt(keyed: DataFrame, rich: DataFrame, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both by the partition that `deal` gives to their values, in `asked_place`: an event has one, a row of texts stands in each that its events have."""
    cell = F.pmod(F.xxhash64("asked_values"), F.lit(CELLS)).cast("int").alias("asked_cell")
    held = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 4 for c in texts), F.lit(0)).cast("long").alias("held")
    sizes = rich.select(cell, held, "asked_by").groupBy("asked_cell").agg(F.sum("held"), F.sum("asked_by"), F.sum(F.col("held") * F.col("asked_by")))
    places, n = deal([tuple(r) for r in sizes.collect()], TEXT_BYTES, ROW_BYTES, ROWS)
    table = F.broadcast(keyed.sparkSession.createDataFrame(places, "asked_cell int, asked_first int, asked_parts int"))
    first, parts = F.col("asked_first"), F.col("asked_parts")

    def place(df: DataFrame, to: Column) -> DataFrame:
        found = df.withColumn("asked_cell", cell).join(table, "asked_cell", "left").withColumn("asked_place", to)
        return found.drop("asked_cell", "asked_first", "asked_parts").repartitionById(max(1, n), F.col("asked_place"))

    return place(keyed, first + F.pmod(F.xxhash64("event_uid"), parts).cast("int")), place(rich, F.explode(F.sequence(first, first + parts - 1)))


def enrich_values(events: DataFrame, attributes: DataFrame, paths: list[str], resolve: Resolver, intel: Lookup = None, dns: Lookup = None, text: Callable[[Column], Column] | None = None) -> DataFrame:
    """`enrich`, with lookups made once for each combination of values that the fields have together, not once for each event.

    Lists of hits are made and moved per combination; an event moves with its own columns and the values, and meets its lists in the last join, which
    is a merge so that no list is broadcast. intel and dns may be functions of the requests, whose event_uid is the combination. text: makes one text of
    a list, before it meets the events. Their sizes are then measured at once, and rows lie so that a file of them holds each text once (see `deal`).
    """
    keyed = events.withColumn("asked_values", F.array(*[resolve(p)[0] for p in paths]).cast("array<string>"))
    own = keyed.groupBy(F.col("asked_values").alias("event_uid")).agg(F.count("*").alias("asked_by"))
    asked = requests(own, attributes, paths, lambda p: (F.col("event_uid")[paths.index(p)], F.lit(False)))
    rich = enrich(own, asked, *[t(asked) if callable(t) else t for t in (intel, dns)]).withColumnRenamed("event_uid", "asked_values")
    found, key = [c for c in rich.columns if c not in ("asked_values", "asked_by")], ["asked_values"]
    if text:
        keyed, rich = _dealt(keyed, rich.select("asked_values", "asked_by", *[text(F.col(c)).alias(c) for c in found]), found)
        key = ["asked_place", "asked_values"]
    joined = keyed.join(rich.drop("asked_by").hint("merge"), key, "left")
    return joined.select(*[F.col(f"`{c.replace('`', '``')}`") for c in (*events.columns, *found)])


Provider = Callable[[list[tuple[str, str, str]]], list[tuple[str, str, str, str]]]
CACHE = "value string, tag string, attr_type string, payload string, expires_at timestamp"
KEY = ("value", "tag", "attr_type")


@dataclass(frozen=True)
class Limits:
    """Of a provider's calls: seconds that one may take, calls at once in a task, calls more after a failure, values asked in one call."""

    seconds: float = 5.0
    threads: int = 6
    retries: int = 1
    values: int = 50


def ask(provider: Provider, asked: list[tuple[str, str, str]], limits: Limits = Limits()) -> tuple[list[tuple[str, str, str, str]], list[tuple[str, str, str, str]]]:
    """(answers, failures: value, tag, attr_type and the reason). A call that raises, answers in another form or takes too long costs its own values only.

    A call beyond its time is left to itself in a daemon thread, and another takes its place.
    """
    waiting = [(asked[i : i + limits.values], 0) for i in range(0, len(asked), limits.values)][::-1]
    running: dict[int, tuple[list, int, float]] = {}
    done: queue.SimpleQueue = queue.SimpleQueue()
    answers, failures, calls = [], [], itertools.count()

    def call(number: int, part: list) -> None:
        try:
            got = [tuple(map(lambda x: x if x is None else str(x), row)) for row in provider(part)]
            if any(len(row) != 4 for row in got):
                raise ValueError("an answer isn't of value, tag, type and payload")
            done.put((number, got, None))
        except Exception as e:  # whatever the provider raises is its answer
            done.put((number, None, f"{type(e).__name__}: {e}"))

    def failed(part: list, tries: int, reason: str) -> None:
        if tries < limits.retries:
            waiting.append((part, tries + 1))
        else:
            failures.extend((*key, reason) for key in part)

    while waiting or running:
        while waiting and len(running) < limits.threads:
            part, tries = waiting.pop()
            number = next(calls)
            running[number] = (part, tries, time.monotonic() + limits.seconds)
            threading.Thread(target=call, args=(number, part), daemon=True).start()
        try:
            number, got, reason = done.get(timeout=max(0.0, min(end for *_, end in running.values()) - time.monotonic()))
            if number in running:  # else it came too late
                part, tries, _ = running.pop(number)
                if reason is None:
                    answers += got
                else:
                    failed(part, tries, reason)
        except queue.Empty:
            for number in [n for n, (*_, end) in running.items() if end <= time.monotonic()]:
                part, tries, _ = running.pop(number)
                failed(part, tries, f"no answer in {limits.seconds:g} seconds")
    return answers, failures


def look_up(asked: DataFrame, cache: DataFrame, provider: Provider, now: Column, ttl_seconds: int = 86400, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers: value, tag, attr_type, payload; new rows for the cache; failures: value, tag, attr_type, reason). Only what the cache lacks or holds
    too long is asked of the provider; what fails has no answer and isn't kept, so it is asked again the next time.

    provider gets (value, tag, attr_type) and returns (value, tag, attr_type, payload); it runs on executors within `limits`, on distinct
    requests, and its answers are written to a table at once, so that no request is repeated whichever of the results is
    read. An empty payload is kept too: a negative answer is an answer. A live entry keeps its expiry.
    """
    keys = asked.select(*KEY).distinct()
    live = cache.where(F.col("expires_at") > now).groupBy(*KEY).agg(F.max_by("payload", "expires_at").alias("payload"))
    missing = keys.join(live, list(KEY), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, failed = ask(provider, [tuple(r[k] for k in KEY) for r in b.to_pylist()], limits)
            rows = [(*g, None) for g in got] + [(*f[:3], None, f[3]) for f in failed]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], [*KEY, "payload", "reason"])

    fetched = Scratch(asked.sparkSession).write(missing.mapInArrow(run, "value string, tag string, attr_type string, payload string, reason string"), "fetched")
    good = fetched.where("reason is null").drop("reason")
    new = good.withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return live.join(keys, list(KEY), "left_semi").unionByName(good), new, fetched.where("reason is not null").select(*KEY, "reason")


def read_through(asked: DataFrame, cache: DataFrame, provider: Provider, now: Column, ttl_seconds: int = 86400) -> tuple[DataFrame, DataFrame]:
    """The answers and the new rows of `look_up`."""
    return look_up(asked, cache, provider, now, ttl_seconds)[:2]


ANSWER = "array<struct<event_id:string,category:string,attr_tags:array<string>>>"


def cached_intel(spark: SparkSession, cache_table: str, provider: Provider, ttl_seconds: int = 86400, buckets: int = 256, limits: Limits = Limits()) -> Callable[[DataFrame], DataFrame]:
    """A function from requests to the lookup table of `lookup_intel`, read through a cache (see sources.cache) that it adds to.

    Payloads are JSON arrays of objects with event_id, category and attr_tags; anything else is no hit, and so is a call that fails: those are logged.
    """
    cache = BucketedCache(spark, cache_table, buckets)

    def intel(asked: DataFrame) -> DataFrame:
        now = F.lit(datetime.now(timezone.utc))  # one time for the whole batch
        keys = Scratch(spark).write(asked.select(*KEY).distinct(), "asked")
        answers, new, failed = look_up(keys, cache.read(keys), provider, now, ttl_seconds, limits)
        answers = Scratch(spark).write(answers, "answers")  # read before the cache changes
        cache.add(new, now)
        if lost := failed.count():
            log.warning("%d lookups failed, the first with %s", lost, failed.first()["reason"])
        return answers.select("tag", "attr_type", "value", F.inline(F.from_json("payload", ANSWER)))

    return intel
