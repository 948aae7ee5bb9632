"""Events: JSON text to VARIANT, the fields that rules name, and log source fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Resolver = Callable[[str], tuple[Column, Column]]
CREATED = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"  # the zone is `Z` or an offset, whatever the session's


def utc(local: Column) -> Column:
    """The instant that a TIMESTAMP_NTZ names in UTC, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), local))


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is worked out once for each row. Filters and projections above it, that Catalyst would write its expression into, read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_events(raw: DataFrame, text_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """raw, v (VARIANT), event_uid, created, logsource, and the columns of raw named in keep. Text that isn't a JSON object has v null: see `quarantine`.

    event_uid is the SHA-256 of the text, so that a replay gives the same alerts; equal texts have one id, but are events each.
    """
    own = once(raw.select(*keep, F.col(text_col).cast("string").alias("raw")), F.try_parse_json("raw"), "json")
    # JSON whose text opens with a brace is an object
    own = own.select(*keep, "raw", F.when(F.col("raw").rlike(r"^[ \t\r\n]*\{"), F.col("json")).alias("v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    return own.select(*keep, "raw", "v", F.sha2("raw", 256).alias("event_uid"), F.try_to_timestamp(get("$.event.created"), F.lit(CREATED)).alias("created"), F.struct(get("$.logsource.category").alias("category"), get("$.logsource.product").alias("product")).alias("logsource"))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("v").isNull()).select("raw")


def rejected(parsed: DataFrame) -> DataFrame:
    """What `parse_events` couldn't read: raw, reason (`no text`, `not JSON`, `no object`) and its other columns but for those of an event."""
    reason = F.when(F.col("raw").isNull(), "no text").when(F.try_parse_json("raw").isNull(), "not JSON").otherwise("no object")
    return parsed.where(F.col("v").isNull()).withColumn("reason", reason).drop("v", "event_uid", "created", "logsource")


def variant_resolver(v: str = "v") -> Resolver:
    """Dotted paths of schemaless events. Arrays and objects have no value, and are told apart from missing ones."""

    def resolve(path: str) -> tuple[Column, Column]:
        keys = "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in path.split("."))
        x = F.try_variant_get(v, keys, "variant")
        kind = F.schema_of_variant(x)
        nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
        return F.when(~nested, F.try_variant_get(v, keys, "string")), nested

    resolve.costly = True
    return resolve


def with_columns(resolve: Resolver, columns: dict[str, str]) -> Resolver:
    """A resolver that also knows paths to SQL expressions over columns, such as those that an enrichment adds."""

    def known(path: str) -> tuple[Column, Column]:
        return (F.expr(columns[path]).cast("string"), F.lit(False)) if path in columns else resolve(path)

    known.costly = getattr(resolve, "costly", False)
    return known


def struct_resolver(root: str | None = None) -> Resolver:
    """Dotted paths of typed nested columns, all of which must exist."""

    def resolve(path: str) -> tuple[Column, Column]:
        name = ".".join(f"`{k}`" for k in ([root] if root else []) + path.split("."))
        return F.col(name).cast("string"), F.lit(False)

    return resolve


def column_resolver(columns: dict[str, str]) -> Resolver:
    """Paths to SQL expressions over flat columns; other paths are missing."""

    def resolve(path: str) -> tuple[Column, Column]:
        return (F.expr(columns[path]).cast("string") if path in columns else F.lit(None).cast("string")), F.lit(False)

    return resolve


def project_fields(events: DataFrame, paths: Iterable[str], resolve: Resolver, null_paths: Iterable[str] = ()) -> DataFrame:
    """events with a struct `f` of the named paths only, each extracted once, as strings. Fields of columns are left for Catalyst to push to the source."""
    parts = [resolve(p)[0].alias(p) for p in sorted(set(paths))] + [resolve(p)[1].alias(p + "#nested") for p in sorted(set(null_paths))]
    f = F.struct(*(parts or [F.lit(None).cast("string").alias("none")]))
    return once(events.drop("f"), f, "f") if getattr(resolve, "costly", False) else events.withColumn("f", f)


def fan_out(events: DataFrame, active: set[tuple[str | None, str | None]]) -> DataFrame:
    """One row per log source of the event that some rule has: both parts, the category alone, the product alone."""
    known = F.array(*[F.struct(F.lit(c).cast("string").alias("category"), F.lit(p).cast("string").alias("product")) for c, p in sorted(active, key=str)])
    own, none = F.col("logsource"), F.lit(None).cast("string")
    forms = F.array(own, F.struct(own["category"].alias("category"), none.alias("product")), F.struct(none.alias("category"), own["product"].alias("product")))
    kept = F.filter(F.array_distinct(forms), lambda s: F.array_contains(known, s) & (s["category"].isNotNull() | s["product"].isNotNull()))
    return events.withColumn("route", F.explode(kept)) if active else events.withColumn("route", own).limit(0)
