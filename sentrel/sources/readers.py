"""Event sources, batch and streaming alike."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.operators.events import utc

from .config import Config


def kafka_options(c: Config, streaming: bool = True) -> dict[str, str]:
    """Options of Spark's Kafka source: a list of topics wins over a pattern.

    start: earliest, latest (streams only: a batch that starts at the end has no rows), milliseconds since 1970, the offsets of each partition as
    JSON (`{"topic": {"0": 17}}`; -2 is the earliest, -1 the latest), or group. The place of a
    group is kept in the stream's checkpoint, so `group` only decides where a stream without one starts: at the latest event. A batch has no
    checkpoint and reads from the earliest.
    """
    out = {"kafka.bootstrap.servers": c.bootstrap_servers}
    if c.topics:
        out["subscribe"] = ",".join(t.strip() for t in c.topics.split(",") if t.strip())
    elif c.topic_pattern:
        out["subscribePattern"] = c.topic_pattern
    else:
        raise ValueError("topics or topic_pattern is needed")
    if c.group_id:
        out["kafka.group.id"] = c.group_id
    if c.start.isdigit():
        if int(c.start) == 0:
            raise ValueError("a start timestamp must not be 0")
        out["startingTimestamp"] = c.start
    elif c.start == "latest" and not streaming:
        raise ValueError("a batch can't start at the latest event")
    elif c.start in ("earliest", "latest"):
        out["startingOffsets"] = c.start
    elif c.start.startswith("{"):
        out["startingOffsets"] = offsets_text(c.start)
    elif c.start == "group":
        out["startingOffsets"] = "latest" if streaming else "earliest"
    else:
        raise ValueError(f"start {c.start}")
    return out | {("kafka." + k if k.startswith("security.") else "kafka.ssl." + k): v for k, v in c.tls.items()}


def offsets_text(text: str) -> str:
    """Offsets per topic and partition in the form that Spark's source reads; raises ValueError for any other text."""
    found = json.loads(text)
    if not all(isinstance(parts, dict) and all(p.isdigit() and isinstance(o, int) and o >= -2 for p, o in parts.items()) for parts in found.values()):
        raise ValueError(f"offsets {text}")
    return json.dumps(found, sort_keys=True)


def event_source(spark: SparkSession, kind: str, where: str | Config, streaming: bool = False, origin: bool = False) -> DataFrame:
    """A frame with a string column `value`, and if asked `origin`: topic, partition and offset, or the file and the byte its block starts at.

    kind: kafka (where: Config), text (JSON lines), or parquet (a column `value`).
    """
    reader = spark.readStream if streaming else spark.read
    in_file = F.concat_ws(":", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string"))
    if kind == "kafka":
        rows = reader.format("kafka").options(**kafka_options(where, streaming)).load()
        return rows.select(F.col("value").cast("string").alias("value"), *([F.concat_ws(":", "topic", "partition", "offset").alias("origin")] if origin else []))
    if kind not in ("text", "parquet"):
        raise ValueError(f"source {kind}")
    rows = reader.text(where) if kind == "text" else reader.schema("value string").parquet(where)
    return rows.select("value", in_file.alias("origin")) if origin else rows


def instant(text: str) -> Column:
    """A date or time as an instant: in UTC unless it names a zone."""
    named = re.search(r"(?:Z|[+-]\d\d:?\d\d)$", text.strip())
    return F.lit(text).cast("timestamp") if named else utc(F.lit(text).cast("timestamp_ntz"))


def replay(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events created in [since, until): detection on the past is the same code on a batch frame."""
    out = events
    if since is not None:
        out = out.where(F.col("created") >= instant(since))
    return out if until is None else out.where(F.col("created") < instant(until))
