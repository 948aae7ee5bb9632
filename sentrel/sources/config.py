"""Settings of a deployment: one frozen record, read from a properties file or given directly."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    topics: str | None = None  # comma-separated list
    topic_pattern: str | None = None  # used only without a list
    bootstrap_servers: str = "localhost:9092"
    group_id: str | None = None
    start: str = "group"  # earliest, latest, group, milliseconds since 1970, or JSON of offsets per topic and partition
    tls: dict[str, str] = field(default_factory=dict)  # options of the Kafka client below `ssl.`, and security.protocol
    source: str = "kafka"  # or text, parquet: then source_path names the folder
    source_path: str | None = None
    rules: str | None = None
    maps: str | None = None
    global_map: str | None = None
    match_table: str = "matches"
    event_table: str = "events"
    alert_table: str = "alerts"
    rejected_table: str | None = None  # of lines that are no events; by default beside the event table
    checkpoint: str = "checkpoints"
    sink: str = "parquet"  # or any format that Spark writes, with sink_options
    sink_options: dict[str, str] = field(default_factory=dict)  # keys below `sink.`: hosts, users, certificates, timeouts, batch sizes
    alert_index: str = "alerts-"
    event_index: str = "events-"
    flush_rows: int = 0  # of a file of the parquet sinks, at most; 0: no limit
    enrichment: bool = False
    match_enriched: bool = False  # rules are held against enriched events
    alert_details: bool = False  # alerts carry their rule's description, author, references and false positives
    intel_map: str | None = None
    intel_table: str | None = None
    dns_table: str | None = None
    cache_table: str = "cache"  # of answers of a provider
    cache_ttl_seconds: int = 86400
    cache_buckets: int = 256  # files of the cache, one per bucket of values
    lookup_timeout_ms: int = 5000  # of one call of a provider
    lookup_threads: int = 6  # calls at once in a task
    lookup_retries: int = 1
    lookup_values: int = 50  # asked in one call
    trigger: str | None = None  # such as `10 seconds`; without one, what is there now is worked on and the job ends
    max_files: int = 0  # of matches that an alerting micro-batch takes; 0: all
    reopen_on_expiry: bool = False
    forget_after_seconds: int = 0  # after which an idle threshold key is forgotten; 0: never
    event_time: bool = False  # idle by the events' own time, not by the clock
    delay_seconds: int = 0  # by which events may be late then


def read_properties(path: str) -> dict[str, str]:
    """key=value lines; # and ! start comments; a backslash at a line's end joins it with the next."""
    out, kept = {}, ""
    for line in Path(path).read_text().splitlines():
        line = kept + line.strip()
        kept = ""
        if line.endswith("\\"):
            kept = line[:-1]
        elif line and line[0] not in "#!":
            k, _, v = line.partition("=")
            out[k.strip()] = v.strip()
    return out


def load_config(path: str) -> Config:
    """Keys are the names of Config's fields; `tls.` and `sink.` keys go to its maps. Unknown keys are an error."""
    raw, kinds, values, tls, sink = read_properties(path), {f.name: f.type for f in fields(Config)}, {}, {}, {}
    for k, v in raw.items():
        if k.startswith("tls."):
            tls[k[4:]] = v
        elif k.startswith("sink."):
            sink[k[5:]] = v
        elif k not in kinds:
            raise ValueError(f"unknown key {k}")
        else:
            values[k] = int(v) if kinds[k] == "int" else v.lower() == "true" if kinds[k] == "bool" else v
    return Config(**values, tls=tls, sink_options=sink)
