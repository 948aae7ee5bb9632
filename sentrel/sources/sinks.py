"""Sinks: tables in which a micro-batch owns one folder, written at most once; or any format that Spark writes.

The folder's name carries the streaming query's id, which its checkpoint keeps, and the batch's number. So a batch that is tried again finds its
folder there, while a query with a new checkpoint writes beside what others have written, whatever the numbers of its batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, int], None]


def index_name(prefix: str, day: Column, status: Column | None = None) -> Column:
    """Name of the day's index: <prefix>[<status>-]<yyyy-MM-dd>."""
    return F.concat(F.lit(prefix), *([status, F.lit("-")] if status is not None else []), F.date_format(day, "yyyy-MM-dd"))


def batch_name(spark: SparkSession, batch_id: int) -> str:
    """Of a micro-batch: the id of its query, if it is in one, and its number."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query}-{batch_id}" if query else str(batch_id)


def _place(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _place(spark, name)
    return fs.exists(path)


def write_once(df: DataFrame, folder: str, batch_id: int, by: str | None = None, flush_rows: int = 0) -> bool:
    """Writes df to <folder>/batch=<its batch's name>, unless that is there: a retried batch isn't written, nor read by who reads the folder, twice.

    Rows are written beside it and renamed as a whole, so a reader sees all of a batch or nothing. flush_rows: rows of a file, at most.
    """
    spark = df.sparkSession
    done, fs = _place(spark, f"{folder}/batch={batch_name(spark, batch_id)}")
    begun, _ = _place(spark, f"{folder}/_begun-{uuid.uuid4().hex}")
    if fs.exists(done):
        df.write.format("noop").mode("overwrite").save()  # computed all the same, since a stateful query's state moves on with it
        return False
    writer = df.write.option("maxRecordsPerFile", flush_rows)
    (writer.partitionBy(by) if by else writer).parquet(begun.toString())
    if not fs.rename(begun, done):
        fs.delete(begun, True)
        raise OSError(f"{done.toString()} can't be written")
    return True


def append_events(path: str, prefix: str = "events-", flush_rows: int = 0) -> Sink:
    """For foreachBatch: events to a table whose batches are partitioned by index of the processing day."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_once(batch.withColumn("index", index_name(prefix, F.current_date())), path, batch_id, "index", flush_rows)

    return write


def upsert_alerts(path: str, prefix: str = "alerts-", flush_rows: int = 0) -> Sink:
    """For foreachBatch: alerts that the table lacks, by alert_uid, partitioned by index of status and day.

    The day is that of the event (a column event_day, which isn't stored), so a replay meets what it wrote before in the same index; without
    one it is the processing day. Only the indexes that a batch touches are looked through, and only their ids are read. One job writes a table
    at a time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{path}/batch={batch_name(spark, batch_id)}"):
            batch.write.format("noop").mode("overwrite").save()
            return
        own_day = F.col("event_day").cast("date") if "event_day" in batch.columns else F.lit(None).cast("date")
        own = batch.withColumn("index", index_name(prefix, F.coalesce(own_day, F.current_date()), F.col("rule_status"))).drop("event_day")
        own = own.dropDuplicates(["alert_uid"]).persist()  # of a batch; the ids below are looked up before it is written
        try:
            touched = [r["index"] for r in own.select("index").distinct().collect()]  # statuses times days
            if touched and _batches(spark, path):
                known = spark.read.schema("alert_uid string, index string").option("basePath", path).parquet(f"{path}/batch=*").where(F.col("index").isin(touched))
                new = own.join(known.select("alert_uid"), "alert_uid", "left_anti").select(*own.columns)
            else:
                new = own
            write_once(new, path, batch_id, "index", flush_rows)
        finally:
            own.unpersist()

    return write


def _batches(spark: SparkSession, path: str) -> bool:
    at, fs = _place(spark, f"{path}/batch=*/index=*")
    return bool(len(fs.globStatus(at) or ()))


def to_format(name: str, options: dict[str, str], prefix: str, status: bool = False) -> Sink:
    """For foreachBatch: rows to any sink that Spark has a format for (a search index, Kafka, JDBC). Hosts, users, certificates and timeouts
    are that format's own options. Delivery is at least once; alert_uid or event_uid is the id under which a repeated row replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.drop("event_day").withColumn("index", index_name(prefix, F.current_date(), F.col("rule_status") if status else None)).write.format(name).options(**options).mode("append").save()

    return write


ALERT = "alert_uid string, rule_id string, condition_idx int, rule_name string, rule_status string, rule_level string, tags array<string>, fields map<string,string>, rule_event string, agg_value long, alert_processing_time string"


DETAILS = ", rule_description string, rule_author string, rule_references array<string>, rule_falsepositives array<string>"


def read_alerts(spark: SparkSession, path: str, details: bool = False) -> DataFrame:
    """Alerts, each once: the sink has seen to that. A table without any has none. details: with what rules say of themselves."""
    path = path.removesuffix("/batch=*")
    schema = f"{ALERT}, index string{DETAILS if details else ''}"
    if not _batches(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
