"""A cache of lookups as a table in buckets by value: a lookup reads the buckets in which its values fall, one sorted file each."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "value string, tag string, attr_type string, payload string, expires_at timestamp"
_VERSION = re.compile(r"bucket=(\d+)of(\d+)/v=(\d+)$")


class BucketedCache:
    """Entries (value, tag, attr_type, payload, expires_at) below a path.

    A bucket is a folder with a version number, replaced by the next one as a whole: the old entries that still live and the new ones, of one
    key the one that lives longest. The version before stays, for who reads it just then. One job adds to a cache at a time. A cache of
    another number of buckets counts as empty.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _place(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, list[tuple[int, str]]]:
        """Of each bucket its versions in order, with their paths."""
        at, fs = self._place(f"{self.path}/bucket=*/v=*")
        out: dict[int, list[tuple[int, str]]] = {}
        for status in fs.globStatus(at) or ():
            name = status.getPath().toString()
            m = _VERSION.search(name)
            if m and int(m[2]) == self.buckets:
                out.setdefault(int(m[1]), []).append((int(m[3]), name))
        return {b: sorted(v) for b, v in out.items()}

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _of(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self.bucket(F.col("value")).alias("b")).distinct().collect()]  # as many as there are buckets

    def _entries(self, buckets: list[int], versions: dict[int, list[tuple[int, str]]]) -> DataFrame:
        paths = [versions[b][-1][1] for b in sorted(buckets) if b in versions]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The entries of the buckets in which the values of keys fall; all, without keys."""
        versions = self._versions()
        return self._entries(list(versions) if keys is None else self._of(keys), versions)

    def add(self, new: DataFrame, now: Column) -> None:
        """new: entries, cheap to read twice. Expired entries of the buckets that change go."""
        names = [c.split(" ")[0] for c in ENTRY.split(", ")]
        touched, versions = self._of(new), self._versions()
        if not touched:
            return
        every = self._entries(touched, versions).unionByName(new.select(*names)).where(F.col("expires_at") > now)
        best = every.groupBy("value", "tag", "attr_type").agg(F.max_by("payload", "expires_at").alias("payload"), F.max("expires_at").alias("expires_at"))
        begun = f"{self.path}/_begun-{uuid.uuid4().hex}"
        best.withColumn("b", self.bucket(F.col("value"))).repartition("b").sortWithinPartitions("b", "value").write.partitionBy("b").parquet(begun)
        for b in touched:
            old = versions.get(b, [])
            made, fs = self._place(f"{begun}/b={b}")
            if not fs.exists(made):  # all of it has expired
                fs.mkdirs(made)
            folder, _ = self._place(f"{self.path}/bucket={b}of{self.buckets}")
            fs.mkdirs(folder)
            if not fs.rename(made, self._place(f"{folder.toString()}/v={(old[-1][0] if old else 0) + 1}")[0]):
                raise OSError(f"bucket {b} of {self.path} can't be written")
            for _, name in old[:-1]:
                fs.delete(self._place(name)[0], True)
        at, fs = self._place(begun)
        fs.delete(at, True)
