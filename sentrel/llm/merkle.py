"""Merkle manifest: a hash tree over each group's rows in order, a tree over the groups' roots, and proofs for all rows.

Leaves, hashed where the rows are, are sorted by range into partitions and written with their place in their group's
part of the partition; the counts of a group's parts before are a part's offset, so each leaf has its coordinate. Tasks walk
the leaves in order and build every aligned subtree whose leaves they see whole. Only nodes at the ragged ends of what a task saw
move, by coordinate, level by level, until the upper levels are finished. Groups' roots go through the same steps.

Proofs are made in blocks of whole subtrees: the path above a block is handed down from the root once for all its leaves, and what
is below is built again in the task that holds the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch, checked_broadcast, own_columns, small_batches, table, with_fields

ARITY = 16
BLOCK_LEVELS = 3  # a task holds the leaves of a node of this level together: at most 16^3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5
HEX = 64  # characters of a digest
PROOF = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.StringType()))]))


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, proof: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that a leaf leads to. proof: from the leaf up, a node's place in its run and the run's other digests, left to right."""
    for at, siblings in proof:
        leaf = digest(*siblings[:at], leaf, *siblings[at:])
    return leaf


def leaf_of(columns: dict[str, Column]) -> Column:
    """SHA-256 of the columns' values one behind another, each `-` for null, else its UTF-8 bytes behind their number and `:`."""
    parts = []
    for c in columns.values():
        s = c.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the number of the group's rows before them."""
    now, n = None, 0
    for batch in batches:
        out = []
        for g in batch.column("g").to_pylist():
            now, n = (g, 0) if g != now else (now, n + 1)
            out.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "i"])


NODES = "g binary, n long, level int, idx long, digest string, ragged boolean"


class _Subtrees:
    """Nodes over the leaves of one group, as they come in order."""

    def __init__(self, g: bytes, n: int, out: list[tuple]):
        self.g, self.n, self.out, self.open = g, n, out, []

    def add(self, level: int, idx: int, d: str) -> None:
        """A node. It waits for its run; a full run goes out under a node of its own, what doesn't go on is ragged."""
        wide = -(-self.n // ARITY**level)
        if wide == 1:
            self.out.append((self.g, self.n, level, idx, d, False))
            return
        while len(self.open) <= level:
            self.open.append([])
        run = self.open[level]
        if run and (run[-1][0] + 1 != idx or idx % ARITY == 0):
            self.flush(level)
        run.append((idx, d))
        if run[0][0] % ARITY == 0 and (len(run) == ARITY or idx + 1 == wide):
            if level:
                self.out.extend((self.g, self.n, level, i, x, False) for i, x in run)
            above = digest(*[x for _, x in run])
            run.clear()
            self.add(level + 1, idx // ARITY, above)

    def flush(self, level: int) -> None:
        self.out.extend((self.g, self.n, level, i, x, True) for i, x in self.open[level])
        self.open[level].clear()

    def end(self) -> None:
        for level in range(len(self.open)):
            self.flush(level)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["g", "n", "level", "idx", "digest", "ragged"], [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]

    def sent(out: list[tuple]) -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)
        out.clear()
        return got

    now, out = None, []
    for batch in batches:
        for g, n, idx, d in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "idx", "digest")), strict=True):
            if now is None or now.g != g:
                if now:
                    now.end()
                now = _Subtrees(g, n, out)
            now.add(0, idx, d)
        if out:
            yield sent(out)
    if now:
        now.end()
    if out:
        yield sent(out)


class Tree:
    """The hash trees of all groups. rows: g (binary), digest, the columns of `order` and any others.

    leaves: the rows with idx (place in the group) and n (the group's rows). nodes: g, n, level, idx, digest of all nodes above the
    leaves, and of single leaves. height: levels above the leaves in the largest group.
    """

    def __init__(self, scratch: Scratch, rows: DataFrame, order: list[Column]):
        parts = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
        ranged = rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("g", *order)
        ranged = scratch.write(ranged.mapInArrow(_counted, with_fields(ranged, i=T.LongType())), "ranged")
        runs = scratch.write(ranged.groupBy("g", "part").agg(F.count("*").alias("c")), "runs")
        before = F.sum("c").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        starts = scratch.write(runs.select("g", "part", F.coalesce(before, F.lit(0)).alias("start"), F.sum("c").over(W.partitionBy("g")).alias("n")), "starts")
        self.leaves = ranged.join(checked_broadcast(starts), ["g", "part"]).withColumn("idx", F.col("start") + F.col("i")).drop("part", "start", "i")
        largest, self.height = starts.agg(F.max("n")).first()[0] or 0, 0
        while ARITY**self.height < largest:
            self.height += 1

        local = self.leaves.select("g", "n", "idx", "digest").sortWithinPartitions("g", "idx").mapInArrow(_subtrees, NODES)
        local = scratch.write(local, "nodes")
        found, moved = [local.where("level > 0 or n = 1").drop("ragged")], local.where("ragged and level = 0").drop("ragged")
        for level in range(self.height):
            run = F.array_sort(F.collect_list(F.struct("idx", "digest")))  # at most ARITY
            above = moved.groupBy("g", "n", F.floor(F.col("idx") / ARITY).cast("long").alias("up")).agg(F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
            above = scratch.write(above.select("g", "n", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), "digest"), "above")
            found.append(above)
            moved = above.where(self.wide(level + 1) > 1).unionByName(local.where((F.col("level") == level + 1) & F.col("ragged")).drop("ragged"))
        self.nodes = found[0]
        for more in found[1:]:
            self.nodes = self.nodes.unionByName(more)

    @staticmethod
    def wide(level: int) -> Column:
        """Nodes of that level in the row's group of n leaves."""
        return F.expr(f"(n + {ARITY**level - 1}) div {ARITY**level}")

    def tops(self) -> DataFrame:
        """g, n, level and digest of each group's root."""
        top = F.coalesce(*[F.when(self.wide(level) == 1, F.lit(level)) for level in range(self.height + 1)])
        return self.nodes.where(F.col("level") == top).select("g", "n", "level", "digest")

    def paths(self, scratch: Scratch, tops: DataFrame, down_to: int) -> DataFrame:
        """tops: g, n, level, path (of the groups' roots, further up). The path of every node of the level `down_to`, and of roots that are below it.

        A path is an array, from the node up, of the node's place in its run and the run's digests one behind another.
        """
        last = tops.where(F.col("level") >= self.height).select("g", F.lit(0).cast("long").alias("idx"), "path")
        out = [tops.where(F.col("level") < down_to).select("g", F.lit(0).cast("long").alias("idx"), "path")]
        for level in range(self.height - 1, down_to - 1, -1):
            here = self.nodes if level else self.leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest")
            here = here.where((F.col("level") == level) & (self.wide(level) > 1))
            runs = here.groupBy("g", F.floor(F.col("idx") / ARITY).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
            digests = F.array_join(F.transform("run", lambda x: x["digest"]), "")
            below = runs.join(last.withColumnRenamed("idx", "up"), ["g", "up"]).select("g", "path", digests.alias("digests"), F.explode("run").alias("own"))
            step = F.struct((F.col("own.idx") % ARITY).cast("int").alias("at"), F.col("digests").alias("run"))
            last = below.select("g", F.col("own.idx").alias("idx"), F.concat(F.array(step), "path").alias("path"))
            last = scratch.write(last.unionByName(tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("idx"), "path")), "paths")
        return last.unionByName(out[0]) if down_to else last


def _proved(with_proofs: bool):
    """Of a block's leaves: the proof's hash, the root that the leaf or what stands in for it leads to, and the proof itself if asked for."""

    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("idx")
        head = above.to_pylist()[0]
        path = [(p["at"], [p["run"][i : i + HEX] for i in range(0, len(p["run"]), HEX)]) for p in head["path"]]
        upper = [(at, [*digests[:at], *digests[at + 1 :]]) for at, digests in path]
        levels = [leaves.column("digest").to_pylist()]
        for _ in range(min(BLOCK_LEVELS, head["height"])):
            last = levels[-1]
            levels.append([digest(*last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
        hashes, folded, proofs = [], [], []
        for i, claimed in enumerate(leaves.column("claimed").to_pylist()):
            proof, at = [], i
            for nodes in levels[:-1]:
                first = at - at % ARITY
                proof.append((at % ARITY, [*nodes[first:at], *nodes[at + 1 : first + ARITY]]))
                at //= ARITY
            proof += upper
            hashes.append(digest(*[s for _, siblings in proof for s in siblings]))
            folded.append(fold(claimed, proof))
            proofs.append([{"at": a, "siblings": s} for a, s in proof] if with_proofs else None)
        n = leaves.num_rows
        proof_type = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))
        columns = [leaves.column("row"), leaves.column("digest"), pa.array([head["subroot"]] * n), pa.array([head["root"]] * n), pa.array(hashes, pa.string()), pa.array(folded, pa.string()), pa.array(proofs, proof_type)]
        return pa.table(columns, ["row", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"])

    return run


def merkle_manifest(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group_col: str = "source", id_col: str = "doc_id", claimed: dict[str, Column] | None = None, keep: tuple[str, ...] = ("doc_id",), proofs: bool = False) -> DataFrame:
    """One row per row of docs: `row` (a struct of the columns in `keep`), leaf, subroot (of the row's group), root (of all), proof_sha256 (of the
    siblings' digests from the leaf to the root), folded_root and, if asked for, proof: from the leaf up the node's place in its run
    and the digests of the run's other nodes.

    folded_root follows the proof from the leaf; with `claimed` (columns to be read in place of those of docs) from the leaf that those give, so
    it equals root only where they changed nothing. Runs have 16 nodes, and a last run of one is hashed too.

    A group's leaves are in the order of id, null first, rows of one id in that of their digests; repeated rows are leaves each. Null is
    a group of its own, before all others, which are in bytewise order; an empty source comes second. Null and empty values differ (`-` and
    `0:`). A single group's subroot is the root, a group of one leaf has it as subroot. An empty table gives no rows. Columns may
    have any names.
    """
    small_batches(spark)
    scratch = Scratch(spark)
    named = {c: F.col(f"`{c.replace('`', '``')}`") for c in {*columns, group_col, id_col}}
    g = named[group_col].cast("string")
    own = F.struct(*[c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name in keep]) if keep else F.lit(0)
    leaf = leaf_of({c: named[c] for c in columns})
    other = leaf_of({c: (claimed or {}).get(c, named[c]) for c in columns}) if claimed else leaf
    rows = docs.select(own.alias("row"), F.when(g.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), g.cast("binary"))).alias("g"), named[id_col].alias("id"), leaf.alias("digest"), other.alias("claimed"))
    tree = Tree(scratch, rows, [F.asc_nulls_first("id"), F.asc("digest")])
    tops = scratch.write(tree.tops(), "tops")
    roots = Tree(scratch, tops.select(F.lit(b"").alias("g"), F.col("g").alias("group"), F.col("level").alias("height"), "digest", F.col("n").alias("size")), [F.asc("group")])
    root = scratch.write(roots.tops().withColumn("path", F.array().cast("array<struct<at:int,run:string>>")), "root")
    over = roots.paths(scratch, root, 0)
    above = roots.leaves.join(over.drop("g"), "idx").join(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    above = scratch.write(above.select(F.col("group").alias("g"), F.col("size").alias("n"), F.col("height").alias("level"), "path", F.col("digest").alias("subroot"), "root"), "above")
    paths = tree.paths(scratch, above, BLOCK_LEVELS)
    blocks = paths.withColumnRenamed("idx", "block").join(checked_broadcast(above.select("g", F.col("level").alias("height"), "subroot", "root")), "g")
    leaves = tree.leaves.withColumn("block", F.floor(F.col("idx") / ARITY**BLOCK_LEVELS).cast("long")).select("row", "g", "block", "idx", "digest", "claimed")
    field = lambda n: T.StructField(n, T.StringType())
    schema = T.StructType([leaves.schema["row"], *map(field, ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("proof", PROOF)])
    out = leaves.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(_proved(proofs), schema)
    return out if proofs else out.drop("proof")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents; of the ids whose CRC a fifth divides, the text is held in lower case against it."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    claimed = {"text": F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
    out = merkle_manifest(spark, docs, claimed=claimed)
    return out.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = "sha256(concat({}))".format(", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::varchar), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", "{text}")))

ORACLE = f"""
WITH RECURSIVE crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) AS crc FROM documents),
leaf AS (SELECT d.doc_id, source AS g, {_LEAF.replace("{text}", "text")} AS leaf,
    CASE WHEN crc % 5 = 0 THEN {_LEAF.replace("{text}", f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_LEAF.replace("{text}", "text")} END AS claimed FROM documents d JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaf),
node(g, n, level, idx, digest) AS (SELECT g, n, 0, idx, leaf FROM placed
    UNION ALL SELECT g, (n + 15) // 16, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY g, n, level, idx // 16),
sub AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
high(n, level, idx, digest) AS (SELECT n, 0, idx, subroot FROM sub
    UNION ALL SELECT (n + 15) // 16, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY n, level, idx // 16),
step AS (SELECT p.doc_id, r.level, r.idx, r.digest, r.idx = p.idx // (16 ** r.level)::bigint AS own FROM placed p JOIN node r ON p.g IS NOT DISTINCT FROM r.g AND r.n > 1 AND r.idx // 16 = p.idx // (16 ** (r.level + 1))::bigint
    UNION ALL SELECT p.doc_id, 100 + r.level, r.idx, r.digest, r.idx = s.idx // (16 ** r.level)::bigint FROM placed p JOIN sub s ON p.g IS NOT DISTINCT FROM s.g JOIN high r ON r.n > 1 AND r.idx // 16 = s.idx // (16 ** (r.level + 1))::bigint),
run AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT own), '') AS siblings,
    string_agg(CASE WHEN own THEN '*' ELSE digest END, '' ORDER BY idx) AS held FROM step GROUP BY doc_id, level),
walk(doc_id, k, digest) AS (SELECT doc_id, 0::bigint, claimed FROM placed UNION ALL SELECT w.doc_id, r.k, sha256(replace(r.held, '*', w.digest)) FROM walk w JOIN run r ON w.doc_id = r.doc_id AND r.k = w.k + 1),
proof AS (SELECT doc_id, string_agg(siblings, '' ORDER BY k) AS siblings FROM run GROUP BY doc_id),
top AS (SELECT doc_id, arg_max(digest, k) AS folded_root FROM walk GROUP BY doc_id)
SELECT p.doc_id, p.leaf, s.subroot, h.digest AS root, sha256(coalesce(proof.siblings, '')) AS proof_sha256, folded_root, folded_root = h.digest AS verified
FROM placed p JOIN sub s ON p.g IS NOT DISTINCT FROM s.g JOIN top USING (doc_id) LEFT JOIN proof USING (doc_id) JOIN (SELECT digest FROM high WHERE n = 1) h ON true
"""
