"""Snapshots of paths and hashes that compare from the top down: a tree of digests over ranges of keys.

A row's key is the MD5 of its path in hex, so a node of the tree is a prefix of keys, the same in every snapshot, and no
directory makes a range larger than others. A node's digest is the exclusive or of its rows' digests (120 bits) with
their number: it needs no order, is added up before any shuffle, and a parent's digest comes from its children's. Equal
digests mean equal rows but for a chance of 2^-120; whoever can choose hashes freely could build a collision, so the
manifest's hash remains the test against that.

A written snapshot has its rows in folders by the first digit of the key, in files that are ranges of keys, sorted. A comparison
reads the nodes whose parents differ, level by level, and then the rows of the differing leaves alone: folders prune
files, the key's range prunes row groups. The tree has at most 16^DEPTH leaves at any size of the corpus, so what a
comparison holds on the driver, the differing nodes, is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import changed

#: Levels below the root; each has 16 children a node.
DEPTH = 4
#: Digits that name a folder of a written snapshot.
FOLDER = 1
#: Differing leaves up to which they are named in the scan's filter; more of them are joined.
NAMED = 1024


def keyed(rows: DataFrame) -> DataFrame:
    """path and hash with the key and its folder; rows without a path are left out."""
    return rows.filter("path IS NOT NULL").select("path", "hash", F.md5("path").alias("key")).withColumn("folder", F.substring("key", 1, FOLDER))


def part(hexed: Column, start: int) -> Column:
    """15 hex digits as a number: 60 bits."""
    return F.conv(F.substring(hexed, start, 15), 16, 10).cast("long")


def leaves(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """node, n, x, y: what the leaves hold. A null hash is a value of its own; rows without a path are left out."""
    own = F.md5(F.concat_ws("\n", "path", "hash"))
    t = rows.filter("path IS NOT NULL").select(F.substring(F.md5("path"), 1, depth).alias("node"), own.alias("own"))
    return t.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(part(F.col("own"), 1)).alias("x"), F.bit_xor(part(F.col("own"), 16)).alias("y"))


def tree(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """level, node, n, x, y of all nodes that have rows, the root (level 0, an empty name) included."""
    bottom = leaves(rows, depth)
    # Each leaf is a row of each of its ancestors: the rows of the corpus are read once.
    t = bottom.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "node", "n", "x", "y")
    t = t.withColumn("node", F.substring("node", F.lit(1), F.col("level")))
    return t.groupBy("level", "node").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))


def write(rows: DataFrame, path: str, depth: int = DEPTH) -> None:
    """Writes a snapshot of ``rows`` (path, hash): its rows by folders of keys, and its tree by levels."""
    k = keyed(rows)
    k.repartitionByRange("key").sortWithinPartitions("key").write.partitionBy("folder").parquet(f"{path}/rows")
    tree(rows, depth).repartition("level").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(f"{path}/tree")


@dataclass(frozen=True)
class Snapshot:
    """rows: path, hash, key, folder. nodes: level, node, n, x, y."""

    rows: DataFrame
    nodes: DataFrame
    depth: int = DEPTH

    @staticmethod
    def read(spark: SparkSession, path: str, depth: int = DEPTH) -> Snapshot:
        rows = spark.read.schema("path string, hash string, key string, folder string").parquet(f"{path}/rows")
        return Snapshot(rows, spark.read.schema("node string, n long, x long, y long, level int").parquet(f"{path}/tree"), depth)

    @staticmethod
    def of(rows: DataFrame, depth: int = DEPTH) -> Snapshot:
        """A snapshot that isn't written; its rows are read for the tree and again for what differs."""
        return Snapshot(keyed(rows), tree(rows, depth).persist(), depth)

    def under(self, names: list[str]) -> DataFrame:
        """path and hash of the rows below some leaves."""
        folders = sorted({x[:FOLDER] for x in names})
        some = self.rows.filter(F.col("folder").isin(folders) if folders else F.lit(False))
        if len(names) <= NAMED:
            # Ranges of the key reach the scan; a leaf's prefix wouldn't.
            ranges = [(F.col("key") >= x) & (F.col("key") < x + "g") for x in names]
            while len(ranges) > 1:
                ranges = [a | b for a, b in zip(ranges[::2], [*ranges[1::2], F.lit(False)])]
            return some.filter(ranges[0] if ranges else F.lit(False)).select("path", "hash")
        few = some.sparkSession.createDataFrame([(x,) for x in names], "node string")  # 16^DEPTH at most
        return some.join(F.broadcast(few), F.substring("key", 1, self.depth) == F.col("node"), "left_semi").select("path", "hash")


def differing(old: Snapshot, new: Snapshot) -> list[list[str]]:
    """The names of the nodes that differ, for each level from the root on; nothing below equal nodes is read."""
    if old.depth != new.depth:
        raise ValueError(f"the trees have {old.depth} and {new.depth} levels")
    out: list[list[str]] = []
    for level in range(old.depth + 1):
        at = lambda s: s.nodes.filter(F.col("level") == level)  # noqa: B023, E731
        a, b = (at(s) if level == 0 else at(s).filter(F.substring("node", 1, level - 1).isin(out[-1])) for s in (old, new))  # noqa: B023
        both = a.select("node", F.struct("n", "x", "y").alias("old")).join(b.select("node", F.struct("n", "x", "y").alias("new")), "node", "full_outer")
        names = sorted(r["node"] for r in both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("node").collect())
        out.append(names)
        if not names:
            break
    return out


def changes(old: Snapshot, new: Snapshot) -> DataFrame:
    """path and change, as ``views.changed`` of the whole snapshots gives them; only the rows of differing leaves meet."""
    levels = differing(old, new)
    names = levels[-1] if len(levels) == old.depth + 1 else []
    return changed(old.under(names), new.under(names))
