"""Neighbours of moving frames, kept as a table: only frames that have moved too far are worked out again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import environments as en
from tessera.sources.shared import cut

_SHIFT = "frame, i, kind_i, j, kind_j, shift, part"


class EdgeTable:
    """Edges up to r + skin of frames, with the points that they were made for, at a path.

    Frames are dealt to parts by a hash, and a part is a partition of both
    tables. An edge is kept with the cell shift between its points as they
    were stored, so that its vector follows their motion and needs no wrapping.
    As long as no point of a frame has moved by over half of the skin, and its
    cell is as it was, every pair closer than r is among its edges.
    """

    def __init__(self, spark: SparkSession, path: str, r: float, skin: float, parts: int = 64):
        self.spark, self.path, self.r, self.skin, self.parts = spark, path.rstrip("/"), r, skin, parts

    def _with_part(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64("frame"), F.lit(self.parts)).cast("int"))

    def _made(self, points: DataFrame) -> DataFrame:
        found = cut(en.edges(points, self.r + self.skin))
        # The edges' images are those of points wrapped into the cell.
        turns = points.select("frame", "i", F.transform(g.row_times(F.col("p"), g.inverse(F.col("cell"))), lambda x: F.floor(x).cast("int")).alias("turn"))
        found = found.join(turns.withColumnRenamed("turn", "turn_i"), ["frame", "i"]).join(turns.select("frame", F.col("i").alias("j"), F.col("turn").alias("turn_j")), ["frame", "j"])
        shift = F.zip_with(F.zip_with("image", "turn_i", lambda x, y: x + y), "turn_j", lambda x, y: x - y)
        return self._with_part(found.withColumn("shift", shift)).selectExpr(*_SHIFT.split(", "))

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        writer = rows.repartition("part").write.mode("overwrite").partitionBy("part").option("partitionOverwriteMode", mode)
        writer.parquet(f"{self.path}/{name}")

    def build(self, points: DataFrame) -> None:
        """Makes both tables for points as environments.atoms gives them."""
        points = points.select("frame", "cell", "i", "kind", "p")
        self._write(self._made(points), "edges", "static")
        self._write(self._with_part(points), "points", "static")

    def kept(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stale(self, points: DataFrame) -> DataFrame:
        """frame, part: frames that are new, that moved by over half of the skin, that gained or lost points, or whose cell changed."""
        new = self._with_part(points.select("frame", "cell", "i", "p"))
        old = self.kept("points").select("part", "frame", "i", F.col("cell").alias("cell0"), F.col("p").alias("p0"))
        both = new.join(old, ["part", "frame", "i"], "full")
        d = g.minus(F.col("p"), F.col("p0"))
        moved = F.col("p").isNull() | F.col("p0").isNull() | (g.dot(d, d) > self.skin * self.skin / 4) | (F.col("cell") != F.col("cell0"))
        # Frames that points doesn't have stay as they are.
        asked = both.groupBy("part", "frame").agg(F.max(moved).alias("stale"), F.count("p").alias("here"))
        return asked.where("stale and here > 0").select("frame", "part")

    def update(self, points: DataFrame) -> int:
        """Makes the edges of stale frames again and puts them in their parts; how many frames were stale.

        Only parts with stale frames are read and written; of the points only
        stale frames are joined. The other edges of those parts are set aside
        in the shared folder first, so that a lost task doesn't lose them. The
        driver sees numbers of parts, of which there are `parts` at most.
        """
        stale = cut(self.stale(points))
        touched = [r["part"] for r in stale.select("part").distinct().collect()]
        if not touched:
            return 0
        fresh = points.join(stale.select("frame"), "frame", "left_semi").select("frame", "cell", "i", "kind", "p")
        for name, rows in (("edges", self._made(fresh)), ("points", self._with_part(fresh))):
            rest = self.kept(name).where(F.col("part").isin(touched)).join(stale.select("frame"), "frame", "left_anti")
            merged = cut(rest.unionByName(rows))
            gone = sorted(set(touched) - {r["part"] for r in merged.select("part").distinct().collect()})
            self._write(merged, name, "dynamic")
            for part in gone:  # parts that have no row any more
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/part={part}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return stale.count()

    def edges(self, points: DataFrame) -> DataFrame:
        """frame, i, j, kind_i, kind_j, image, d, r of pairs closer than r, for the points as they are now; image is between points as given, unwrapped."""
        rows = self._with_part(points.select("frame", "cell", "i", "p"))
        found = self.kept("edges").join(rows.select("part", "frame", "cell", "i", F.col("p").alias("p_i")), ["part", "frame", "i"])
        found = found.join(rows.select("part", "frame", F.col("i").alias("j"), F.col("p").alias("p_j")), ["part", "frame", "j"])
        moved = g.row_times(F.transform("shift", lambda x: x.cast("double")), F.col("cell"))
        found = found.withColumn("d", F.zip_with(g.minus(F.col("p_j"), F.col("p_i")), moved, lambda x, y: x + y)).withColumn("r", g.length(F.col("d")))
        return found.where(F.col("r") < self.r).select("frame", "i", "j", "kind_i", "kind_j", F.col("shift").alias("image"), "d", "r")


def own_path(spark: SparkSession, name: str) -> str:
    """A new folder's name beside the session's checkpoints."""
    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
