"""Queries on kept edges of moving frames, and on motifs of periodic edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import environments as en
from tessera.operators import motifs as mt
from tessera.plans.common import r6
from tessera.plans.structures import _E, points
from tessera.sources.edges import EdgeTable, own_path
from tessera.sources.shared import cut

SHORT = 1.1


def neighbours_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of frames of which a part has moved since they were made: by points and sums, after the stale ones were made again."""
    old = points(spark, sf_dir)
    new = old.withColumn("p", F.transform("p", lambda x: x * (1 + F.col("frame") % 4 * 0.05)))
    table = EdgeTable(spark, own_path(spark, "edges"), 1.6, 0.2, 16)
    table.build(old)
    table.update(new)
    return en.reduced(table.edges(new), F.exp(-F.col("r"))).select("frame", "i", "n", r6("value").alias("value"))


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(en.edges(points(spark, sf_dir), SHORT))  # read several times


def motif_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.triples(_short(spark, sf_dir))
    return found.groupBy("frame", "i").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(mt.angle_cosine(F.col("d_a"), F.col("d_b")))).alias("cosines"))


def motif_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.quads(_short(spark, sf_dir))
    return found.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(g.length(g.minus(F.col("d_d"), F.col("d_a")))), 4).alias("across"))


def motif_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.rings(_short(spark, sf_dir))
    around = g.length(F.col("d_b")) + g.length(F.col("d_c")) + g.length(g.minus(F.col("d_c"), F.col("d_b")))
    return found.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(around), 5).alias("around"))


QUERIES = {f.__name__: f for f in (neighbours_kept, motif_triples, motif_quads, motif_rings)}

_MOVED = _E.replace("FROM a),", "FROM (SELECT * REPLACE (x*(1+f%4*0.05) AS x, y*(1+f%4*0.05) AS y, z*(1+f%4*0.05) AS z) FROM a)),", 1)
_SHORT = f"WITH {_E}, q AS (SELECT * FROM e WHERE r < {SHORT})"
_CLOSED = "l.j=t.j AND l.i1=m.i1+t.i1 AND l.i2=m.i2+t.i2 AND l.i3=m.i3+t.i3"


SQL = {
    "neighbours_kept": f"WITH {_MOVED} SELECT frame, i, count(*) AS n, round(sum(exp(-r)),6) AS value FROM e GROUP BY frame, i",
    "motif_triples": f"{_SHORT} SELECT a.frame, a.i, count(*) AS n, round(sum(greatest(-1,least(1,(a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)/(a.r*b.r)))),6) AS cosines FROM q a JOIN q b ON a.frame=b.frame AND a.i=b.i AND (a.j,a.i1,a.i2,a.i3)<(b.j,b.i1,b.i2,b.i3) GROUP BY 1,2",
    # Every chain is found from both of its ends, every ring from each of its points both ways round.
    "motif_quads": f"""{_SHORT} SELECT m.frame, count(*)//2 AS n, round(sum(sqrt(pow(m.dx+t.dx-l.dx,2)+pow(m.dy+t.dy-l.dy,2)+pow(m.dz+t.dz-l.dz,2)))/2,4) AS across FROM q m JOIN q l ON l.frame=m.frame AND l.i=m.i JOIN q t ON t.frame=m.frame AND t.i=m.j
WHERE NOT (l.j=m.j AND l.i1=m.i1 AND l.i2=m.i2 AND l.i3=m.i3) AND NOT (t.j=m.i AND t.i1=-m.i1 AND t.i2=-m.i2 AND t.i3=-m.i3) AND NOT ({_CLOSED}) GROUP BY 1""",
    "motif_rings": f"{_SHORT} SELECT m.frame, count(*)//6 AS n, round(sum(m.r+l.r+t.r)/6,5) AS around FROM q m JOIN q t ON t.frame=m.frame AND t.i=m.j JOIN q l ON l.frame=m.frame AND l.i=m.i AND {_CLOSED} GROUP BY 1",
}
