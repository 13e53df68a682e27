"""Queries on bounds, bins, free energies and marginals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.metric import Axis, Metric, fraction
from tessera.operators import histogram as h
from tessera.operators.connectivity import regions, shared_bins
from tessera.plans.common import KT, SQL_BINNED, events, r6, table


def fes_hist_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = h.assign(events(spark, sf_dir), ["value"], 30)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select("bin", "n", r6(-KT * F.ln("n")).alias("f"))


def fes_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.free_energy(h.assign(events(spark, sf_dir), ["value"], 30)).select("bin", "n", r6("f").alias("f"))


def fes_hist_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    binned = h.assign(rows, ["l_quantity", "l_extendedprice"], 11)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def hist_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount")
    binned = h.assign(rows, ["l_extendedprice"], 21)
    return binned.groupBy("bin").agg(F.round(F.sum(1 - F.col("l_discount")), 4).alias("w"))


def hist_observable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount", "l_quantity")
    w = 1 - F.col("l_discount")
    return h.assign(rows, ["l_extendedprice"], 21).groupBy("bin").agg(r6(F.sum(w * F.col("l_quantity")) / F.sum(w)).alias("observable"))


def lse_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("x", F.col("value") / 50)
    return h.log_sum_exp(rows, ["event_type"], "x").select("event_type", r6("lse").alias("lse"))


def bounds_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("w", F.lit(1.0))
    return h.percentile_bounds(rows, "value", "w", 5.0, 30).select(r6("lo").alias("lo"), r6("hi").alias("hi"))


def bin_mask_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.renumber(h.assign(events(spark, sf_dir), ["value"], 30), 20)


def weights_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.normalised(events(spark, sf_dir), "value", "w").select("event_id", F.round("w", 10).alias("w"))


def fes_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("user_id") % 5).cast("int").alias("a"), F.pmod(F.col("event_id"), F.lit(7)).cast("int").alias("b"), (F.col("value") / 100).alias("v"))
    grid = rows.groupBy("a", "b").agg(F.avg("v").alias("v"))
    return h.marginals(grid, ["a", "b"], "v").select("a", "b", r6("f").alias("f"))


def fes_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = h.assign(events(spark, sf_dir), ["value"], 30)
    one, two = (h.free_energy(binned.where(F.col("user_id") % 2 == k)) for k in (0, 1))
    return h.divergence(one, two).select(r6("kl").alias("kl"))


def minimum_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = Axis(0.0, 100.0, periodic=True)
    return events(spark, sf_dir).select("event_id", r6(axis.difference(F.lit(90.0), F.col("value"))).alias("d"))


def periodic_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = Axis(-50.0, 50.0, periodic=True)
    return events(spark, sf_dir).select("event_id", r6(axis.wrap(F.col("value"))).alias("x"), r6(fraction(F.col("value") / 7)).alias("u"))


def grid_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Metric((Axis(-2.0, 2.0), Axis(1.0, 5.0))).grid(spark, 5)
    return grid.select("i0", "i1", r6(F.col("x0") * F.col("x0") * F.col("x0") + F.col("x1")).alias("v"))


def bin_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = h.assign(events(spark, sf_dir), ["value"], 30)
    return regions(shared_bins(binned, "user_id"))


QUERIES = {f.__name__: f for f in (fes_hist_1d, fes_shifted, fes_hist_2d, hist_weighted, hist_observable, lse_by_bin, bounds_percentile, bin_mask_renumber, weights_normalised, fes_marginals, fes_divergence, minimum_image, periodic_wrap, grid_cross, bin_regions)}

_PRICE = """b AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem),
m AS (SELECT l.*, least(CAST(floor((l_extendedprice-lo)/((hi-lo)/20)) AS INT), 19) bin FROM lineitem l CROSS JOIN b WHERE l_extendedprice > lo AND l_extendedprice < hi)"""

SQL = {
    "fes_hist_1d": f"WITH {SQL_BINNED} SELECT bin, count(*) AS n, round(-0.0083144626*300*ln(count(*)),6) AS f FROM m GROUP BY bin",
    "fes_shifted": f"WITH {SQL_BINNED}, c AS (SELECT bin, count(*) n FROM m GROUP BY bin) SELECT bin, n, round(-0.0083144626*300*(ln(n)-ln((SELECT max(n) FROM c))),6) AS f FROM c",
    "fes_hist_2d": """WITH b AS (SELECT min(l_quantity) a0, max(l_quantity) a1, min(l_extendedprice) b0, max(l_extendedprice) b1 FROM lineitem)
SELECT least(CAST(floor((l_quantity-a0)/((a1-a0)/10)) AS INT),9)*10 + least(CAST(floor((l_extendedprice-b0)/((b1-b0)/10)) AS INT),9) AS bin, count(*) AS n
FROM lineitem CROSS JOIN b WHERE l_quantity>a0 AND l_quantity<a1 AND l_extendedprice>b0 AND l_extendedprice<b1 GROUP BY 1""",
    "hist_weighted": f"WITH {_PRICE} SELECT bin, round(sum(1-l_discount),4) AS w FROM m GROUP BY bin",
    "hist_observable": f"WITH {_PRICE} SELECT bin, round(sum((1-l_discount)*l_quantity)/sum(1-l_discount),6) AS observable FROM m GROUP BY bin",
    "lse_by_bin": "WITH x AS (SELECT event_type, value/50 v, max(value/50) OVER (PARTITION BY event_type) mx FROM events) SELECT event_type, round(max(mx)+ln(sum(exp(v-mx))),6) AS lse FROM x GROUP BY event_type",
    "bounds_percentile": f"""WITH {SQL_BINNED}, c AS (SELECT bin, count(*)*1.0 w FROM m GROUP BY bin), r AS (SELECT bin, w, sum(w) OVER (ORDER BY bin) run, sum(w) OVER () s FROM c),
k AS (SELECT min(bin) f, max(bin) l FROM r WHERE run/s > 0.05 AND (run-w)/s < 0.95)
SELECT round(lo+f*(hi-lo)/29,6) AS lo, round(lo+(l+1)*(hi-lo)/29,6) AS hi FROM k CROSS JOIN b""",
    "bin_mask_renumber": f"WITH {SQL_BINNED}, c AS (SELECT bin, count(*) n FROM m GROUP BY bin HAVING count(*) >= 20) SELECT bin, n, dense_rank() OVER (ORDER BY bin) - 1 AS number FROM c",
    "weights_normalised": "SELECT event_id, round(value/(SELECT sum(value) FROM events),10) AS w FROM events",
    "fes_marginals": """WITH g AS (SELECT CAST(user_id%5 AS INT) a, CAST(event_id%7 AS INT) b, avg(value/100) v FROM events GROUP BY 1,2),
s AS (SELECT a, b, GROUPING(a)*2+GROUPING(b) lv, ln(sum(exp(v))) l FROM g GROUP BY GROUPING SETS ((a),(b),(a,b)))
SELECT a, b, round(l - max(l) OVER (PARTITION BY lv), 6) AS f FROM s""",
    "fes_divergence": f"""WITH {SQL_BINNED}, c AS (SELECT user_id%2 g, bin, count(*) n FROM m GROUP BY 1,2), p AS (SELECT g, bin, n/sum(n) OVER (PARTITION BY g) p FROM c)
SELECT round(0.0083144626*300*sum(0.5*(x.p-y.p)*ln(x.p/y.p)),6) AS kl FROM p x JOIN p y USING (bin) WHERE x.g=0 AND y.g=1""",
    "minimum_image": "WITH u AS (SELECT event_id, (value-90)/100 - floor((value-90)/100) u FROM events) SELECT event_id, round(CASE WHEN u>0.5 THEN u-1 ELSE u END*100,6) AS d FROM u",
    "periodic_wrap": "SELECT event_id, round(((value+50)/100-floor((value+50)/100))*100-50,6) AS x, round(value/7-floor(value/7),6) AS u FROM events",
    "grid_cross": "SELECT CAST(i AS INT) AS i0, CAST(j AS INT) AS i1, round(pow(-1.5+i,3)+1.5+j,6) AS v FROM range(4) a(i) CROSS JOIN range(4) c(j)",
    "bin_regions": """WITH RECURSIVE b AS (SELECT min(value) lo, max(value) hi FROM events),
m AS (SELECT DISTINCT user_id, CAST(floor((value-lo)/((hi-lo)/29)) AS INT) bin FROM events CROSS JOIN b WHERE value>lo AND value<hi),
e AS (SELECT DISTINCT x.bin a, y.bin b FROM m x JOIN m y USING (user_id)),
r AS (SELECT a node, b reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach=e.a)
SELECT node, min(reach) AS region FROM r GROUP BY node""",
}
