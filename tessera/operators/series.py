"""Time-ordered operators within trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(traj: str, order: list[str]):  # noqa: ANN201
    return Window.partitionBy(traj).orderBy(*order)


def lag_pairs(rows: DataFrame, traj: str, order: list[str], columns: list[str], lag: int) -> DataFrame:
    """Rows with `<c>_t`, each column's value `lag` rows later; the last rows of a trajectory go."""
    w = ordered(traj, order)
    out = rows.withColumns({f"{c}_t": F.lead(c, lag).over(w) for c in columns} | {"lag_there": F.lead(F.lit(1), lag).over(w)})
    return out.where("lag_there = 1").drop("lag_there")


def transitions(rows: DataFrame, traj: str, order: list[str], lag: int, label: str | None = None) -> DataFrame:
    """src, dst, c (by label, if given): how often a bin follows another after `lag` rows."""
    keys = [label] if label else []
    return lag_pairs(rows, traj, order, ["bin"], lag).groupBy(*keys, F.col("bin").alias("src"), F.col("bin_t").alias("dst")).agg(F.count(F.lit(1)).alias("c"))


def stochastic(counts: DataFrame) -> DataFrame:
    """src, dst, c, p: counts with their share of the source's."""
    sums = counts.groupBy("src").agg(F.sum("c").alias("all"))
    return counts.join(sums, "src").select("src", "dst", "c", (F.col("c") / F.col("all")).alias("p"))


def top_destinations(counts: DataFrame, n: int) -> DataFrame:
    """Each source's n most frequent destinations; ties to the smaller one."""
    w = Window.partitionBy("src").orderBy(F.desc("c"), "dst")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def destinations(counts: DataFrame) -> DataFrame:
    """One row: least, mean and greatest number of destinations of a source."""
    return counts.groupBy("src").agg(F.count_distinct("dst").alias("k")).agg(F.min("k").alias("least"), F.avg("k").alias("mean"), F.max("k").alias("most"))


def subsample(rows: DataFrame, traj: str, order: list[str], factor: int) -> DataFrame:
    """Every factor-th row of each trajectory, the first included."""
    return rows.withColumn("row_no", F.row_number().over(ordered(traj, order)) - 1).where(F.col("row_no") % factor == 0).drop("row_no")


def trim(rows: DataFrame, traj: str, order: list[str], skip: int, longer_than: int = 0) -> DataFrame:
    """Rows after the first `skip`; trajectories of at most skip + longer_than rows go."""
    numbered = rows.withColumn("row_no", F.row_number().over(ordered(traj, order)) - 1).withColumn("rows_in", F.count(F.lit(1)).over(Window.partitionBy(traj)))
    return numbered.where((F.col("row_no") >= skip) & (F.col("rows_in") > skip + longer_than)).drop("row_no", "rows_in")


def first_row(rows: DataFrame, traj: str, order: list[str], column: str, name: str) -> DataFrame:
    """Rows with the column's value in the trajectory's first row."""
    return rows.withColumn(name, F.first(column).over(ordered(traj, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def block_error(rows: DataFrame, traj: str, order: list[str], column: str, block: int) -> DataFrame:
    """traj, blocks, se: standard error of means over complete blocks of rows."""
    n = rows.withColumn("block", F.floor((F.row_number().over(ordered(traj, order)) - 1) / block))
    means = n.groupBy(traj, "block").agg(F.avg(column).alias("m"), F.count(F.lit(1)).alias("k")).where(F.col("k") == block)
    return means.groupBy(traj).agg(F.count(F.lit(1)).alias("blocks"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def autocorrelation(rows: DataFrame, traj: str, order: list[str], column: str, lags: int) -> DataFrame:
    """lag, acf: correlation of deviations from each trajectory's mean, pooled, for lags 1 to `lags`.

    One window pass makes all lags; one aggregation sums them.
    """
    w = ordered(traj, order)
    dev = rows.withColumn("dev", F.col(column) - F.avg(column).over(Window.partitionBy(traj)))
    ahead = dev.select("dev", F.array(*[F.lead("dev", k).over(w) for k in range(1, lags + 1)]).alias("ahead"))
    sums = ahead.agg(F.avg(F.col("dev") * F.col("dev")).alias("var"), *[F.avg(F.col("dev") * F.get("ahead", F.lit(k - 1))).alias(f"c{k}") for k in range(1, lags + 1)])
    return sums.select("var", F.posexplode(F.array(*[f"c{k}" for k in range(1, lags + 1)])).alias("k", "c")).select((F.col("k") + 1).alias("lag"), (F.col("c") / F.col("var")).alias("acf"))


def timescale(rows: DataFrame, traj: str, order: list[str], column: str, lag: int) -> DataFrame:
    """One row: r, the correlation at the lag, and tau = -lag / ln r (null unless 0 < r < 1)."""
    r = lag_pairs(rows, traj, order, [column], lag).agg(F.corr(column, f"{column}_t").alias("r"))
    return r.select("r", F.when((F.col("r") > 0) & (F.col("r") < 1), -lag / F.ln("r")).alias("tau"))


def running(rows: DataFrame, traj: str, order: list[str], column: str) -> DataFrame:
    """Rows with run_sum and run_var (population), up to and with each row."""
    w = ordered(traj, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"run_sum": F.sum(column).over(w), "run_var": F.var_pop(column).over(w)})


def rescaled_lag(rows: DataFrame, traj: str, order: list[str], column: str, rate: Column, tau: float) -> DataFrame:
    """Rows with `<c>_t` where rescaled time has moved on by tau, linear between the two rows round it.

    Rescaled time is the running sum of `rate` over earlier rows; rows whose
    partner lies after the trajectory's end go. The as-of search is an equi-join
    on trajectory and a cell of rescaled time, each row's interval being posted
    in the cells it touches.
    """
    w = ordered(traj, order)
    timed = rows.withColumn("s", F.coalesce(F.sum(rate).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    timed = timed.withColumns({"s_next": F.lead("s").over(w), "x_next": F.lead(column).over(w)})
    spans = timed.where(F.col("s_next") > F.col("s")).select(F.col(traj).alias("t_traj"), F.col("s").alias("lo"), F.col("s_next").alias("hi"), F.col(column).alias("x_lo"), F.col("x_next").alias("x_hi"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / tau), F.floor(F.col("hi") / tau))))
    asked = timed.drop("s_next", "x_next").withColumn("target", F.col("s") + tau).withColumn("cell", F.floor(F.col("target") / tau))
    near = asked.join(spans, (F.col(traj) == F.col("t_traj")) & (asked["cell"] == spans["cell"]) & (F.col("target") >= F.col("lo")) & (F.col("target") < F.col("hi")))
    part = (F.col("target") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return near.withColumn(f"{column}_t", F.col("x_lo") + part * (F.col("x_hi") - F.col("x_lo"))).drop("t_traj", "lo", "hi", "x_lo", "x_hi", "cell", "target")
