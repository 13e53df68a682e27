"""Bounds, bins, weighted and log-space histograms, free energies, marginals.

A grid of n edges has n - 1 bins along an axis; rows must lie strictly inside
the bounds to count. On an interior edge a row belongs to the bin above.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kJ/mol/K.
BOLTZMANN = 0.0083144626


def bounds(rows: DataFrame, columns: list[str], widen: float = 0.5, margin: float = 0.0) -> DataFrame:
    """One row: lo_<c> and hi_<c> of each column; a constant column is widened both ways; margin is a part of the width."""
    out = rows.agg(*[f(c).alias(f"{p}_{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))])
    for c in columns:
        flat = F.col(f"hi_{c}") - F.col(f"lo_{c}") <= 1e-12
        lo, hi = F.when(flat, F.col(f"lo_{c}") - widen).otherwise(F.col(f"lo_{c}")), F.when(flat, F.col(f"hi_{c}") + widen).otherwise(F.col(f"hi_{c}"))
        out = out.withColumns({f"lo_{c}": lo - margin * (hi - lo), f"hi_{c}": hi + margin * (hi - lo)})
    return out


def assign(rows: DataFrame, columns: list[str], n: int, box: DataFrame | None = None) -> DataFrame:
    """rows strictly inside the bounds, with `bin`: mixed radix, first column most significant."""
    box = bounds(rows, columns) if box is None else box
    joined = rows.crossJoin(F.broadcast(box))  # box is one row
    inside = reduce(lambda a, b: a & b, [(F.col(c) > F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}")) for c in columns])
    number = F.lit(0)
    for c in columns:
        step = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (n - 1)
        number = number * (n - 1) + F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / step), F.lit(n - 2)).cast("int")
    return joined.where(inside).withColumn("bin", number).drop(*box.columns)


def log_sum_exp(rows: DataFrame, keys: list[str], value: str, name: str = "lse") -> DataFrame:
    """ln sum exp(value) by keys: the greatest value first, then sums of what is left; both are partial aggregations.

    Null and minus infinity count as nothing; a group of nothing gives null.
    """
    good = rows.where(F.col(value).isNotNull() & (F.col(value) > float("-inf")))
    top = good.groupBy(*keys).agg(F.max(value).alias("lse_top"))
    return good.join(top, keys).groupBy(*keys).agg((F.max("lse_top") + F.ln(F.sum(F.exp(F.col(value) - F.col("lse_top"))))).alias(name))


def free_energy(binned: DataFrame, t: float = 300.0, weight: Column | None = None) -> DataFrame:
    """bin, n, f: -kT ln of the summed weight, with the least at 0."""
    mass = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(1.0) if weight is None else weight).alias("mass"))
    f = F.when(F.col("mass") > 0, -BOLTZMANN * t * F.ln("mass"))
    low = mass.agg(F.min(f).alias("low"))
    return mass.crossJoin(F.broadcast(low)).select("bin", "n", (f - F.col("low")).alias("f"))  # low is one row


def percentile_bounds(rows: DataFrame, column: str, weight: str, percentile: float, n: int) -> DataFrame:
    """One row: lo and hi of the bins that hold the middle of the weight, `percentile` percent cut off either end."""
    box = bounds(rows, [column])
    mass = assign(rows, [column], n, box).groupBy("bin").agg(F.sum(weight).alias("w"))
    running = mass.withColumn("run", F.sum("w").over(Window.orderBy("bin"))).crossJoin(F.broadcast(mass.agg(F.sum("w").alias("all"))))  # n bins at most
    cut = percentile / 100
    kept = running.where((F.col("run") / F.col("all") > cut) & ((F.col("run") - F.col("w")) / F.col("all") < 1 - cut))
    step = (F.col(f"hi_{column}") - F.col(f"lo_{column}")) / (n - 1)
    return kept.agg(F.min("bin").alias("first"), F.max("bin").alias("last")).crossJoin(box).select((F.col(f"lo_{column}") + F.col("first") * step).alias("lo"), (F.col(f"lo_{column}") + (F.col("last") + 1) * step).alias("hi"))


def renumber(binned: DataFrame, least: int) -> DataFrame:
    """bin, n, number: bins with at least `least` rows, numbered from 0 in order."""
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.withColumn("number", F.dense_rank().over(Window.orderBy("bin")) - 1)  # over bins, not rows


def normalised(rows: DataFrame, weight: str, name: str = "w_norm") -> DataFrame:
    """weight over its sum; null, NaN, infinite and negative weights count as 0; a sum below 1e-16 is an error."""
    w = F.col(weight).cast("double")
    clean = F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0), 0.0).otherwise(w)
    total = rows.agg(F.sum(clean).alias("all_w"))
    total = total.select(F.when(F.col("all_w") < 1e-16, F.raise_error(F.lit("the weights sum to 0")).cast("double")).otherwise(F.col("all_w")).alias("all_w"))
    return rows.crossJoin(F.broadcast(total)).withColumn(name, clean / F.col("all_w")).drop("all_w")


def marginals(grid: DataFrame, dims: list[str], value: str) -> DataFrame:
    """ln sum exp(value) over every proper and full subset of dims, shifted so that each subset's greatest is 0.

    One pass of GROUPING SETS a stage; `level` is the grouping id.
    """
    sets = [list(c) for k in range(1, len(dims) + 1) for c in combinations(dims, k)]
    top = grid.agg(F.max(value).alias("top"))
    base = grid.crossJoin(F.broadcast(top))  # one row
    out = base.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.grouping_id().alias("level"), (F.max("top") + F.ln(F.sum(F.exp(F.col(value) - F.col("top"))))).alias("lse"))
    best = out.groupBy("level").agg(F.max("lse").alias("best"))
    return out.join(F.broadcast(best), "level").select(*dims, "level", (F.col("lse") - F.col("best")).alias("f"))  # a row a subset


def divergence(p: DataFrame, q: DataFrame, t: float = 300.0) -> DataFrame:
    """One row: the symmetrised Kullback-Leibler divergence of exp(-f / kT) over shared bins (bin, f), times kT."""
    kt = BOLTZMANN * t

    def mass(df: DataFrame, name: str) -> DataFrame:
        e = df.select("bin", F.exp(-F.col("f") / kt).alias(name))
        return e.crossJoin(F.broadcast(e.agg(F.sum(name).alias("all")))).select("bin", (F.col(name) / F.col("all")).alias(name))

    both = mass(p, "p").join(mass(q, "q"), "bin").where((F.col("p") > 0) & (F.col("q") > 0))
    return both.agg((kt * F.sum(0.5 * (F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q")))).alias("kl"))


def surface(binned: DataFrame, t: float = 300.0, weight: Column | None = None, log_rho: Column | None = None, observable: Column | None = None, most: float | None = None) -> DataFrame:
    """bin, n, n_eff, density, f, sigma, observable: a free energy with its spread.

    The mass of a bin is the sum of w exp(log_rho); n_eff is Kish's size of its
    weights; sigma = kT / sqrt(n_eff). f has its least at 0 and is at most
    `most`, if that is given.
    """
    w = (F.lit(1.0) if weight is None else weight) * (F.lit(1.0) if log_rho is None else F.exp(log_rho))
    rows = binned.withColumns({"fs_w": w, "fs_o": F.lit(None).cast("double") if observable is None else observable})
    mass = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("fs_w").alias("mass"), (F.sum("fs_w") * F.sum("fs_w") / F.sum(F.col("fs_w") * F.col("fs_w"))).alias("n_eff"), (F.sum(F.col("fs_w") * F.col("fs_o")) / F.sum("fs_w")).alias("observable")).where("mass > 0")
    totals = mass.agg(F.sum("mass").alias("all_mass"), F.max("mass").alias("most_mass"))
    f = -BOLTZMANN * t * F.ln(F.col("mass") / F.col("most_mass"))
    out = mass.crossJoin(F.broadcast(totals))  # one row
    return out.select("bin", "n", "n_eff", (F.col("mass") / F.col("all_mass")).alias("density"), (f if most is None else F.least(f, F.lit(most))).alias("f"), (BOLTZMANN * t / F.sqrt("n_eff")).alias("sigma"), "observable")


def masked_histogram(binned: DataFrame, kept: DataFrame, weight: Column | None = None, observable: Column | None = None) -> DataFrame:
    """number, n, mass, observable: sums by renumbered bin; rows of bins that aren't kept go."""
    w = F.lit(1.0) if weight is None else weight
    rows = binned.join(F.broadcast(kept.select("bin", "number")), "bin")  # a row a bin
    return rows.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("mass"), (F.sum(w * observable) / F.sum(w) if observable is not None else F.lit(None).cast("double")).alias("observable"))


def bin_weights(binned: DataFrame) -> DataFrame:
    """binned with w = 1, n_bin (rows of its bin) and p_select = 1 / n_bin: every bin is drawn alike."""
    n = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_bin"))
    return binned.join(F.broadcast(n), "bin").withColumns({"w": F.lit(1.0), "p_select": 1 / F.col("n_bin")})  # a row a bin


def mapped_surface(binned_both: DataFrame, old: DataFrame, t: float = 300.0) -> DataFrame:
    """bin, f: a free energy over old bins carried to new ones by how often rows lie in both.

    binned_both has bin (new) and old_bin; old has bin and f.
    """
    kt = BOLTZMANN * t
    counts = binned_both.groupBy("bin", "old_bin").agg(F.count(F.lit(1)).alias("c"))
    share = counts.join(counts.groupBy("old_bin").agg(F.sum("c").alias("all_c")), "old_bin")
    mass = share.join(old.select(F.col("bin").alias("old_bin"), "f"), "old_bin").groupBy("bin").agg(F.sum(F.col("c") / F.col("all_c") * F.exp(-F.col("f") / kt)).alias("mass"))
    return mass.crossJoin(F.broadcast(mass.agg(F.max("mass").alias("top")))).select("bin", (-kt * F.ln(F.col("mass") / F.col("top"))).alias("f"))  # one row


def bounds_of_bias(grid: DataFrame, dim: str, bias: str, t: float = 300.0, cut: float = 0.01, sign: float = 1.0) -> DataFrame:
    """lo, hi: the first and last grid place of a dimension outside of which a bias's marginal has less than `cut` of its mass, either side."""
    mass = grid.groupBy(F.col(dim).alias("at")).agg(F.sum(F.exp(sign * F.col(bias) / (BOLTZMANN * t))).alias("m"))
    run = mass.withColumn("run", F.sum("m").over(Window.orderBy("at"))).crossJoin(F.broadcast(mass.agg(F.sum("m").alias("all_m"))))  # a row a grid place
    return run.where((F.col("run") / F.col("all_m") > cut) & ((F.col("run") - F.col("m")) / F.col("all_m") < 1 - cut)).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))


def box_of(rows: DataFrame, columns: list[str], weight: str, percentile: float, n: int, margin: float = 0.0) -> DataFrame:
    """lo_<c>, hi_<c> and constant_<c> of each column, in one row: the bins that hold the middle of the weight, widened by a part of the width."""
    out = rows.agg(*[(F.max(c) - F.min(c) <= 1e-12).alias(f"constant_{c}") for c in columns])
    for c in columns:
        found = percentile_bounds(rows, c, weight, percentile, n)
        out = out.crossJoin(found.select((F.col("lo") - margin * (F.col("hi") - F.col("lo"))).alias(f"lo_{c}"), (F.col("hi") + margin * (F.col("hi") - F.col("lo"))).alias(f"hi_{c}")))  # one row each
    return out


def inside(rows: DataFrame, columns: list[str], box: DataFrame, name: str = "inside") -> DataFrame:
    """rows with whether they lie strictly within the box in all columns."""
    good = reduce(lambda a, b: a & b, [(F.col(c) > F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}")) for c in columns])
    return rows.crossJoin(F.broadcast(box)).withColumn(name, good).drop(*box.columns)  # one row


def draw_near(rows: DataFrame, energy: Column, kt: float, key: str, groups: list[str] | None = None, seed: int = 0) -> DataFrame:
    """One row of each group, drawn with chance exp(-energy / kT): the least exponential variate by a hash of seed and key, so the same on every run."""
    even = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    race = F.ln(-F.ln(even)) + energy / kt  # of -ln(u) / w
    fields = F.struct(*rows.columns)
    return rows.groupBy(*(groups or [])).agg(F.min_by(fields, F.struct(race, F.col(key))).alias("drawn")).select("drawn.*")


def close_to(x: list[Column], centre: list[float], k: list[float]) -> Column:
    """The harmonic energy of a distance from a point."""
    return reduce(lambda a, b: a + b, [0.5 * s * (v - c) * (v - c) for v, c, s in zip(x, centre, k, strict=True)])
