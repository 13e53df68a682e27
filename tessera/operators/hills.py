"""Sums of Gaussian hills over any number of centres: points meet the centres of their own and the next cells only."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.metric import Metric
from tessera.sources.shared import cut

#: Rows of a chunk, centre chunks that meet one of points at once, copies of what meets a crowded cell.
CHUNK, AT_ONCE, SPREAD = 512, 8, 16
#: A cell with over one part in 500 of all rows is crowded (so there are at most 500), unless it has no more than FEW.
CROWDED, FEW = 1 / 500, 4 * CHUNK


def chunked(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, and an array a column: rows of like `by` (longs) brought together, in chunks of up to CHUNK."""
    kinds = dict(rows.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(k).to_numpy() for k in by]
            new = np.arange(b.num_rows) == 0
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], b.num_rows)
            cuts = np.concatenate([np.arange(lo, hi, CHUNK) for lo, hi in zip(starts, ends, strict=True)])
            offsets = pa.array(np.append(cuts, b.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([*[pa.array(k[cuts]) for k in keys], *[pa.ListArray.from_arrays(offsets, b.column(c)) for c in columns]], [*by, *columns])

    schema = ", ".join([f"`{k}` long" for k in by] + [f"`{c}` array<{kinds[c]}>" for c in columns])
    return rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by).mapInArrow(pack, schema)


def spread(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with a salt by their columns, 0 outside crowded cells; and the crowded cells."""
    sizes, total = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")), rows.count()
    crowded = F.broadcast(sizes.where(F.col("rows") > max(FEW, total * CROWDED)).select("cell", F.lit(True).alias("crowded")))  # 500 rows at most
    salt = F.when(F.col("crowded"), F.pmod(F.xxhash64(*columns), F.lit(SPREAD))).otherwise(0).cast("long")
    return rows.join(crowded, "cell", "left").withColumn("salt", salt).drop("crowded"), crowded


def near_sums(points: DataFrame, key: str, centres: DataFrame, metric: Metric, sigma: list[float], reach: float = 9.0) -> DataFrame:
    """key, bias: for each point the sum of height * exp(-sum d^2 / (2 sigma^2)) over the centres within `reach` sigma in each dimension, and some beyond.

    points has x0, x1, ... and a key of its own for each row (a long); centres
    c0, c1, ... and height. At nine sigma a hill has sunk to 3e-18 of its
    height. Cells are `reach` sigma wide. Centres at one place are one hill of
    their heights' sum, points at one place are worked out once. A cell's
    centres are packed in chunks, which are posted in their own and the next
    cells. A crowded cell is spread: its points are dealt over SPREAD tasks and
    its centres' chunks go to each. Points with a null or NaN in any dimension
    have a null bias, such centres count as nothing.
    """
    dims = len(metric.axes)
    counts = [max(1, int((a.hi - a.lo) / (reach * s))) if a.periodic else None for a, s in zip(metric.axes, sigma, strict=True)]
    counts = [1 if n is not None and n < 3 else n for n in counts]

    def place(k: int, column: str):  # noqa: ANN202
        axis, n = metric.axes[k], counts[k]
        if n is None:
            return F.floor((F.col(column) - axis.lo) / (reach * sigma[k])).cast("long")
        return F.least(F.floor(axis.map(axis.wrap(F.col(column))) * n), F.lit(n - 1)).cast("long")

    def sound(names: list[str]):  # noqa: ANN202
        return " and ".join(f"`{n}` is not null and not isnan(`{n}`)" for n in names)

    xs, cs, at = [f"x{k}" for k in range(dims)], [f"c{k}" for k in range(dims)], [f"at{k}" for k in range(dims)]
    own = points.select(F.col(key).cast("long").alias("key"), *[F.col(x).cast("double").alias(x) for x in xs])
    good = own.where(sound(xs))
    spots = cut(good.select(*xs).distinct().withColumn("cell", F.xxhash64(*[place(k, x) for k, x in enumerate(xs)])))
    hills = centres.select(*[F.col(c).cast("double").alias(c) for c in cs], F.col("height").cast("double").alias("height")).where(sound([*cs, "height"]))
    hills = hills.groupBy(*cs).agg(F.sum("height").alias("height")).withColumns({a: place(k, c) for k, (a, c) in enumerate(zip(at, cs, strict=True))})
    hills = cut(hills.withColumn("cell", F.xxhash64(*at)))

    salted, crowded = spread(spots, xs)
    asked = chunked(salted, ["cell", "salt"], xs).withColumn("chunk", F.monotonically_increasing_id())
    steps = F.array(*[F.array(*[F.lit(v) for v in step]) for step in product(*[(0,) if n == 1 else (-1, 0, 1) for n in counts])])
    posted = chunked(spread(hills, cs)[0], [*at, "salt"], [*cs, "height"]).drop("salt").withColumn("step", F.explode(steps))
    shifted = [F.col(a) + F.get("step", F.lit(k)) for k, a in enumerate(at)]
    posted = posted.select(F.xxhash64(*[s if n is None else F.pmod(s, F.lit(n)).cast("long") for s, n in zip(shifted, counts, strict=True)]).alias("cell"), *cs, "height")
    copies = F.when(F.col("crowded"), F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    sent = posted.join(crowded, "cell", "left").withColumn("salt", F.explode(copies)).drop("crowded")
    boxes = [(a.hi - a.lo) if a.periodic else None for a in metric.axes]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = {c: b.column(c).flatten().to_numpy() for c in [*xs, *cs, "height"]}
            point, centre = (b.column(c).offsets.to_numpy() - b.column(c).offsets[0].as_py() for c in ("x0", "c0"))
            chunk = b.column("chunk").to_numpy()
            firsts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))  # a chunk's rows come one after another
            found = []
            for lo, hi in zip(firsts, np.append(firsts[1:], b.num_rows), strict=True):
                spot = [flat[x][point[lo] : point[lo + 1]] for x in xs]
                value = np.zeros(len(spot[0]))
                for row in range(lo, hi, AT_ONCE):
                    part = slice(centre[row], centre[min(row + AT_ONCE, hi)])
                    e = 0.0
                    for x, c, s, box in zip(spot, cs, sigma, boxes, strict=True):
                        d = x[:, None] - flat[c][None, part]
                        if box is not None:
                            d -= box * np.round(d / box)
                        e = e + d * d / (-2 * s * s)
                    value += np.exp(e) @ flat["height"][part]
                found.append([*spot, value])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], [*xs, "bias"])

    # Sizes of packed rows are guesses: all is joined by sorting.
    met = asked.hint("merge").join(sent, ["cell", "salt"]).select("chunk", *xs, *cs, "height").mapInArrow(summed, ", ".join(f"{c} double" for c in [*xs, "bias"]))
    sums = met.groupBy(*xs).agg(F.sum("bias").alias("bias"))
    full = good.hint("merge").join(sums, xs, "left").select("key", F.coalesce("bias", F.lit(0.0)).alias("bias"))
    rest = own.where(f"not ({sound(xs)})").select("key", F.lit(None).cast("double").alias("bias"))
    return full.unionByName(rest).withColumnRenamed("key", key)
