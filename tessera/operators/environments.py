"""Neighbours of points in periodic frames of any cell, reductions over them, and spectra of their surroundings.

Edges come from an equi-join on frame and grid cell; everything after is
grouped sums over edges (of built-in expressions, or of numpy over batches for
spectra), so no frame's pairs are ever gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g

Radial = Callable[[np.ndarray, int, int], np.ndarray]


def atoms(frames: DataFrame, frame: str, positions: str, cell: str, kinds: Column) -> DataFrame:
    """frame, cell, i, kind, p: a row a point; kinds is an array as long as positions."""
    whole = frames.select(F.col(frame).alias("frame"), F.col(cell).alias("cell"), F.posexplode(F.arrays_zip(F.col(positions).alias("p"), kinds.alias("kind"))).alias("i", "a"))
    return whole.select("frame", "cell", "i", F.col("a.kind").alias("kind"), F.col("a.p").alias("p"))


def edges(points: DataFrame, r: float, itself: bool = False) -> DataFrame:
    """frame, i, j, kind_i, kind_j, image, d, r: points j (and which image of them) closer than r to i.

    d is the vector from i to the image of j, with points wrapped into their
    cells. points is as `atoms` gives them. A frame is cut into grid cells of
    at least r across along each of its vectors; where the frame is narrower,
    several images of it are looked at. Each point asks half of the grid cells
    round its own, and what it finds counts both ways. With itself, a point is
    its own neighbour at distance 0.

    All is done in plain numbers: asking points carry a frame, a cell's number
    and their place moved by the image, and no arrays.
    """
    axes = range(3)
    flat = points.selectExpr("frame", "i", "kind", *[f"p[{b}] x{b}" for b in axes], *[f"cell[{a}][{b}] h{a}{b}" for a in axes for b in axes])
    # Row k of the cofactors is the cross product of the other two cell vectors.
    others = [((k + 1) % 3, (k + 2) % 3) for k in axes]
    flat = flat.selectExpr("*", *[f"h{a}{c}*h{b}{d} - h{a}{d}*h{b}{c} f{k}{j}" for k, (a, b) in enumerate(others) for j, (c, d) in enumerate(others)])
    flat = flat.selectExpr("*", "h00*f00 + h01*f01 + h02*f02 det")
    flat = flat.selectExpr("*", *[f"(x0*f{k}0 + x1*f{k}1 + x2*f{k}2)/det v{k}" for k in axes], *[f"{r!r}*sqrt(f{k}0*f{k}0 + f{k}1*f{k}1 + f{k}2*f{k}2)/abs(det) w{k}" for k in axes])
    # m: grid cells along a vector; reach: how many of them r goes.
    flat = flat.selectExpr("frame", "i", "kind", *[f"h{a}{b}" for a in axes for b in axes], *[f"v{k} - floor(v{k}) u{k}" for k in axes], *[f"w{k}" for k in axes], *[f"greatest(1L, floor(1/w{k})) m{k}" for k in axes])
    placed = flat.selectExpr("frame", "i", "kind", *[f"h{a}{b}" for a in axes for b in axes], *[f"m{k}" for k in axes], *[f"ceil(w{k}*m{k}) reach{k}" for k in axes], *[f"least(floor(u{k}*m{k}), m{k} - 1) c{k}" for k in axes], *[f"u0*h0{b} + u1*h1{b} + u2*h2{b} p{b}" for b in axes])
    wide1, wide2 = "(2*reach1 + 1)", "(2*reach2 + 1)"
    asking = placed.selectExpr("*", f"(2*reach0 + 1)*{wide1}*{wide2} steps")
    asking = asking.selectExpr("*", "explode(sequence(steps div 2, steps - 1)) step")  # the first is the own cell, the rest lie on one side of it
    asking = asking.selectExpr("*", f"c0 - reach0 + step div ({wide1}*{wide2}) a0", f"c1 - reach1 + step div {wide2} % {wide1} a1", f"c2 - reach2 + step % {wide2} a2")
    asking = asking.selectExpr("*", *[f"floor(a{k}/m{k}) n{k}" for k in axes])
    asking = asking.selectExpr("frame", "i", "kind kind_i", "((a0 - n0*m0)*m1 + a1 - n1*m1)*m2 + a2 - n2*m2 place", *[f"cast(n{k} as int) n{k}" for k in axes], "step = steps div 2 own", *[f"p{b} - n0*h0{b} - n1*h1{b} - n2*h2{b} q{b}" for b in axes])
    there = placed.selectExpr("frame", "(c0*m1 + c1)*m2 + c2 place", "i j", "kind kind_j", "p0", "p1", "p2")
    both = asking.hint("merge").join(there, ["frame", "place"]).selectExpr("frame", "i", "j", "kind_i", "kind_j", "n0", "n1", "n2", "own", *[f"p{b} - q{b} d{b}" for b in axes])
    # Range and order are judged on what a generator gives, and r goes through the next one too: else Catalyst would
    # infer constraints from the bound on r, over all that it is made of, without end in later filters and joins.
    both = both.selectExpr("*", "inline(array(struct(sqrt(d0*d0 + d1*d1 + d2*d2) r, not own or i < j once)))").where(f"once and r < {r!r}")
    out = both.selectExpr(
        "frame", "inline(array(struct(i, j, kind_i, kind_j, array(n0, n1, n2) image, array(d0, d1, d2) d, r), struct(j i, i j, kind_j kind_i, kind_i kind_j, array(-n0, -n1, -n2) image, array(-d0, -d1, -d2) d, r)))"
    ).select("frame", "i", "j", "kind_i", "kind_j", "image", "d", "r")
    if not itself:
        return out
    zero = F.array(*[F.lit(0.0)] * 3)
    return out.unionByName(points.select("frame", "i", F.col("i").alias("j"), F.col("kind").alias("kind_i"), F.col("kind").alias("kind_j"), F.array(*[F.lit(0)] * 3).alias("image"), zero.alias("d"), F.lit(0.0).alias("r")))


_BY = {"full": ["frame", "i"], "z": ["frame", "i", "kind_j"], "split_z": ["frame", "kind_i", "kind_j"], "frame": ["frame"]}


def reduced(edge: DataFrame, value: Column, how: str = "full") -> DataFrame:
    """Number and sum of a value over edges: by point ("full"), point and kind of neighbour ("z"), kinds of both ("split_z"), or frame."""
    return edge.groupBy(*_BY[how]).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))


def pairs(edge: DataFrame, unique: bool = True) -> DataFrame:
    """Ordered pairs of neighbours of one point: columns of the second have the ending _2; cosine is that of their angle.

    With unique a neighbour isn't paired with itself.
    """
    second = edge.select("frame", "i", *[F.col(c).alias(f"{c}_2") for c in ("j", "kind_j", "image", "d", "r")])
    both = edge.join(second, ["frame", "i"])
    if unique:
        both = both.where((F.col("j") != F.col("j_2")) | (F.col("image") != F.col("image_2")))
    return both.withColumn("cosine", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g.dot(F.col("d"), F.col("d_2")) / (F.col("r") * F.col("r_2")))))


def pairs_reduced(pair: DataFrame, value: Column, how: str = "full") -> DataFrame:
    """Number and sum over neighbour pairs: by point ("full"), by point and kinds of both neighbours ("z")."""
    keys = {"full": ["frame", "i"], "z": ["frame", "i", "kind_j", "kind_j_2"]}[how]
    return pair.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))


def kinds(points: DataFrame) -> DataFrame:
    """kind, n: points of each kind a frame holds (the most of any frame)."""
    return points.groupBy("frame", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.max("n").alias("n"))


def one_hot(kind: Column, known: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, known)), lambda k: (k == kind).cast("double"))


def needs_update(old: DataFrame, new: DataFrame, skin: float) -> DataFrame:
    """frame, stale: whether any point has moved by more than half the skin since the edges were made. Both are as `atoms` gives them."""
    both = old.select("frame", "i", F.col("p").alias("p0")).join(new.select("frame", "i", "p"), ["frame", "i"])
    d = g.minus(F.col("p"), F.col("p0"))
    return both.groupBy("frame").agg((F.max(g.dot(d, d)) > skin * skin / 4).alias("stale"))


def within(edge: DataFrame, r: float) -> DataFrame:
    """Edges made with a skin, cut to those closer than r."""
    return edge.where(F.col("r") < r)


# Spectra: radial and angular parts of any order, in numpy over batches of edges.


def fade(r: np.ndarray, cut: float) -> np.ndarray:
    return 0.5 * (1 + np.cos(np.pi / cut * r))


def spherical(x: np.ndarray, order: int, modified: bool = False) -> np.ndarray:
    """Spherical Bessel function j_order at x > 0; modified: i_order times exp(-x).

    Where x is small against the order, the recurrence upwards loses digits:
    there it is a power series.
    """
    sign = 1.0 if modified else -1.0
    small = x < max(2.0, order / 2)
    lo, hi = np.where(small, x, 1.0), np.where(small, max(2.0, order / 2), x)
    term = np.ones_like(lo)
    for n in range(order):
        term = term * lo / (2 * n + 3)
    series = term.copy()
    for k in range(1, 20 + order):
        term = term * sign * lo * lo / (2 * k * (2 * order + 2 * k + 1))
        series += term
    e = np.exp(-2 * hi)
    two = [(1 - e) / (2 * hi), ((hi - 1) + (hi + 1) * e) / (2 * hi * hi)] if modified else [np.sin(hi) / hi, np.sin(hi) / (hi * hi) - np.cos(hi) / hi]
    for n in range(1, order):
        two.append(two[-2] - (2 * n + 1) / hi * two[-1] if modified else (2 * n + 1) / hi * two[-1] - two[-2])
    return np.where(small, series * (np.exp(-lo) if modified else 1.0), two[order])


def bessel_radial(cut: float) -> Radial:
    """Spherical Bessel functions of order l of (n + 1) pi r / cut, faded out; r is above 0."""
    return lambda r, n, order: spherical(r * (n + 1) * np.pi / cut, order) * fade(r, cut)


def soap_radial(cut: float, sigma: float, nodes: int = 6) -> Radial:
    """Overlap of a neighbour's Gaussian with polynomial basis functions, by order: an integral over the shell by the midpoint rule, faded out."""

    def radial(r: np.ndarray, n: int, order: int) -> np.ndarray:
        total = np.zeros_like(r)
        for q in range(nodes):
            s = (q + 0.5) * cut / nodes
            total += (cut - s) ** (n + 2) * s * s * cut / nodes * np.exp(-((r - s) ** 2) / (2 * sigma**2)) * spherical(r * s / sigma**2, order, modified=True)
        return total * fade(r, cut)

    return radial


def harmonics(unit: np.ndarray, order: int) -> list[np.ndarray]:
    """Real solid angle functions of an order at unit vectors (n, 3), scaled so that their products sum to the Legendre polynomial of the cosine.

    By recurrences: in the order for the part along z, in the number for the
    sines and cosines around it.
    """
    x, y, z = unit.T
    out, cosine, sine = [], np.ones_like(x), np.zeros_like(x)
    for m in range(order + 1):
        low, now = np.zeros_like(x), np.full_like(x, math.prod(range(2 * m - 1, 0, -2)))
        for n in range(m + 1, order + 1):
            low, now = now, ((2 * n - 1) * z * now - (n + m - 1) * low) / (n - m)
        scale = math.sqrt((2 if m else 1) * math.factorial(order - m) / math.factorial(order + m))
        out += [now * cosine * scale] + [now * sine * scale] * bool(m)
        cosine, sine = x * cosine - y * sine, x * sine + y * cosine
    return out


def power_spectrum(edge: DataFrame, radial: Radial, n_max: int = 2, l_max: int = 2, normalise: bool = False) -> DataFrame:
    """frame, i, kind_a, kind_b, spectrum: for each point and pair of kinds (a <= b), entries over n <= m and order.

    An entry is the sum over neighbours j of kind a and k of kind b of
    R_n(r_j) R_m(r_k) P_l(cos angle). By the addition theorem it is a product
    of sums over single neighbours, so neighbour pairs are never made. Entries
    of different kinds count sqrt(2); normalise divides by the point's length.

    Batches of edges are summed by point and kind where they are, and Spark
    adds up the sums; radial maps distances, n and the order to numbers.
    """
    terms = [(n, order, k) for order in range(l_max + 1) for n in range(n_max) for k in range(2 * order + 1)]
    names = [f"c{t}" for t in range(len(terms))]
    near = edge.selectExpr("frame", "i", "kind_j", "d[0] x", "d[1] y", "d[2] z", "r")
    keys = {c: t for c, t in near.dtypes if c in ("frame", "i", "kind_j")}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(batch["r"], 1e-12))  # filters stay out of the plan, where inferring constraints over so many columns takes minutes
            if not batch.num_rows:
                continue
            batch = batch.sort_by([(c, "ascending") for c in keys])
            r = batch["r"].to_numpy(zero_copy_only=False)
            unit = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in "xyz"], 1) / r[:, None]
            first = np.zeros(len(r), bool)
            first[0] = True
            for c in keys:
                first[1:] |= pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(first)
            radials = {(n, order): radial(r, n, order) for order in range(l_max + 1) for n in range(n_max)}
            angular = [harmonics(unit, order) for order in range(l_max + 1)]
            columns = [np.add.reduceat(radials[n, order] * angular[order][k], at) for n, order, k in terms]
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(at)) for c in keys] + [pa.array(c) for c in columns], [*keys, *names])

    parts = near.mapInArrow(sums, ", ".join([f"{c} {t}" for c, t in keys.items()] + [f"{c} double" for c in names]))
    whole = parts.groupBy("frame", "i", "kind_j").agg(*[F.sum(c).alias(c) for c in names])
    kinds_of = whole.groupBy("frame", "i").agg(F.collect_list(F.struct("kind_j", F.array(*names).alias("c"))).alias("of"))  # as many as there are kinds

    place = {t: k for k, t in enumerate(terms)}
    entries = [[(place[n, order, k], place[m, order, k]) for k in range(2 * order + 1)] for order in range(l_max + 1) for n in range(n_max) for m in range(n, n_max)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, of = pc.list_value_length(batch["of"]).to_numpy(zero_copy_only=False), pc.list_flatten(batch["of"])
            row, kind = np.repeat(np.arange(len(size)), size), pc.struct_field(of, "kind_j")
            c = np.asarray(pc.list_flatten(pc.struct_field(of, "c"))).reshape(len(row), len(terms))
            one = np.repeat(np.arange(len(row)), size[row])  # each kind of a point with each
            two = np.arange(len(one)) - np.repeat(np.cumsum(size * size) - size * size, size * size)
            two = two % size[row[one]] + (np.cumsum(size) - size)[row[one]]
            kept = pc.less_equal(kind.take(pa.array(one)), kind.take(pa.array(two))).to_numpy(zero_copy_only=False)
            one, two = one[kept], two[kept]
            out = np.stack([sum(c[one, x] * c[two, y] for x, y in e) for e in entries], 1) * np.where(one == two, 1.0, math.sqrt(2.0))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(entries), pa.int32()), pa.array(out.ravel()))
            at = pa.array(row[one])
            yield pa.RecordBatch.from_arrays([batch["frame"].take(at), batch["i"].take(at), kind.take(pa.array(one)), kind.take(pa.array(two)), lists], ["frame", "i", "kind_a", "kind_b", "spectrum"])

    out = kinds_of.mapInArrow(products, f"frame {keys['frame']}, i {keys['i']}, kind_a {keys['kind_j']}, kind_b {keys['kind_j']}, spectrum array<double>")
    if not normalise:
        return out
    lengths = out.groupBy("frame", "i").agg(F.sqrt(F.sum(F.aggregate("spectrum", F.lit(0.0), lambda acc, v: acc + v * v))).alias("length"))
    return out.join(lengths, ["frame", "i"]).withColumn("spectrum", F.transform("spectrum", lambda v: v / F.when(F.col("length") > 0, F.col("length")).otherwise(1.0))).drop("length")


def pair_polynomials(pair: DataFrame, n_max: int) -> DataFrame:
    """frame, i, kind_j, kind_j_2 (rising), value: sums over neighbour pairs of r_j^a r_k^b cos^c, a + b + c <= n_max, as an array."""
    powers = [(a, b, c) for a in range(n_max + 1) for b in range(n_max + 1 - a) for c in range(n_max + 1 - a - b)]
    term = lambda a, b, c: F.pow("r", F.lit(float(a))) * F.pow("r_2", F.lit(float(b))) * F.pow("cosine", F.lit(float(c)))
    return pair.where("kind_j <= kind_j_2").groupBy("frame", "i", "kind_j", "kind_j_2").agg(F.array(*[F.sum(term(*p)) for p in powers]).alias("value"))


def inverse_spread(values: DataFrame, value: str, variance: bool = True) -> DataFrame:
    """kind, weight: 1 / variance (or 1 / deviation) of an array column's parts, pooled over points of a kind."""
    cells = values.select("kind", F.posexplode(value).alias("k", "v"))
    spread = F.var_pop("v") if variance else F.stddev_pop("v")
    return cells.groupBy("kind", "k").agg(spread.alias("s")).groupBy("kind").agg((1 / F.avg("s")).alias("weight"))


def summed_by_kind(values: DataFrame, value: str, layers: list[dict[int, list[list[float]]]], activation: Callable[[Column], Column]) -> DataFrame:
    """frame, kind, pooled: an array of each point through layers with matrices of its kind, then summed by kind: order of points doesn't matter."""
    from tessera.functions.transforms import matmul

    x = F.col(value)
    for layer in layers:
        for_kind = F.when(F.lit(False), x)
        for kind, matrix in layer.items():
            for_kind = for_kind.when(F.col("kind") == kind, matmul(matrix)(x))
        x = F.transform(for_kind, activation)
    cells = values.select("frame", "kind", F.posexplode(x).alias("k", "v")).groupBy("frame", "kind", "k").agg(F.sum("v").alias("v"))
    return cells.groupBy("frame", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c.v).alias("pooled"))  # as long as the layer is wide


# Masses and motion.


def without_drift(points: DataFrame, mass: str, velocity: str) -> DataFrame:
    """points with the frame's mass-weighted mean velocity taken off."""
    total = points.groupBy("frame").agg(*[(F.sum(F.col(mass) * g.at(F.col(velocity), k)) / F.sum(mass)).alias(f"drift{k}") for k in range(3)])
    return points.join(total, "frame").withColumn(velocity, F.array(*[g.at(F.col(velocity), k) - F.col(f"drift{k}") for k in range(3)])).drop(*[f"drift{k}" for k in range(3)])


def inertia(points: DataFrame, mass: str, position: str) -> DataFrame:
    """frame, inertia: the 3 x 3 tensor sum m (r^2 1 - r r^T)."""
    p = [g.at(F.col(position), k) for k in range(3)]
    square = p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    cell = lambda i, j: F.sum(F.col(mass) * ((square if i == j else F.lit(0.0)) - p[i] * p[j]))
    return points.groupBy("frame").agg(F.array(*[F.array(*[cell(i, j) for j in range(3)]) for i in range(3)]).alias("inertia"))


def angular_momentum(points: DataFrame, mass: str, position: str, velocity: str) -> DataFrame:
    """frame, momentum: sum m r x v."""
    turn = g.cross(F.col(position), F.col(velocity))
    return points.groupBy("frame").agg(F.array(*[F.sum(F.col(mass) * g.at(turn, k)) for k in range(3)]).alias("momentum"))


def thermal_velocities(points: DataFrame, mass: str, kt: float, seed: int) -> DataFrame:
    """points with `velocity` drawn from the Maxwell-Boltzmann distribution: by a hash of seed, frame and place, so the same on every run."""
    even = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "frame", "i"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.ln(even(2 * k))) * F.cos(2 * math.pi * even(2 * k + 1))
    return points.withColumn("velocity", F.array(*[normal(k) * F.sqrt(F.lit(kt) / F.col(mass)) for k in range(3)]))
