"""Scalar fields over feature space: biases, their combinations, and interpolation kernels."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.metric import Metric


def _from_centre(metric: Metric, x: list[Column], centre: list[float], k: list[float | Decimal]) -> tuple[list[Column], float, Column]:
    """Differences from the centre, the mean of k, and the radius with axes scaled by sqrt(k / mean)."""
    d, mean = metric.difference([F.lit(c) for c in centre], x), float(sum(k) / len(k))
    return d, mean, F.sqrt(reduce(lambda a, b: a + b, [(v * v * F.lit(c)).cast("double") / F.lit(mean) for v, c in zip(d, k, strict=True)]))


def harmonic(metric: Metric, x: list[Column], centre: list[float], k: list[float | Decimal], k_max: float | None = None) -> Column:
    """Sum of k d^2 / 2; with k_max linear beyond the radius where the force would pass it.

    The force constant is the mean of k, axes are scaled by sqrt(k / mean).
    Whole numbers (columns and centres) stay exact where k is given as Decimal.
    """
    _, mean, r = _from_centre(metric, x, centre, k)
    inner = 0.5 * mean * r * r
    if k_max is None:
        return inner
    r0 = k_max / mean
    return F.when(r < r0, inner).otherwise(0.5 * mean * r0 * r0 + k_max * (r - r0))


def harmonic_gradient(metric: Metric, x: list[Column], centre: list[float], k: list[float | Decimal], k_max: float | None = None) -> list[Column]:
    """The gradient of the harmonic bias; beyond the radius of k_max it keeps its direction, and its length no longer grows."""
    d, mean, r = _from_centre(metric, x, centre, k)
    plain = [(v * F.lit(c)).cast("double") for v, c in zip(d, k, strict=True)]
    if k_max is None:
        return plain
    r0 = k_max / mean
    return [g * F.when(r < r0, 1.0).otherwise(F.lit(r0) / r) for g in plain]


def of_function(f: Callable[..., Column], x: list[Column]) -> Column:
    """Any function of the dimensions as a bias."""
    return f(*x)


def added(a: dict[str, Column | None], b: dict[str, Column | None]) -> dict[str, Column | None]:
    """Energies, gradients and virials of two results; a part must be there in both or in neither."""
    if any((a.get(k) is None) != (b.get(k) is None) for k in {*a, *b}):
        raise ValueError("a part is missing on one side")
    sums = {k: (None if a[k] is None else a[k] + b[k] if k == "energy" else F.zip_with(a[k], b[k], lambda x, y: x + y)) for k in a}
    return sums


def chained_gradient(gradient: list[Column], jacobian: Column) -> Column:
    """The gradient by inputs, from that by features and the features' derivatives (a row an input dimension)."""
    return F.transform(jacobian, lambda row: reduce(lambda a, b: a + b, [F.get(row, F.lit(k)) * g for k, g in enumerate(gradient)]))


def spread_bias(bias: Column, log_sigma: Column, kt: float) -> Column:
    """-exp(log sigma - bias / kT): the spread of a free energy, as a bias."""
    return -F.exp(log_sigma - bias / F.lit(kt))


def total(parts: list[Column | None]) -> Column:
    """The sum of biases; None is left out, nothing gives 0."""
    there = [p for p in parts if p is not None]
    return reduce(lambda a, b: a + b, there) if there else F.lit(0.0)


def least(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.least(*parts)


def tempered(bias: Column, t: float, dt: float) -> Column:
    return bias if dt == 0 else bias * F.lit(t / (t + dt))


def round_bias(scale: Column, shared: Column, own: Column | None) -> Column:
    return total([scale * shared, own])


#: Centres that are gathered in one array; more are summed block by block.
CENTRES = 4096


def over_centres(points: DataFrame, centres: DataFrame, fields: list[str], term: Callable[[Column], Column], name: str, start: float = 0.0) -> DataFrame:
    """points with the sum of a term over all centres, and a start.

    Up to CENTRES of them go to every row as one array. More are cut into
    blocks of about as many: each row meets every block, and its sums are
    added up.
    """
    n = centres.count()
    packed = centres.withColumn("centre_block", F.pmod(F.xxhash64(*fields), F.lit(max(1, -(-n // CENTRES))))).groupBy("centre_block").agg(F.collect_list(F.struct(*fields)).alias("centre_rows")).drop("centre_block")
    value = lambda first: F.aggregate(F.transform("centre_rows", term), F.lit(first), lambda acc, v: acc + v)
    if n <= CENTRES:
        packed = centres.agg(F.collect_list(F.struct(*fields)).alias("centre_rows"))
        return points.crossJoin(F.broadcast(packed)).withColumn(name, value(start)).drop("centre_rows")  # one row of CENTRES at most
    rows = points.withColumn("centre_row", F.monotonically_increasing_id()).withColumn("centre_point", F.struct(*points.columns))
    sums = rows.select("centre_row", "centre_point", *points.columns).crossJoin(packed).withColumn("centre_sum", value(0.0))
    return sums.groupBy("centre_row").agg(F.first("centre_point").alias("p"), (F.sum("centre_sum") + start).alias(name)).select("p.*", name)


def hills(points: DataFrame, centres: DataFrame, metric: Metric, dims: int, sigma: list[float]) -> DataFrame:
    """points with `bias`: the sum over centres of height * exp(-sum d^2 / (2 sigma^2)).

    points has id and x0, x1, ...; centres c0, c1, ... and height.
    """

    def one(h: Column) -> Column:
        d = metric.difference([h[f"c{k}"] for k in range(dims)], [F.col(f"x{k}") for k in range(dims)])
        e = reduce(lambda a, b: a + b, [v * v / F.lit(2 * s * s) for v, s in zip(d, sigma, strict=True)])
        return h["height"] * F.exp(-e)

    return over_centres(points, centres, [*[f"c{k}" for k in range(dims)], "height"], one, "bias")


#: Radial kernels of a scaled distance.
KERNELS = {
    "linear": lambda r: -r,
    "thin_plate_spline": lambda r: F.when(r > 0, r * r * F.ln(r)).otherwise(0.0),
    "cubic": lambda r: r * r * r,
    "quintic": lambda r: -r * r * r * r * r,
    "multiquadric": lambda r: -F.sqrt(r * r + 1),
    "inverse_multiquadric": lambda r: 1 / F.sqrt(r * r + 1),
    "inverse_quadratic": lambda r: 1 / (r * r + 1),
    "gaussian": lambda r: F.exp(-r * r),
}


def rbf_evaluate(points: DataFrame, centres: DataFrame, metric: Metric, dims: int, kernel: str = "gaussian", epsilon: float = 1.0, offset: float = 0.0) -> DataFrame:
    """points with `value`: the sum over centres of coefficient * kernel(epsilon * distance) + offset.

    Distances are in units of the box; a periodic axis counts by its chord.
    """
    two_pi = 6.283185307179586

    def one(c: Column) -> Column:
        parts = []
        for k, axis in enumerate(metric.axes):
            if axis.periodic:
                a, b = (axis.map(v) * two_pi for v in (c[f"c{k}"], F.col(f"x{k}")))
                parts += [F.cos(a) - F.cos(b), F.sin(a) - F.sin(b)]
            else:
                parts.append(axis.map(F.col(f"x{k}") - c[f"c{k}"], displace=False))
        r = F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts])) * F.lit(epsilon)
        return c["coefficient"] * KERNELS[kernel](r)

    return over_centres(points, centres, [*[f"c{k}" for k in range(dims)], "coefficient"], one, "value", offset)


def grid_lookup(points: DataFrame, grid: DataFrame, lo: float, step: float, n: int) -> DataFrame:
    """points (id, x) with `value` interpolated between a grid's midpoints (i, value); null outside them.

    An equi-join with the two corners of each point's cell.
    """
    u = (F.col("x") - F.lit(lo)) / F.lit(step) - 0.5
    placed = points.withColumn("u", u).withColumn("i", F.least(F.floor("u"), F.lit(n - 2)).cast("int")).withColumn("t", F.col("u") - F.col("i"))
    cells = grid.select("i", F.col("value").alias("v0")).join(grid.select((F.col("i") - 1).alias("i"), F.col("value").alias("v1")), "i")
    inside = (F.col("u") >= 0) & (F.col("u") <= n - 1)
    return placed.join(cells, "i", "left").withColumn("value", F.when(inside, F.col("v0") * (1 - F.col("t")) + F.col("v1") * F.col("t"))).drop("u", "i", "t", "v0", "v1")


def grid_energy(points: DataFrame, grid: DataFrame, metric: Metric, boxes: list[tuple[float, float]], bins: int, missing: float, name: str = "energy") -> DataFrame:
    """points (x0, x1, ...) with the energy between the midpoints of a sparse grid (i0, i1, ..., value) of `bins` places a dimension.

    boxes gives the grid's bounds. Midpoints that the grid doesn't have count as
    `missing`; beyond the outermost ones the energy stays as it is there, or
    goes on at the other side where an axis is periodic. Points with a null or
    NaN get null. Each cell's corners are gathered in one row first, so that a
    point is joined once, whatever the number of dimensions.
    """
    d = len(metric.axes)
    corners = list(product((0, 1), repeat=d))
    step = [(hi - lo) / bins for lo, hi in boxes]
    u = []
    for k, (axis, (lo, _)) in enumerate(zip(metric.axes, boxes, strict=True)):
        x = F.col(f"x{k}").cast("double")
        at = (axis.wrap(x) - F.lit(lo)) / F.lit(step[k]) - 0.5
        u.append(F.when(x.isNotNull() & ~F.isnan(x), at if axis.periodic else F.least(F.greatest(at, F.lit(0.0)), F.lit(bins - 1.0))))
    lowest = [F.floor(v) if axis.periodic else F.least(F.floor(v), F.lit(max(0, bins - 2))) for v, axis in zip(u, metric.axes, strict=True)]
    around = lambda axis, i: F.pmod(i, F.lit(bins)) if axis.periodic else i
    key = lambda parts: reduce(lambda a, b: a * F.lit(bins + 2) + b, [p.cast("long") + 1 for p in parts])
    offsets = F.array(*[F.array(*[F.lit(o) for o in corner]) for corner in corners])
    posted = grid.withColumn("corner", F.explode(offsets)).select("corner", "value", key([around(a, F.col(f"i{k}") - F.get("corner", F.lit(k))) for k, a in enumerate(metric.axes)]).alias("cell"))
    cells = posted.groupBy("cell").agg(*[F.max(F.when(F.col("corner") == F.array(*[F.lit(o) for o in corner]), F.col("value"))).alias(f"v{n}") for n, corner in enumerate(corners)])
    placed = points.withColumns({f"part{k}": v - i for k, (v, i) in enumerate(zip(u, lowest, strict=True))} | {"cell": key([around(a, i) for a, i in zip(metric.axes, lowest, strict=True)])})
    share = lambda corner: reduce(lambda a, b: a * b, [F.col(f"part{k}") if o else 1 - F.col(f"part{k}") for k, o in enumerate(corner)])
    value = reduce(lambda a, b: a + b, [share(corner) * F.coalesce(F.col(f"v{n}"), F.lit(missing)) for n, corner in enumerate(corners)])
    return placed.join(cells, "cell", "left").withColumn(name, value).drop("cell", *[f"part{k}" for k in range(d)], *[f"v{n}" for n in range(len(corners))])


def grid_lookup_nd(points: DataFrame, grid: DataFrame, axes: list[tuple[float, float, int]], order: int = 1) -> DataFrame:
    """points (x0, x1, ...) with `value` between a grid's midpoints (i0, i1, ..., value); null outside them.

    axes gives low bound, step and number of bins. Order 1 is linear in each
    dimension, an equi-join with each of the 2^d corners of a point's cell;
    order 0 takes the nearest midpoint. Grid rows that are missing give null.
    """
    d = len(axes)
    u = [(F.col(f"x{k}") - F.lit(lo)) / F.lit(step) - 0.5 for k, (lo, step, _) in enumerate(axes)]
    inside = reduce(lambda a, b: a & b, [(v >= (0 if order else -0.5)) & (v <= n - (1 if order else 0.5)) for v, (_, _, n) in zip(u, axes, strict=True)])
    keys = [f"grid_i{k}" for k in range(d)]
    cells = grid.select(*[F.col(f"i{k}").alias(key) for k, key in enumerate(keys)], F.col("value").alias("grid_value"))
    if order == 0:
        placed = points.withColumns({key: F.least(F.floor(v + 0.5), F.lit(n - 1)).cast("int") for key, v, (_, _, n) in zip(keys, u, axes, strict=True)})
        return placed.join(cells, keys, "left").withColumn("value", F.when(inside, F.col("grid_value"))).drop(*keys, "grid_value")
    out = points.withColumns({f"grid_u{k}": v for k, v in enumerate(u)}).withColumns({f"grid_c{k}": F.greatest(F.lit(0), F.least(F.floor(v), F.lit(n - 2))).cast("int") for k, (v, (_, _, n)) in enumerate(zip(u, axes, strict=True))}).withColumn("value", F.when(inside, 0.0))
    for corner in product((0, 1), repeat=d):
        out = out.withColumns({key: F.col(f"grid_c{k}") + corner[k] for k, key in enumerate(keys)}).join(cells, keys, "left")
        share = reduce(lambda a, b: a * b, [(F.col(f"grid_u{k}") - F.col(f"grid_c{k}")) if corner[k] else 1 - (F.col(f"grid_u{k}") - F.col(f"grid_c{k}")) for k in range(d)])
        out = out.withColumn("value", F.col("value") + F.when(share == 0, 0.0).otherwise(share * F.col("grid_value"))).drop(*keys, "grid_value")
    return out.drop(*[f"grid_u{k}" for k in range(d)], *[f"grid_c{k}" for k in range(d)])


def half_cell_in(lo: float, hi: float, n: int) -> tuple[float, float]:
    """Bounds of a grid's midpoints: half a cell inside those of its n bins."""
    step = (hi - lo) / n
    return lo + step / 2, hi - step / 2


def monomial_powers(dims: int, degree: int, periodic: list[bool] | None = None) -> list[tuple[int, ...]]:
    """Exponents of all monomials up to a degree, by degree; a periodic dimension counts as two (cosine and sine)."""
    wide = dims + sum(periodic or [])
    return sorted((p for p in product(range(degree + 1), repeat=wide) if sum(p) <= degree), key=lambda p: (sum(p), p[::-1]))


_FORMS = {
    "linear": lambda r: -r,
    "cubic": lambda r: r**3,
    "multiquadric": lambda r: -((r * r + 1) ** 0.5),
    "inverse_multiquadric": lambda r: (r * r + 1) ** -0.5,
    "inverse_quadratic": lambda r: 1 / (r * r + 1),
    "gaussian": lambda r: 2.718281828459045 ** (-r * r),
    "quintic": lambda r: -(r**5),
}


def unrolled(metric: Metric, x):  # noqa: ANN001, ANN201
    """Points in units of the box, a periodic dimension as cosine and sine."""
    import numpy as np

    columns = []
    for k, axis in enumerate(metric.axes):
        u = (np.asarray(x, float)[:, k] - axis.lo) / (axis.hi - axis.lo)
        columns += [np.cos(2 * np.pi * u), np.sin(2 * np.pi * u)] if axis.periodic else [u]
    return np.stack(columns, axis=1)


def kernel_matrix(a, b, kernel: str, epsilon: float):  # noqa: ANN001, ANN201
    import numpy as np

    r = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)) * epsilon
    if kernel == "thin_plate_spline":
        return np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1)), 0)
    return _FORMS[kernel](r)


def interpolant(metric: Metric, x, y, kernel: str = "gaussian", epsilon: float = 1.0, smoothing: float = 0.0, degree: int = -1, sigma=None):  # noqa: ANN001, ANN201
    """Coefficients of kernels and of a polynomial tail through values at bin midpoints, weighed by their spread.

    A dense solve over as many centres as the grid has bins, on the driver.
    Returns the kernels' coefficients, the tail's, and its exponents.
    """
    import numpy as np

    z, y = unrolled(metric, x), np.asarray(y, float)
    weight = np.ones(len(y)) if sigma is None else np.maximum(np.asarray(sigma, float), 0.1) ** 2
    powers = monomial_powers(len(metric.axes), degree, [a.periodic for a in metric.axes]) if degree >= 0 else []
    k = kernel_matrix(z, z, kernel, epsilon) + smoothing * np.diag(weight)
    p = np.array([[np.prod(row ** np.array(e)) for e in powers] for row in z]).reshape(len(z), len(powers))
    whole = np.block([[k, p], [p.T, np.zeros((len(powers), len(powers)))]])
    solved = np.linalg.lstsq(whole, np.concatenate([y, np.zeros(len(powers))]), rcond=None)[0]
    return solved[: len(y)], solved[len(y) :], powers


def interpolated(metric: Metric, at, x, fitted, kernel: str, epsilon: float):  # noqa: ANN001, ANN201
    """Values of an interpolant at points, in numpy."""
    import numpy as np

    z, q = unrolled(metric, x), unrolled(metric, at)
    coefficients, tail, powers = fitted
    out = kernel_matrix(q, z, kernel, epsilon) @ coefficients
    return out + (np.array([[np.prod(row ** np.array(e)) for e in powers] for row in q]).reshape(len(q), len(powers)) @ tail if len(powers) else 0)


def rbf_fit(x, y, kernel: str = "gaussian", epsilon: float = 1.0, smoothing: float = 0.0):  # noqa: ANN001, ANN201
    """Coefficients of an interpolant without a tail through values at points whose distances are plain."""
    import numpy as np

    x = np.asarray(x, float)
    return np.linalg.solve(kernel_matrix(x, x, kernel, epsilon) + smoothing * np.eye(len(x)), np.asarray(y, float))


def leave_one_out(k, p, y) -> float:  # noqa: ANN001
    """Mean squared error at each point of the interpolant through the others, without fitting it anew."""
    import numpy as np

    whole = np.block([[k, p], [p.T, np.zeros((p.shape[1], p.shape[1]))]])
    inverse = np.linalg.pinv(whole)
    c = (inverse @ np.concatenate([y, np.zeros(p.shape[1])]))[: len(y)]
    return float(np.mean((c / np.diag(inverse)[: len(y)]) ** 2))


def generalised_likelihood(k, p, y) -> float:  # noqa: ANN001
    """The generalised maximum likelihood score of a kernel matrix: small where it fits the values' roughness."""
    import numpy as np

    q = np.linalg.qr(p, mode="complete")[0][:, p.shape[1] :] if p.shape[1] else np.eye(len(k))
    inner, z = q.T @ k @ q, q.T @ y
    sign, logdet = np.linalg.slogdet(inner)
    return float(z @ np.linalg.solve(inner, z) / np.exp(-logdet / len(z))) if sign > 0 else float("inf")


def best_smoothing(metric: Metric, x, y, kernel: str, epsilon: float, degree: int, choices: list[float], score: Callable = leave_one_out) -> float:  # noqa: ANN001
    """The smoothing with the least score."""
    import numpy as np

    z = unrolled(metric, x)
    powers = monomial_powers(len(metric.axes), degree, [a.periodic for a in metric.axes]) if degree >= 0 else []
    p = np.array([[np.prod(row ** np.array(e)) for e in powers] for row in z]).reshape(len(z), len(powers))
    k = kernel_matrix(z, z, kernel, epsilon)
    return min(choices, key=lambda s: score(k + s * np.eye(len(k)), p, np.asarray(y, float)))
