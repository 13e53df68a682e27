"""A composable algebra of row-wise transforms of feature arrays.

`f * g` applies f, then g; `f + g` applies both to the same input and joins
their outputs. Transforms are Column expressions, so Catalyst fuses whole
pipelines into one projection.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import wraps
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Op = Callable[[Column], Column]


@dataclass(frozen=True)
class Transform:
    """An array<double> column to another; back undoes it, where it can be undone.

    spec is the builder's name and arguments that it was made of; none for
    transforms of free functions, which can't be written down.
    """

    apply: Op
    back: Op | None = None
    spec: list | None = None

    def __call__(self, x: Column) -> Column:
        return self.apply(x)

    def __mul__(self, after: Transform) -> Transform:
        both = self.back and after.back
        return Transform(lambda x: after.apply(self.apply(x)), (lambda y: self.back(after.back(y))) if both else None, _joined("*", self, after))

    def __add__(self, beside: Transform) -> Transform:
        return Transform(lambda x: F.concat(self.apply(x), beside.apply(x)), spec=_joined("+", self, beside))

    def inverse(self) -> Transform:
        if self.back is None:
            raise ValueError("this transform can't be undone")
        return Transform(self.back, self.apply, _joined("inverse", self))

    def to_json(self) -> str:
        """This transform as text, for `from_json`."""
        if self.spec is None:
            raise ValueError("a transform of free functions can't be written down")
        return json.dumps(self.spec, default=lambda v: v.tolist())  # numbers and arrays of numpy

    def jacobian(self, dims: int, step: float = 1e-5) -> Op:
        """The matrix of derivatives, a row an input dimension, by central differences; one projection, no shuffle."""

        def moved(x: Column, k: int, by: float) -> Column:
            return self.apply(F.transform(x, lambda v, i: v + F.when(i == k, by).otherwise(0.0)))

        return lambda x: F.array(*[F.zip_with(moved(x, k, step), moved(x, k, -step), lambda a, b: (a - b) / (2 * step)) for k in range(dims)])

    def type_of(self, rows: DataFrame, column: str) -> str:
        """The type of the outcome, by analysis alone: nothing runs."""
        return rows.select(self.apply(F.col(column)).alias("y")).schema["y"].dataType.simpleString()


#: Builders of transforms that can be written down, by name.
BUILDERS: dict[str, Callable[..., Transform]] = {
    "*": lambda f, g: f * g,
    "+": lambda f, g: f + g,
    "inverse": lambda f: f.inverse(),
}


def _joined(name: str, *parts: Transform) -> list | None:
    return None if any(p.spec is None for p in parts) else [name, [{"of": p.spec} for p in parts], {}]


def kept(build: Callable[..., Transform]) -> Callable[..., Transform]:
    """A builder whose transforms can be written down, by its name and arguments."""

    @wraps(build)
    def named(*args, **more) -> Transform:  # noqa: ANN002, ANN003
        given = [*args, *more.values()]
        if any(isinstance(v, Transform) and v.spec is None for v in given):
            return build(*args, **more)
        plain = lambda v: {"of": v.spec} if isinstance(v, Transform) else v
        return replace(build(*args, **more), spec=[build.__name__, [plain(v) for v in args], {k: plain(v) for k, v in more.items()}])

    BUILDERS[build.__name__] = named
    return named


def from_json(text: str) -> Transform:
    """The transform that `to_json` wrote down. Only builders of this module are called; a name that isn't one raises KeyError."""

    def built(spec: list) -> Transform:
        name, args, more = spec
        whole = lambda v: built(v["of"]) if isinstance(v, dict) else v
        return BUILDERS[name](*[whole(v) for v in args], **{k: whole(v) for k, v in more.items()})

    return built(json.loads(text))


def vector(*values: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def each(f: Op) -> Transform:
    return Transform(lambda x: F.transform(x, f))


identity = Transform(lambda x: x, lambda y: y, ["identity", [], {}])
BUILDERS["identity"] = lambda: identity


@kept
def take(*at: int) -> Transform:
    """The dimensions at these places, from 0."""
    return Transform(lambda x: F.array(*[F.get(x, F.lit(k)) for k in at]))


@kept
def part(start: int, length: int) -> Transform:
    """A run of dimensions, from 0: undoes one part of a joined array."""
    return Transform(lambda x: F.slice(x, start + 1, length))


@kept
def append(*values: float) -> Transform:
    return Transform(lambda x: F.concat(x, vector(*values)))


@kept
def shift(*by: float) -> Transform:
    return Transform(lambda x: F.zip_with(x, vector(*by), lambda a, b: a + b), lambda y: F.zip_with(y, vector(*by), lambda a, b: a - b))


@kept
def scale(*by: float) -> Transform:
    return Transform(lambda x: F.zip_with(x, vector(*by), lambda a, b: a * b), lambda y: F.zip_with(y, vector(*by), lambda a, b: a / b))


@kept
def constant(*values: float) -> Transform:
    """The same outcome for every input."""
    return Transform(lambda x: vector(*values))


def of_function(f: Op) -> Transform:
    """Any function of the whole array."""
    return Transform(f)


#: An array of arrays as one array.
flat = Transform(F.flatten, spec=["flat", [], {}])
BUILDERS["flat"] = lambda: flat


def learnable_scale(dims: int, seed: int, spread: float = 0.1) -> tuple[Callable[[list[float]], Transform], list[float]]:
    """A scale by parameters, and their first values: near 1, by seed."""
    import numpy as np

    return (lambda values: scale(*values)), (1 + spread * np.random.default_rng(seed).normal(size=dims)).tolist()


def first_weights(inputs: int, outputs: int, seed: int) -> list[list[float]]:
    """First values of a matrix: normal, with a spread of 1 / sqrt(inputs)."""
    import numpy as np

    return (np.random.default_rng(seed).normal(size=(inputs, outputs)) / np.sqrt(inputs)).tolist()


def orthogonal(skew: list[list[float]]) -> list[list[float]]:
    """The Cayley map of a matrix's skew part: a rotation, for a linear layer that keeps lengths."""
    import numpy as np

    a = np.array(skew, float)
    a = a - a.T
    return np.linalg.solve(np.eye(len(a)) + a, np.eye(len(a)) - a).tolist()


def spectral(rows: list[list[float]], steps: int = 5) -> list[list[float]]:
    """A matrix over its largest singular value, by power iteration."""
    import numpy as np

    m = np.array(rows, float)
    v = np.ones(m.shape[1]) / np.sqrt(m.shape[1])
    for _ in range(steps):
        u = m @ v
        u /= max(np.linalg.norm(u), 1e-12)
        v = m.T @ u
        v /= max(np.linalg.norm(v), 1e-12)
    return (m / max(u @ m @ v, 1e-12)).tolist()


@kept
def min_max(lo: list[float], hi: list[float]) -> Transform:
    """To [0, 1] by given bounds; a constant dimension keeps its scale."""
    return shift(*[-v for v in lo]) * scale(*[1 / (h - v) if h > v else 1.0 for v, h in zip(lo, hi, strict=True)])


@kept
def standardise(mean: list[float], std: list[float], keep_mean: bool = False) -> Transform:
    """(x - mean) / std; a constant dimension gives 0 (or its mean)."""
    out = shift(*[-m for m in mean]) * scale(*[1 / s if s else 0.0 for s in std])
    return out * shift(*mean) if keep_mean else out


@kept
def matmul(rows: list[list[float]]) -> Transform:
    """x @ M, for M given by rows."""
    columns = list(zip(*rows, strict=True))
    dot = lambda x, c: F.aggregate(F.zip_with(x, vector(*c), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return Transform(lambda x: F.array(*[dot(x, c) for c in columns]))


@kept
def linear(rows: list[list[float]], bias: list[float] | None = None) -> Transform:
    return matmul(rows) * shift(*bias) if bias else matmul(rows)


@kept
def rotate_2d(alpha: float) -> Transform:
    import math

    c, s = math.cos(alpha), math.sin(alpha)
    return matmul([[c, s], [-s, c]])


@kept
def project_distances(a: float) -> Transform:
    """Two distances to their place along and across the line between their ends."""
    return Transform(lambda r: F.array(((F.get(r, F.lit(1)) * F.get(r, F.lit(1)) - F.get(r, F.lit(0)) * F.get(r, F.lit(0))) / (2 * a)) / a + 0.5, (F.get(r, F.lit(0)) + F.get(r, F.lit(1))) / (2 * a)))


@kept
def monomials(dims: int, order: int, inverse: bool = False) -> Transform:
    """All products of `order` factors out of 1 and the dimensions (and their inverses)."""

    def apply(x: Column) -> Column:
        base = [F.lit(1.0), *[F.get(x, F.lit(k)) for k in range(dims)]]
        if inverse:
            base += [1 / F.get(x, F.lit(k)) for k in range(dims)]
        out = []
        for picks in combinations_with_replacement(range(len(base)), order):
            value = base[picks[0]]
            for k in picks[1:]:
                value = value * base[k]
            out.append(value)
        return F.array(*out)

    return Transform(apply)


@kept
def indicators(lo: float, hi: float, n: int, dim: int = 0, periodic: bool = False) -> Transform:
    """n soft steps (tanh) along one dimension, at even places between lo and hi; on a circle from lo to hi each falls again half a turn on."""
    width, turn = (hi - lo) / n, hi - lo

    def one(x: Column, k: int) -> Column:
        d = F.get(x, F.lit(dim)) - F.lit(lo + (k + 0.5) * width)
        if periodic:
            d = F.pmod(d + turn / 2, F.lit(turn)) - turn / 2
            d = F.when(F.abs(d) <= turn / 4, d).otherwise(F.signum(d) * (turn / 2 - F.abs(d)))
        return (F.tanh(d / F.lit(width)) + 1) / 2

    return Transform(lambda x: F.array(*[one(x, k) for k in range(n)]))


@kept
def group_sort(size: int, groups: int) -> Transform:
    """Sorts within fixed groups of dimensions."""
    return Transform(lambda x: F.flatten(F.array(*[F.array_sort(F.slice(x, g * size + 1, size)) for g in range(groups)])))


@kept
def smooth_abs(eps: float = 1e-6) -> Transform:
    return each(lambda v: F.sqrt(v * v + eps))


@kept
def leak(f: Transform, alpha: float) -> Transform:
    """(1 - alpha) f(x) + alpha x."""
    return Transform(lambda x: F.zip_with(f(x), x, lambda a, b: (1 - alpha) * a + alpha * b))


_SELU = (1.0507009873554805, 1.6732632423543772)
_SIGMOID: Op = lambda v: 1 / (1 + F.exp(-v))

#: Element-wise activation functions by name.
ACTIVATIONS: dict[str, Transform] = {
    "identity": identity,
    "relu": each(lambda v: F.greatest(v, F.lit(0.0))),
    "relu6": each(lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(6.0))),
    "leaky_relu": each(lambda v: F.when(v >= 0, v).otherwise(0.01 * v)),
    "elu": each(lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1)),
    "selu": each(lambda v: _SELU[0] * F.when(v > 0, v).otherwise(_SELU[1] * (F.exp(v) - 1))),
    "sigmoid": each(_SIGMOID),
    "log_sigmoid": each(lambda v: F.least(v, F.lit(0.0)) - F.log1p(F.exp(-F.abs(v)))),
    "tanh": each(F.tanh),
    "hard_sigmoid": each(lambda v: F.least(F.greatest(v + 3, F.lit(0.0)), F.lit(6.0)) / 6),
    "hard_swish": each(lambda v: v * F.least(F.greatest(v + 3, F.lit(0.0)), F.lit(6.0)) / 6),
    "sort": Transform(F.array_sort),
    "hard_tanh": each(lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))),
    "softplus": each(lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))),
    "soft_sign": each(lambda v: v / (1 + F.abs(v))),
    "swish": each(lambda v: v * _SIGMOID(v)),
    "gelu": each(lambda v: 0.5 * v * (1 + F.tanh(0.7978845608028654 * (v + 0.044715 * v * v * v)))),
    "abs": each(F.abs),
    "square": each(lambda v: v * v),
    "sin": each(F.sin),
}


@kept
def activation(name: str, alpha: float = 0.0) -> Transform:
    f = ACTIVATIONS[name]
    return leak(f, alpha) if alpha else f


def soft_max(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda acc, w: acc + w))


@kept
def periodic_pair(dims: int) -> Transform:
    """cos and sin of each angle: the real form of exp(ix)."""
    return Transform(lambda x: F.array(*[f(F.get(x, F.lit(k))) for k in range(dims) for f in (F.cos, F.sin)]))


@kept
def angle_of_pair(dims: int) -> Transform:
    """The angles that periodic_pair was made of, in (-pi, pi]."""
    return Transform(lambda x: F.array(*[F.atan2(F.get(x, F.lit(2 * k + 1)), F.get(x, F.lit(2 * k))) for k in range(dims)]))


@kept
def real_parts(dims: int) -> Transform:
    """The real part of each of periodic_pair's numbers."""
    return take(*range(0, 2 * dims, 2))


@kept
def scatter(*to: int) -> Transform:
    """Dimension k goes to place to[k]."""
    return take(*sorted(range(len(to)), key=lambda k: to[k]))


@kept
def clip(lo: float, hi: float) -> Transform:
    return each(lambda v: F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def pair_distances(positions: Column, count: int, scaled: float = 1.0, inverse: bool = False, log: bool = False, eps: float = 1e-8) -> Column:
    """Distances of all pairs i < j of the first `count` positions, over a scale, and then inverted or in logarithms."""

    def one(i: int, j: int) -> Column:
        d = [F.get(F.get(positions, F.lit(j)), F.lit(k)) - F.get(F.get(positions, F.lit(i)), F.lit(k)) for k in range(3)]
        r = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / scaled
        r = 1 / (r + eps) if inverse else r
        return F.ln(r + eps) if log else r

    return F.array(*[one(i, j) for i in range(count) for j in range(i + 1, count)])


def smooth_step(r: Column, cut: float, a: float) -> Column:
    """1 within the cutoff and 0 beyond, softly."""
    return 1 / (1 + F.exp(F.lit(a) * (r - cut)))


def body_features(pairs: list[Column], angles: list[Column], torsions: list[Column], cut: float, a: float, top: int = 2) -> tuple[Column, list[bool]]:
    """Powers of distances (faded) and of angles, and multiples of torsions; and which dimensions are periodic."""
    out = [F.pow(r, F.lit(float(n))) * smooth_step(r, cut, a) for r in pairs for n in range(top + 1)]
    out += [F.pow(t, F.lit(float(n))) for t in angles for n in range(1, top + 1)]
    turns = [t * n for t in torsions for n in range(1, top + 1)]
    return F.array(*out, *turns), [False] * len(out) + [True] * len(turns)


def ratio_powers(pairs: list[Column], cut: float, up: int, down: int) -> Column:
    """Powers 1 to `up` of r / cut, and 1 to `down` of cut / r."""
    return F.array(*[F.pow(r / cut, F.lit(float(n))) for r in pairs for n in range(1, up + 1)], *[F.pow(F.lit(cut) / r, F.lit(float(n))) for r in pairs for n in range(1, down + 1)])


def invariant_polynomials(groups: list[list[Column]], top: int = 2) -> Column:
    """For each group of like distances, sums of their powers 1 to top: the same whatever the order of like points."""
    power_sum = lambda g, n: F.aggregate(F.transform(F.array(*g), lambda r: F.pow(r, F.lit(float(n)))), F.lit(0.0), lambda acc, v: acc + v)
    return F.array(*[power_sum(g, n) for g in groups for n in range(1, top + 1)])


@kept
def centre_periodic(*angles: float) -> Transform:
    """Each angle relative to a centre, in [-pi, pi)."""
    two_pi = 6.283185307179586
    return Transform(lambda x: F.zip_with(x, vector(*angles), lambda v, a: F.pmod(v - a + two_pi / 2, F.lit(two_pi)) - two_pi / 2))


@kept
def affine_2d(old: list[tuple[float, float]], new: list[tuple[float, float]]) -> Transform:
    """The perspective map that takes four points to four others."""
    import numpy as np

    rows, right = [], []
    for (x, y), (u, v) in zip(old, new, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    h = np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist()

    def apply(p: Column) -> Column:
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        w = h[6] * x + h[7] * y + 1
        return F.array((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w)

    return Transform(apply)


@kept
def reduce_parts(length: int, count: int, mean: bool = True) -> Transform:
    """Sum or mean over `count` equal parts of a joined array."""

    def apply(x: Column) -> Column:
        out = F.slice(x, 1, length)
        for k in range(1, count):
            out = F.zip_with(out, F.slice(x, k * length + 1, length), lambda a, b: a + b)
        return F.transform(out, lambda v: v / count) if mean else out

    return Transform(apply)
