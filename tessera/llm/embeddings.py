"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are laid out in the order of their grid cells (of side epsilon)
along leading principal dimensions. Runs of that order form a tree of
intervals with bounding boxes; pairs of intervals are joined recursively, and
those whose boxes are more than epsilon apart are skipped. Within a pair of
blocks the recursion goes on down to small runs, whose cosines are taken in
double precision. The axes only steer the pruning: any axes give the same
links.

Blocks that are left to join travel by tiles: squares of neighbouring blocks,
so a block goes once to a tile and not once to each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components, forest

#: Rows to fit the axes on at most, axes, rows of a block, rows of a run within blocks.
SAMPLE, AXES, BLOCK, RUN = 4096, 8, 2048, 128
#: Blocks along a side of a tile at most, and tiles along the table at least (as far as there are blocks).
TILE, ACROSS = 32, 8
#: Below the bound, so that rounding of the boxes can't lose a pair.
SLACK = 1e-6
BLOCK_SCHEMA = "part int, block long, lo array<double>, hi array<double>, n int, width int, rep binary, copies binary, rows binary"


def axes(rows: DataFrame, sample: int = SAMPLE, count: int = AXES) -> np.ndarray:
    """Leading principal axes (rows) of a bounded sample of unit vectors: those with the least hashes."""
    found = rows.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("x").toArrow()["x"]
    vectors = [np.array(v) for v in found.to_pylist()]
    width = max(map(len, vectors), default=0)
    if not width:
        return np.zeros((0, 0))
    unit = normed(np.stack([np.pad(v, (0, width - len(v))) for v in vectors]))
    _, turned = np.linalg.eigh(unit.T @ unit / len(unit) - np.outer(unit.mean(0), unit.mean(0)))
    return turned[:, ::-1][:, :count].T


def near_duplicates(vectors: DataFrame, least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    n_links counts the other rows with cosine at least `least` (0 < least < 1);
    component_id is the least vec_id reachable by links, the row's own
    included; kept is vec_id = component_id. A vector that is null, zero, or
    has null or non-finite components links with nothing. Vectors of different
    lengths count as filled with zeros. Rows that repeat a vec_id count one by
    one; a null vec_id links with nothing. Other columns are not read.

    Equal vectors go through the join once, with their number. What comes out
    of a pair of blocks is a count a row and a spanning forest of its links,
    never all pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "grid-order")
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), x).alias("x"))
    reps = scratch.keep(all_rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")

    epsilon = float(np.sqrt(2 - 2 * least)) + SLACK
    turned = axes(reps)
    found = join(reps, turned, epsilon, least, block, scratch)

    degrees = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    label = components(edges, scratch).withColumnRenamed("node", "rep")
    groups = reps.join(degrees.withColumnRenamed("node", "rep"), "rep", "left").join(label, "rep", "left")
    groups = groups.select("x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # A vector that many rows share is a hot key here; a sort-merge join's skewed side is split.
    out = all_rows.hint("merge").join(groups, "x", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def pack(reps: DataFrame, turned: np.ndarray, epsilon: float, block: int) -> DataFrame:
    """Blocks of vectors in epsilon grid order, packed, with their boxes along the axes."""
    n = reps.count()
    parts = max(1, -(-n // (4 * block)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = dense(b.column("x"), turned.shape[1])
            unit = normed(rows)
            cell = np.floor(unit[:, : turned.shape[1]] @ turned.T / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1) * cell.shape[1], pa.int32()), pa.array(cell.ravel())), b.column("rep"), b.column("copies"), b.column("x")], ["cell", "rep", "copies", "x"])

    ordered = reps.select("rep", "copies", "x").mapInArrow(cells, "cell array<int>, rep long, copies long, x array<double>")
    ordered = ordered.repartitionByRange(parts, "cell", "rep").sortWithinPartitions("cell", "rep").withColumn("part", F.spark_partition_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for part, rep, copies, rows in runs(batches, turned.shape[1], block):
            unit = normed(rows)
            lo, hi = box(unit[:, : turned.shape[1]] @ turned.T)
            values = [[part], [k], [lo.tolist()], [hi.tolist()], [len(rep)], [rows.shape[1]], [rep.tobytes()], [copies.tobytes()], [rows.tobytes()]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])
            k += 1

    return ordered.mapInArrow(blocks, BLOCK_SCHEMA)


def dense(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(lists)), lengths)
    if len(column) and column.max() >= width:  # longer than any sampled vector
        out = np.zeros((len(lists), int(column.max()) + 1))
    out[row, column] = flat
    return out[:, :width] if not out[:, width:].any() else out


def runs(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    count = 0

    def out(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return table["part"][0].as_py(), table["rep"].to_numpy().astype(np.int64), table["copies"].to_numpy().astype(np.int64), dense(table["x"].combine_chunks(), width)

    for b in batches:
        while b.num_rows:
            take = b.slice(0, block - count)
            held.append(take)
            count += take.num_rows
            b = b.slice(take.num_rows)
            if count == block:
                yield out(pa.Table.from_batches(held))
                held, count = [], 0
    if count:
        yield out(pa.Table.from_batches(held))


def box(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return places.min(axis=0), places.max(axis=0)


def join(reps: DataFrame, turned: np.ndarray, epsilon: float, least: float, block: int, scratch: Scratch) -> DataFrame:
    """node, links, other: with other null a count of linked rows, else an edge of a spanning forest."""
    schema = "node long, links long, other long"
    if not turned.size:
        return reps.sparkSession.createDataFrame([], schema)
    packed = scratch.keep(pack(reps, turned, epsilon, block), "blocks")
    pairs = interval_pairs(packed.select("part", "block", "lo", "hi"), epsilon)

    blocks = packed.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
    side = max(1, min(TILE, -(-blocks[0] // ACROSS)) * blocks[1] // max(blocks[0], 1))  # in parts
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    ends = pairs.select(tile("i_part").alias("ti"), tile("j_part").alias("tj"), F.explode(F.array(*[F.struct(F.lit(k).alias("right"), F.col(f"{c}_part").alias("part"), F.col(f"{c}_block").alias("block")) for k, c in ((False, "i"), (True, "j"))])).alias("e"))
    needed = ends.select("ti", "tj", "e.*").groupBy("ti", "tj", "part", "block").agg(F.bool_or(~F.col("right")).alias("left"), F.bool_or("right").alias("right"))
    tasks = max(1, min(20_000, (-(-blocks[1] // side)) ** 2))
    dealt = needed.join(packed.select("part", "block", "n", "width", "rep", "copies", "rows"), ["part", "block"]).repartition(tasks, "ti", "tj").sortWithinPartitions("ti", "tj", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and (row["ti"], row["tj"]) != (held[0]["ti"], held[0]["tj"]):
                    yield tiled(held)
                    held = []
                held.append(row)
        if held:
            yield tiled(held)

    def tiled(held: list[dict]) -> pa.RecordBatch:
        """All pairs of a tile's blocks, left ones not after right ones; those whose boxes are apart end at once."""
        out = [np.zeros((3, 0), np.int64)]
        made = [prepared(*unpack(x), turned) for x in held]
        for x, left in zip(held, made, strict=True):
            for y, right in zip(held, made, strict=True):
                if x["left"] and y["right"] and (x["part"], x["block"]) <= (y["part"], y["block"]):
                    out.append(np.stack(links_of(left, right, x is y, epsilon, least)))
        node, links, other = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64(), mask=other == np.iinfo(np.int64).min)], ["node", "links", "other"])

    return scratch.keep(dealt.mapInArrow(run, schema), "links")


def unpack(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(x["rep"], np.int64), np.frombuffer(x["copies"], np.int64), np.frombuffer(x["rows"], float).reshape(x["n"], x["width"])


def prepared(rep: np.ndarray, copies: np.ndarray, rows: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, copies, unit vectors and their places along the axes."""
    unit = normed(rows)
    return rep, copies, unit, unit[:, : turned.shape[1]] @ turned.T


def normed(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; the largest component is taken out first, so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def interval_pairs(blocks: DataFrame, epsilon: float, fan: int = 16) -> DataFrame:
    """Pairs of blocks (i not after j) that the recursion over intervals leaves.

    An interval is a run of blocks of the grid order; each level of the tree
    splits a run into up to `fan` runs. A level's pairs come from joining the
    children of the surviving pairs above.
    """
    levels = [
        (F.lit(0), F.floor(F.col("part") / fan**2)),
        (F.floor(F.col("part") / fan**2), F.floor(F.col("part") / fan)),
        (F.floor(F.col("part") / fan), F.col("part").cast("long")),
        (F.col("part").cast("long"), F.col("part").cast("long") * 2**32 + F.col("block")),
    ]
    axes_n = F.size("lo")
    pairs = None
    for parent, own in levels:
        nodes = blocks.select(parent.cast("long").alias("parent"), own.cast("long").alias("own"), F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "v"), axes_n.alias("k"))
        nodes = nodes.groupBy("parent", "own", "d").agg(F.min("v.lo").alias("l"), F.max("v.hi").alias("h")).groupBy("parent", "own").agg(F.array_sort(F.collect_list(F.struct("d", "l", "h"))).alias("box"))
        if pairs is None:
            pairs = nodes.select(F.col("parent").alias("pi"), F.col("parent").alias("pj")).distinct()
        left = nodes.select(F.col("parent").alias("pi"), F.col("own").alias("i"), F.col("box").alias("bi"))
        right = nodes.select(F.col("parent").alias("pj"), F.col("own").alias("j"), F.col("box").alias("bj"))
        gaps = F.zip_with("bi", "bj", lambda a, b: F.greatest(a.l - b.h, b.l - a.h, F.lit(0.0)))
        near = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= epsilon * epsilon
        pairs = pairs.join(left, "pi").join(right, "pj").where((F.col("i") <= F.col("j")) & near).select(F.col("i").alias("pi"), F.col("j").alias("pj"))
    high = lambda c: F.shiftright(F.col(c), 32).cast("int")
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1))
    return pairs.select(high("pi").alias("i_part"), low("pi").alias("i_block"), high("pj").alias("j_part"), low("pj").alias("j_block"))


def links_of(left: tuple, right: tuple, same: bool, epsilon: float, least: float, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and a spanning forest of the links between two prepared blocks (of one block with itself, if same)."""
    (rep_i, copies_i, unit_i, place_i), (rep_j, copies_j, unit_j, place_j) = left, right
    width = max(unit_i.shape[1], unit_j.shape[1])
    unit = [u if u.shape[1] == width else np.pad(u, ((0, 0), (0, width - u.shape[1]))) for u in (unit_i, unit_j)]
    place = [place_i, place_j]
    n = len(rep_i)
    degree = [np.zeros(n, np.int64), np.zeros(len(rep_j), np.int64)]
    links: list[np.ndarray] = []

    def recurse(a: tuple[int, int], b: tuple[int, int]) -> None:
        if same and a[0] > b[0]:
            return
        (lo_a, hi_a), (lo_b, hi_b) = box(place[0][slice(*a)]), box(place[1][slice(*b)])
        gap = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0)
        if gap @ gap > epsilon * epsilon:
            return
        if a[1] - a[0] > run or b[1] - b[0] > run:
            for x in halves(a, run):
                for y in halves(b, run):
                    recurse(x, y)
            return
        hit = unit[0][slice(*a)] @ unit[1][slice(*b)].T >= least
        if same and a == b:
            hit = np.triu(hit, 1)
        if hit.any():
            degree[0][slice(*a)] += hit @ copies_j[slice(*b)]
            degree[1][slice(*b)] += copies_i[slice(*a)] @ hit
            p, q = np.nonzero(hit)
            links.append(forest(np.stack([p + a[0], q + b[0] + (0 if same else n)])))

    recurse((0, n), (0, len(rep_j)))
    rep = rep_i if same else np.concatenate([rep_i, rep_j])
    counts = degree[0] + degree[1] if same else np.concatenate(degree)
    tree = forest(np.concatenate(links, axis=1)) if links else np.zeros((2, 0), np.int64)
    some = counts > 0
    none = np.full(int(some.sum()), np.iinfo(np.int64).min)
    return np.concatenate([rep[some], rep[tree[0]]]), np.concatenate([counts[some], np.zeros(tree.shape[1], np.int64)]), np.concatenate([none, rep[tree[1]]])


def halves(run: tuple[int, int], least: int) -> list[tuple[int, int]]:
    lo, hi = run
    if hi - lo <= least:
        return [run]
    mid = lo + -(-(hi - lo) // (2 * least)) * least
    return [(lo, mid), (mid, hi)] if mid < hi else [run]
