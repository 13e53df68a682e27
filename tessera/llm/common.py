"""What the corpus operators share: shared storage, tokens, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as one piece of work.
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_own_dir: list[str] = []
_roots: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what spark.checkpoint.dir names. Only a local session, which is one
    process, may go without that setting and gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own_dir[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_up() -> int:
    """Deletes the tables that operators of this session have written to the shared folder; how many folders went.

    For when their results have been written or read: those read from the tables.
    """
    gone = 0
    while _roots:
        delete(*_roots.pop())
        gone += 1
    return gone


class Scratch:
    """Tables in the shared folder: they cut lineage and outlive executors. clean_up deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))

    def keep(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Writes df as Parquet and returns it as read back."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path) if not by else self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of at most `rows` rows and about `limit` text bytes; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        edges = np.flatnonzero((np.diff(part) > 0) | (np.arange(1, batch.num_rows) % rows == 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a run of texts (null: empty), and where each text's begin, with the end of the last."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], off - off[0]


def as_bytes(items: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls, as bytes (to_pylist takes far longer)."""
    off = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1]
    data = bytes(memoryview(items.buffers()[2] or b"")[off[0] : off[-1]])
    off = (off - off[0]).tolist()
    return [data[lo:hi] for lo, hi in zip(off[:-1], off[1:], strict=True)]


class Tokens:
    """Lower-cased (A-Z) words of a run of texts, split at ASCII white space.

    ids: for each token its place in `words`; at: where each text's tokens
    begin, with the end of the last; words: distinct tokens (binary).
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        data, off = text_bytes(texts)
        solid = ~_SPACE[data]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        first = off[:-1][off[:-1] < off[1:]]
        start[first] = solid[first]
        places = np.flatnonzero(start)
        before = np.cumsum(solid, dtype=np.int32)
        ends = np.concatenate([before[places] - 1, before[-1:] if len(data) else np.zeros(1, np.int32)]).astype(np.int32)
        body = data[solid]
        words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[body] if lower else body)])
        encoded = words.dictionary_encode()
        self.words = encoded.dictionary
        self.ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.at = np.searchsorted(places, off)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return hash_all(as_bytes(self.words), seed)


def hash_all(items: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in items), np.uint64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xC2B2AE3D27D4EB4F)))


def chain(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a run of texts, and where each text's begin.

    h has a hash for each token, at the bounds of each text; n-grams don't
    cross texts.
    """
    lengths = np.maximum(np.diff(at) - (n - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    first = np.repeat(at[:-1] - bounds[:-1], lengths) + np.arange(bounds[-1])
    out = h[first]
    for k in range(1, n):
        out = join_hash(out, h[first + k])
    return out, bounds


#: Bits of a table of marked rows for each of them, and at most.
MARK_BITS, MOST_BITS = 16, 1 << 28


def table_bits(rows: int) -> int:
    """The size of a bit table for so many rows, a power of two."""
    return 1 << max(10, min(MOST_BITS, MARK_BITS * rows).bit_length() - 1)


def bit_table(marked: DataFrame, place: Column, bits: int) -> Broadcast:
    """A broadcast table with the bits set at which marked rows have their place."""
    words = marked.select(place.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("mask")).toArrow()
    table = np.zeros(bits >> 5, np.uint32)
    table[words["word"].to_numpy().astype(np.int64)] = words["mask"].to_numpy().astype(np.uint32)
    return marked.sparkSession.sparkContext.broadcast(table)


def is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


Step = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def marked_rows(rows: DataFrame, marked: DataFrame, key: list[str], some: Step | None = None, rest: Step | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be one of marked, and rows whose key is none.

    some and rest, a function over batches and its schema, are what to do with
    either in the same Python pass.

    A bit table of the marked keys is broadcast: MARK_BITS for each, MOST_BITS
    (32 MB) at most. Where that is too small for them, more rows count as
    marked, which a join sorts out later; none is missed.
    """
    bits = table_bits(marked.count())
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    shared = bit_table(marked, place, bits)

    column = fresh(rows, "marked_at")

    def run(wanted: bool, step: Step | None) -> DataFrame:
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = is_set(shared.value, b.column(column).to_numpy())
                yield b.drop_columns([column]).filter(pa.array(hit if wanted else ~hit))

        then, schema = step or (lambda batches: batches, rows.schema)
        return rows.withColumn(column, place).mapInArrow(lambda batches: then(chosen(batches)), schema)

    return run(True, some), run(False, rest)


#: A key with over one part in HUBS of all rows is hot, unless it has no more than FEW, which hold no task up.
HUBS, FEW = 500, 10_000


def join_counts(rows: DataFrame, key: str, counts: DataFrame, n: str, total: int) -> DataFrame:
    """rows with the columns of counts, of which each key has a row with the number n of its rows.

    Keys with over one part in HUBS of all rows, of which there are HUBS at
    most, get theirs by broadcast, so that their rows stay where they are;
    others by a sort-merge join.
    """
    hubs = counts.where((F.col(n) > FEW) & (F.col(n) * HUBS > total)).collect() if total > FEW else []
    if not hubs:
        return rows.hint("merge").join(counts, key)
    hot = F.col(key).isin([r[key] for r in hubs])
    known = F.broadcast(rows.sparkSession.createDataFrame(hubs, counts.schema))
    return rows.where(~hot).hint("merge").join(counts, key).unionByName(rows.where(hot).join(known, key))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: the least node that each node of edges(a, b) reaches.

    Alternating large and small stars. A node's least neighbour is found by
    partial aggregation and joined to its edges by a sort-merge join; a hub's
    (of which a round has 2 * HUBS at most) by broadcast, so that its edges
    stay where they are. Each round is a table in the shared folder; nothing
    but counts and hubs reaches the driver.
    """

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(both: DataFrame, small: bool, hubs: list[tuple[int, int]]) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if hubs:
            hot = F.col("a").isin([a for a, _ in hubs])
            known = F.broadcast(both.sparkSession.createDataFrame(hubs, "a long, m long"))  # at most 2 * HUBS rows
            moved = both.where(~hot).hint("merge").join(least, "a").unionByName(both.where(hot).join(known, "a"))
        else:
            moved = both.hint("merge").join(least, "a")
        if small:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    # a is the greater end throughout
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges0")
    state, k = tuple(now.agg(*mark).first()), 0
    while state[0]:
        k += 1
        found = [] if state[0] <= FEW else ends(now).groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).where((F.col("n") > FEW) & (F.col("n") * HUBS > state[0])).collect()
        large = star(ends(now), False, [(r["a"], min(r["a"], r["m"])) for r in found])
        new = scratch.keep(star(large, True, []), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        now, before, state = new, state, tuple(new.agg(*mark).first())
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(edges: np.ndarray) -> np.ndarray:
    """A star forest with the components of the edges: each node with its root."""
    nodes, flat = np.unique(edges, return_inverse=True)
    a, b = flat.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[root[moved]]])
