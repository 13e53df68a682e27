"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets are one node. Each node is posted under the
values of the first coordinates of its signature, as many as a link can miss
all of with a chance of MISS at most (the prefix). Posting lists with one node
go. In a list, nodes are compared by the number of coordinates on which they
collide; a pair is taken in the first list only in which it meets, others skip
it. Pairs above the match threshold are confirmed on full shingle sets.

Pairs that collide often enough join their nodes into units, of which only a
spanning forest is sent on. Each unit's full sets then meet once, in tiles of
bounded size, and exact intersections say which pairs are links; again only a
forest goes on. Lists and units that are larger than a tile are first joined
within chunks; nodes outside the largest component so far then meet all the
others, so that no link between components is lost and pairs inside one are
skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, Tokens, bit_table, chain, components, forest, fresh, is_set, join_counts, join_hash, marked_rows, mix, slices, table_bits

#: Coordinates of a signature, chance to lose a link, nodes of a list that one task compares at once.
COORDINATES, MISS, LIST = 64, 1e-9, 1024
#: Nodes of a unit whose full sets meet in one task; shingles beyond which a node counts as several.
UNIT, HEAVY = 512, 8192

#: Bits of a list's number; above them stands the band.
BAND = 40

_FACTORS = np.random.default_rng(11).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(least: int, miss: float = MISS) -> int:
    """Coordinates after which a pair at the bound has met with a chance of 1 - miss."""
    return min(COORDINATES, max(1, math.ceil(math.log(miss) / math.log(max(1 - least / 100, 1e-12)))))


def match_threshold(least: int, miss: float = MISS) -> int:
    """Collisions that a pair at the bound reaches with a chance of 1 - miss."""
    p, total, t = least / 100, 0.0, 0
    while t < COORDINATES:
        total += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if total > miss:
            break
        t += 1
    return max(1, t)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, and where each text's begin."""
    tokens = Tokens(texts)
    h, at = tokens.hashes()[tokens.ids] if len(tokens.ids) else np.zeros(0, np.uint64), tokens.at
    grams, bounds = chain(h, at, words)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    few = np.flatnonzero((np.diff(at) < words) & (np.diff(at) > 0))
    if len(few):  # the whole sequence is the one shingle
        whole = [join_hash(np.bitwise_xor.reduce(mix(h[lo:hi] + np.arange(1, hi - lo + 1, dtype=np.uint64)))[None], np.array([hi - lo], np.uint64))[0] for lo, hi in zip(at[few], at[few + 1], strict=True)]
        grams, doc = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([doc, few])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    first = np.concatenate([[True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]) if len(grams) else np.zeros(0, bool)
    grams, doc = grams[first], doc[first]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def nodes_of(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (0: empty)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(0xA5A5A5A5DEADBEEF)))])
    size = np.diff(at).astype(np.uint64)
    return np.where(size > 0, join_hash(sums[at[1:]] - sums[at[:-1]], size), np.uint64(0)).view(np.int64)


def signatures(docs: DataFrame, words: int, prefix: int) -> DataFrame:
    """doc_id, name (of the text), n, node, and the signature: prefix (whole values) and rest (a byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, at = shingle_sets(part.column("text"), words)
            some = np.flatnonzero(np.diff(at) > 0)
            values = np.zeros((COORDINATES, part.num_rows), np.uint32)
            if len(some):
                for k in range(COORDINATES):
                    values[k, some] = np.minimum.reduceat((grams * _FACTORS[k]) >> np.uint64(32), at[some])
            head, rest = values[:prefix].T.astype(np.uint32), np.ascontiguousarray(mix(values[prefix:].T.astype(np.uint64)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("name"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(nodes_of(grams, at)),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * prefix, pa.int32()), pa.array(np.ascontiguousarray(head).view(np.int32).ravel())),
                    pa.array([x.tobytes() for x in rest], pa.binary()),
                ],
                ["doc_id", "name", "n", "node", "prefix", "rest"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("name", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, name long, n long, node long, prefix array<int>, rest binary")


def near_duplicates(docs: DataFrame, words: int = 3, least: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Words are lower-cased (A-Z) and split at ASCII white space; a set holds the
    distinct runs of `words` words, or with fewer words the whole sequence.
    Documents are linked where 100 * intersection >= least * union. An empty or
    null text is linked with nothing; so is a row whose doc_id is null, and its
    component_id is null. component_id is the least doc_id reached, kept says
    whether that is the row's own. Rows that repeat a doc_id count one by one.
    No other columns are read. An empty table gives an empty result.
    """
    signed, held = grouped(docs, words, least)
    # A set that many documents share is a hot key; the skewed side of a sort-merge join is split.
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").hint("merge").join(held.select("node", "component_id"), "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def grouped(docs: DataFrame, words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, name, n, node for every row (node null: linked with nothing); and node, component_id, first (the name of the row that stands for it)."""
    scratch = Scratch(docs.sparkSession, "near")
    prefix, matches = prefix_length(least), match_threshold(least)
    signed = scratch.keep(signatures(docs, words, prefix), "signatures")
    named = signed.where("n > 0 and doc_id is not null")
    nodes = scratch.keep(named.groupBy("node").agg(F.min(F.struct("doc_id", "name")).alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("rest").alias("rest")).select("node", "doc.doc_id", "doc.name", "n", "prefix", "rest").withColumnRenamed("doc_id", "doc"), "nodes")
    label = components(find_links(docs, nodes, words, least, prefix, matches, scratch), scratch)

    held = nodes.select("node", "doc", "name").join(label, "node", "left").select("node", "doc", "name", F.coalesce("component", "node").alias("component"))
    first = held.groupBy("component").agg(F.min(F.struct("doc", "name")).alias("first")).select("component", F.col("first.doc").alias("component_id"), F.col("first.name").alias("first"))
    return signed.select("doc_id", "name", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node")), held.join(first, "component").select("node", "component_id", "first")


def keep_one(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """The rows of docs that stand for their groups, with all their columns.

    Of a group of near duplicates the row with the least doc_id stays (of
    several, that with the least hash of its text); other rows of that doc_id
    are judged by their own texts. Rows that share doc_id and text count as
    one, and any one of them stays. Rows without doc_id and rows without words
    are in no group; those without words stay but for such repeats. Extra
    columns may have any names. An empty table gives an empty result.

    Only rows that may go or repeat are moved; all others stay where they lie.
    """
    signed, held = grouped(docs, words, least)
    known = signed.where("doc_id is not null")
    away = known.hint("merge").join(held, "node").where((F.col("doc_id") != F.col("component_id")) | ~F.col("name").eqNullSafe(F.col("first"))).select("doc_id", "name").distinct()
    twice = known.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "name")
    scratch = Scratch(docs.sparkSession, "keep-one")
    away = scratch.keep(away, "away")
    key = [fresh(docs, "near_id"), fresh(docs, "near_name")]
    away, twice = away.toDF(*key), twice.toDF(*key)
    keyed = docs.withColumn(key[0], F.col("doc_id").cast("long")).withColumn(key[1], F.xxhash64(F.col("text").cast("string")))
    some, rest = marked_rows(keyed, away.unionByName(twice), key)
    left = some.join(away, key, "left_anti")
    once = left.where(F.col(key[0]).isNotNull()).dropDuplicates(key).unionByName(left.where(F.col(key[0]).isNull()))
    return rest.unionByName(once).select(*docs.columns)


def find_links(docs: DataFrame, nodes: DataFrame, words: int, least: int, prefix: int, matches: int, scratch: Scratch) -> DataFrame:
    """a, b: confirmed links of nodes that hold their components together."""
    spark = docs.sparkSession
    posted = nodes.select("node", F.posexplode("prefix").alias("c", "v")).select("node", (F.col("c").cast("long") * 2**32 + F.col("v").cast("long") + 2**31).alias("list"))
    counts = posted.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    counts = scratch.keep(counts, "counts")
    total = counts.agg(F.sum("size")).first()[0] or 0
    posted = scratch.keep(join_counts(posted, "list", counts, "size", total).withColumn("weight", F.lit(1)), "posted")
    signed = nodes.select("node", "prefix", "rest")

    def meet(entries: DataFrame) -> DataFrame:
        full = entries.hint("merge").join(signed, "node").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
        return full.select("group", "i", "j", "side", "node", "own", "prefix", "rest").mapInArrow(lambda it: candidates(it, prefix, matches), "a long, b long")

    pairs = scratch.keep(meet(tiles(posted.withColumnRenamed("list", "group"), LIST)), "pairs")
    units = components(pairs, Scratch(spark, "units"))
    long = posted.where(F.col("size") > LIST).withColumnRenamed("list", "group").drop("size")
    if long.limit(1).count():  # a node is in many lists and two bands of each: its component is looked up before, and what is read several times is written
        own = scratch.keep(owned(nodes.select("node", "n").join(long, "node", "left_semi"), units), "own")
        entries = scratch.keep(banded(long.join(own, "node"), least), "banded")
        more = scratch.keep(meet(tiles(labelled(entries), LIST)), "more-pairs")
        units = components(pairs.unionByName(more), Scratch(spark, "units"))

    weight = F.ceil(F.col("n") / HEAVY).cast("int").alias("weight")
    members = scratch.keep(units.select("node", F.col("component").alias("group")).join(nodes.select("node", "doc", weight), "node"), "units")
    sets = fetch_sets(docs, members, words, scratch, "sets")
    sizes = scratch.keep(members.groupBy("group").agg(F.sum("weight").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    members = scratch.keep(join_counts(members, "group", sizes, "size", total), "sized")

    def confirm(entries: DataFrame, sets: DataFrame) -> DataFrame:
        full = entries.hint("merge").join(members.select("node", "doc"), "node").join(sets, ["node", "doc"]).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
        return full.select("group", "i", "j", "side", "node", "own", "grams").mapInArrow(lambda it: confirmed(it, least), "a long, b long")

    links = scratch.keep(confirm(tiles(members, UNIT), sets), "links")
    if members.where(F.col("size") > UNIT).limit(1).count():
        label = components(links, Scratch(spark, "parts"))
        entries = scratch.keep(owned(members.where(F.col("size") > UNIT).drop("size"), label), "parted")
        entries = scratch.keep(tiles(labelled(entries), UNIT), "more-tiles")
        few, _ = marked_rows(sets, entries.select("node").distinct(), ["node"])  # most sets have met all of theirs
        links = links.unionByName(scratch.keep(confirm(entries, few), "more-links"))
    return links


def banded(entries: DataFrame, least: int) -> DataFrame:
    """entries of lists, cut by size of set (n): a band is as wide as links allow, and a group holds two neighbouring bands.

    Sets of a link differ in size by less than a band's width, so some group
    has both. The band stands above the list's bits.
    """
    width = max(1.001 * math.log(100 / least), 1e-4)
    band = F.floor(F.log(F.col("n")) / width)
    rest = [c for c in entries.columns if c not in ("group", "n")]
    return entries.select("group", F.explode(F.array(band, band + 1)).alias("band"), *rest).select((F.col("group") + F.col("band") * 2**BAND).alias("group"), *rest)


def owned(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with own, the component of their node (without one: the node)."""
    return rows.join(label, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")


def labelled(own: DataFrame) -> DataFrame:
    """Entries, with their components (own), of groups with several: minor, whether it isn't the group's largest. They are read several times."""
    per = own.groupBy("group", "own").agg(F.sum("weight").alias("k"))
    mixed = per.groupBy("group").agg(F.count(F.lit(1)).alias("owns"), F.max_by("own", F.struct("k", "own")).alias("most"), F.sum("k").alias("size"), F.max("k").alias("top")).where("owns > 1")
    total = per.agg(F.sum("k")).first()[0] or 0
    return join_counts(own, "group", mixed, "size", total).select("group", "node", "own", "size", (F.col("own") != F.col("most")).alias("minor"), (F.col("size") - F.col("top")).alias("minors"))


def tiles(entries: DataFrame, rows: int) -> DataFrame:
    """entries dealt out as group, i, j, side.

    Without labels a group is cut into chunks of about `rows` nodes by hash,
    each a tile of its own: what is missed between chunks is left to a second
    round. With labels, chunks of all nodes meet chunks of the minor ones:
    together with what labels say, every pair of different components.
    """
    chunks = F.ceil(F.col("size") / rows).cast("int")
    i = F.pmod(F.xxhash64("node"), chunks).cast("int")
    if "minor" not in entries.columns:
        return entries.select("group", i.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", F.col("node").alias("own"))
    few = F.ceil(F.col("minors") / rows).cast("int")
    every = entries.select("group", i.alias("i"), F.explode(F.sequence(F.lit(0), few - 1)).alias("j"), F.lit(0).alias("side"), "node", "own")
    minor = entries.where("minor").select("group", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), few).cast("int").alias("j"), F.lit(1).alias("side"), "node", "own")
    return every.unionByName(minor)


def candidates(batches: Iterator[pa.RecordBatch], prefix: int, matches: int) -> Iterator[pa.RecordBatch]:
    """A forest of the pairs in each tile that collide often enough."""
    width = COORDINATES - prefix

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        return [b.column("prefix").flatten().to_numpy().reshape(-1, prefix), np.frombuffer(b"".join(b.column("rest").to_pylist()), np.uint8).reshape(-1, width)]

    for list_, side, node, own, head, rest in groups(batches, columns):
        pairs, two = [], bool(side.any())
        coordinate = (list_ & ((1 << BAND) - 1)) >> 32
        for k in np.flatnonzero(side == 0) if two else range(len(node) - 1):
            those = np.flatnonzero((side == 1) & (own != own[k])) if two else np.arange(k + 1, len(node))
            if coordinate and not two and len(those):  # what met in an earlier list is skipped
                those = those[~(head[those, :coordinate] == head[k, :coordinate]).any(axis=1)]
            if len(those):
                n = (head[those] == head[k]).sum(axis=1) + (rest[those] == rest[k]).sum(axis=1)
                if len(hit := those[n >= matches]):
                    pairs.append(np.stack([np.full(len(hit), node[k]), node[hit]]))
        if pairs:
            yield edges(pairs)


def confirmed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A forest of the pairs in each tile whose full sets are alike enough."""
    for _, side, node, own, grams in groups(batches, lambda b: [np.array(b.column("grams").to_pylist(), object)]):
        first = np.unique(np.stack([side, node]), axis=1, return_index=True)[1]  # a node's set can come from several equal rows
        node, side, own = node[first], side[first], own[first]
        sets = [np.frombuffer(x, np.uint64) for x in grams[first]]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        a, b = alike([sets[k] for k in left], [sets[k] for k in right], least)
        a, b = left[a], right[b]
        good = own[a] != own[b]
        if good.any():
            yield edges([np.stack([node[a[good]], node[b[good]]])])


def alike(left: list[np.ndarray], right: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with 100 * intersection >= least * union, from exact intersection sizes."""
    if len(left) * len(right) <= 16:
        hit = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if fits(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least)]
        return np.array([i for i, _ in hit], np.int64), np.array([j for _, j in hit], np.int64)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    names, where = np.unique(np.concatenate(left + right), return_inverse=True)
    total = np.zeros((len(left), len(right)), np.float32)
    at = sizes[0].sum()
    parts = [(np.repeat(np.arange(len(s)), s), w) for s, w in zip(sizes, (where[:at], where[at:]), strict=True)]
    shared = np.flatnonzero((np.bincount(parts[0][1], minlength=len(names)) > 0) & (np.bincount(parts[1][1], minlength=len(names)) > 0))
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    for lo in range(0, len(shared), 4096):  # sums below 2**24 are exact in float32
        grids = []
        for (row, w), n in zip(parts, (len(left), len(right)), strict=True):
            p = place[w] - lo
            inside = (place[w] >= lo) & (p < 4096)
            grid = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
            grid[row[inside], p[inside]] = 1
            grids.append(grid)
        total += grids[0] @ grids[1].T
    return np.nonzero(fits(total.astype(np.int64), sizes[0][:, None], sizes[1][None, :], least))


def fits(shared, a, b, least: int):  # noqa: ANN001, ANN201
    return 100 * shared >= least * (a + b - shared)


def edges(pairs: list[np.ndarray]) -> pa.RecordBatch:
    tree = forest(np.concatenate(pairs, axis=1))
    return pa.RecordBatch.from_arrays([pa.array(tree[0], pa.int64()), pa.array(tree[1], pa.int64())], ["a", "b"])


def groups(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[tuple]:
    """group, side, node, own and more columns of each tile with at least two rows; rows come sorted, over any number of batches."""
    held: list[tuple] = []

    def merged() -> Iterator[tuple]:
        if held:
            whole = held[0] if len(held) == 1 else tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if len(whole[0]) > 1:
                yield int(whole[0][0]), *whole[3:]

    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(b.column(c).to_numpy() for c in ("group", "i", "j", "side", "node", "own")) + tuple(columns(b))
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        if held and any(held[-1][k][-1] != cols[k][0] for k in range(3)):
            yield from merged()
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if k:
                yield from merged()
            held.append(tuple(c[lo:hi] for c in cols))
    yield from merged()


def fetch_sets(docs: DataFrame, members: DataFrame, words: int, scratch: Scratch, name: str) -> DataFrame:
    """node, doc, grams of the members (and of few others); texts aren't moved.

    Of a node's documents only the one that it is named by is looked at, told
    by a bit table over ids that is sized by the number of members; its set
    goes on if another over nodes has it.
    """
    bits = table_bits(members.count())
    wanted = bit_table(members, F.pmod("node", F.lit(bits)), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            grams, at = shingle_sets(part.column("text"), words)
            node, doc = nodes_of(grams, at), part.column("doc").to_numpy()
            one = np.sort(np.unique(np.stack([node, doc]), axis=1, return_index=True)[1])
            one = one[is_set(wanted.value, node[one] % bits)]
            sets = [grams[at[k] : at[k + 1]].tobytes() for k in one]
            yield pa.RecordBatch.from_arrays([pa.array(node[one]), pa.array(doc[one]), pa.array(sets, pa.binary())], ["node", "doc", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    found, _ = marked_rows(rows, members.select("doc"), ["doc"], some=(run, "node long, doc long, grams binary"))
    return scratch.keep(found, name)
