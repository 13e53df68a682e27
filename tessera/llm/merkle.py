"""Merkle manifest of a dataset: DuckDB works on aligned buckets of leaves, Spark combines their roots and joins the outer proofs.

A tree has FANOUT children a node. FANOUT ** levels consecutive nodes of a
tree, aligned at a multiple of that, are a bucket: a row of a table, so
that a bucket is never split over tasks, and a source of any size is as many
buckets as it needs. Within a batch of buckets, DuckDB works out each level by
one query (ordered string_agg, sha256). Roots of buckets are the nodes of the
next table, until each source has one; the sources' roots are a tree of the
same kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

FANOUT, LEVELS = 3, 7
#: Leaves that DuckDB holds at a time, about.
LEAVES = 30_000

_NODE = "g long, i long, n long, h string"
_PATH = "g long, i long, subroot string, lefts array<string>, rights array<string>"
_PROOF = "doc_id long, g long, rank long, n long, leaf string, subroot string, proof string, folded_root string"


def sized(*columns: str) -> Column:
    """The values of columns as text: '-' for null, else the UTF-8 byte count, ':' and the value."""
    return F.concat(*[F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns])


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Engine:
    """Level queries over a batch of buckets: l0 has the nodes, l1 their parents, and so on; s0, s1, ... the siblings of each node, joined, at its left and right."""

    def __init__(self, levels: int) -> None:
        self.levels, self.width = levels, FANOUT**levels
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})

    def load(self, buckets: pa.Table, nodes: pa.Table) -> int:
        """Buckets (b, n, ...) and nodes (b, i, h, ...); the greatest height."""
        self.con.register("buckets_in", buckets)
        self.con.register("nodes_in", nodes)
        steps = " ".join(f"WHEN n <= {FANOUT**k} THEN {k}" for k in range(self.levels))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE buckets AS SELECT *, CASE {steps} ELSE {self.levels} END AS height FROM buckets_in")
        self.con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT b, i, height, h FROM nodes_in JOIN buckets USING (b)")
        return self.con.execute("SELECT max(height) FROM buckets").fetchall()[0][0]

    def climb(self, top: int) -> None:
        for k in range(top):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT b, i // {FANOUT} AS i, height, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k} WHERE height > {k} GROUP BY b, i // {FANOUT}, height")

    def siblings(self, top: int) -> None:
        before = " || ".join(f"coalesce(lag(h, {k}) OVER run, '')" for k in range(FANOUT - 1, 0, -1))
        after = " || ".join(f"coalesce(lead(h, {k}) OVER run, '')" for k in range(1, FANOUT))
        for k in range(top):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE s{k} AS SELECT b, i, {before} AS lo, {after} AS hi FROM l{k} WHERE height > {k} WINDOW run AS (PARTITION BY b, i // {FANOUT} ORDER BY i)")

    def roots(self, top: int) -> pa.Table:
        found = " UNION ALL ".join(f"SELECT b, h FROM l{k} WHERE height = {k}" for k in range(top + 1))
        return self.con.sql(f"SELECT g, bucket, n, h FROM ({found}) JOIN buckets USING (b)").to_arrow_table()

    def paths(self, top: int) -> pa.Table:
        """Siblings of every node from its own level to the root of the whole tree, a text a level and side."""
        path = f"SELECT b, CAST(0 AS BIGINT) AS i, lefts, rights FROM buckets WHERE height = {top}"
        for k in range(top - 1, -1, -1):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE p AS {path}")
            self.con.execute(
                f"CREATE OR REPLACE TEMP TABLE p{k} AS SELECT s.b, s.i, list_prepend(s.lo, p.lefts) AS lefts, list_prepend(s.hi, p.rights) AS rights FROM s{k} s JOIN p ON p.b = s.b AND p.i = s.i // {FANOUT} UNION ALL SELECT b, 0, lefts, rights FROM buckets WHERE height = {k}"
            )
            path = f"SELECT * FROM p{k}"
        return self.con.sql(f"SELECT g, bucket * {self.width} + i AS i, subroot, p.lefts, p.rights FROM ({path}) p JOIN buckets USING (b)").to_arrow_table()

    def proofs(self, top: int) -> pa.Table:
        """For every leaf its proof, joined to one text, and the root that its checked hash folds to."""
        path = f"SELECT b, CAST(0 AS BIGINT) AS i, array_to_string(list_transform(lefts, lambda x, k: x || rights[k]), '') AS proof FROM buckets WHERE height = {top}"
        for k in range(top - 1, -1, -1):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE p AS {path}")
            path = f"SELECT s.b, s.i, s.lo || s.hi || p.proof AS proof FROM s{k} s JOIN p ON p.b = s.b AND p.i = s.i // {FANOUT} UNION ALL SELECT b, 0, array_to_string(list_transform(lefts, lambda x, k: x || rights[k]), '') FROM buckets WHERE height = {k}"
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE p AS {path}")
        self.con.execute("CREATE OR REPLACE TEMP TABLE f AS SELECT b, i, i AS at, checked AS h FROM nodes_in")
        for k in range(top):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE f AS SELECT f.b, f.i, f.at // {FANOUT} AS at, CASE WHEN s.b IS NULL THEN f.h ELSE sha256(s.lo || f.h || s.hi) END AS h FROM f LEFT JOIN s{k} s ON s.b = f.b AND s.i = f.at")
        for k in range(1, 1 + self.con.execute("SELECT coalesce(max(len(lefts)), 0) FROM buckets").fetchall()[0][0]):
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE f AS SELECT f.b, f.i, CASE WHEN len(lefts) < {k} THEN f.h ELSE sha256(lefts[{k}] || f.h || rights[{k}]) END AS h FROM f JOIN buckets USING (b)")
        return self.con.sql(f"SELECT doc_id, g, bucket * {self.width} + i AS rank, n, x.h AS leaf, subroot, proof, f.h AS folded_root FROM nodes_in x JOIN p USING (b, i) JOIN f USING (b, i) JOIN buckets USING (b)").to_arrow_table()


def batches_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Buckets and their nodes (the list column `items` of structs), some LEAVES at a time."""
    for batch in batches:
        items = batch.column("items")
        bounds = items.offsets.to_numpy()
        lo = 0
        while lo < batch.num_rows:
            hi = lo + 1
            while hi < batch.num_rows and bounds[hi + 1] - bounds[lo] <= LEAVES:
                hi += 1
            part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
            lists = part.column("items").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            nodes = pa.Table.from_struct_array(lists.flatten()).append_column("b", lists.value_parent_indices().cast(pa.int64()))
            yield part.select(keys).append_column("b", pa.array(range(hi - lo), pa.int64())), nodes
            lo = hi


def bucket_roots(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    engine = Engine(levels)
    for buckets, nodes in batches_of(batches, ["g", "bucket", "n"]):
        top = engine.load(buckets, nodes)
        engine.climb(top)
        found = engine.roots(top)
        n = pa.array([-(-x // engine.width) for x in found["n"].to_pylist()], pa.int64())
        yield from pa.table({"g": found["g"], "i": found["bucket"], "n": n, "h": found["h"]}).to_batches()


def bucket_siblings(batches: Iterator[pa.RecordBatch], levels: int, leaves: bool) -> Iterator[pa.RecordBatch]:
    engine = Engine(levels)
    for buckets, nodes in batches_of(batches, ["g", "bucket", "n", "subroot", "lefts", "rights"]):
        top = engine.load(buckets, nodes)
        engine.climb(top)
        engine.siblings(top)
        yield from (engine.proofs(top) if leaves else engine.paths(top)).to_batches()


class Trees:
    """Trees over the nodes (g, i, n, h, ...) of groups g, with n nodes each at i = 0, 1, ...; other columns stay with their nodes."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, name: str, levels: int):
        self.packed: list[DataFrame] = []
        self.levels, width = levels, FANOUT**levels
        while True:
            step = f"{name}{len(self.packed)}"
            extra = [c for c in nodes.columns if c not in ("g", "i", "n")]
            items = F.sort_array(F.collect_list(F.struct(F.expr(f"i % {width} AS i"), *extra)))
            rows = nodes.groupBy("g", F.expr(f"i div {width}").alias("bucket"), "n").agg(items.alias("items"))
            self.packed.append(scratch.keep(rows, f"{step}-buckets"))
            nodes = scratch.keep(self.packed[-1].mapInArrow(lambda batches: bucket_roots(batches, levels), _NODE), f"{step}-roots")
            if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
                break
        #: g, i (0), n (1), h: the root of each group.
        self.roots = nodes

    def buckets(self, level: int, above: DataFrame) -> DataFrame:
        outer = above.withColumnRenamed("i", "bucket")
        return self.packed[level].join(outer, ["g", "bucket"])

    def paths(self, above: DataFrame, least: int = 0) -> DataFrame:
        """The paths of all nodes of level `least`; above has those of the groups' roots."""
        levels = self.levels
        for level in range(len(self.packed) - 1, least - 1, -1):
            above = self.buckets(level, above).mapInArrow(lambda batches: bucket_siblings(batches, levels, False), _PATH)
        return above

    def proofs(self, above: DataFrame) -> DataFrame:
        """The proofs of all leaves, which have a doc_id and a hash to check; above as in paths."""
        levels = self.levels
        return self.buckets(0, self.paths(above, 1)).mapInArrow(lambda batches: bucket_siblings(batches, levels, True), _PROOF)


def ranked(rows: DataFrame, scratch: Scratch, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """Rows in order within each group: with g, the group's rank (null first, then bytewise), i, the row's rank in it, and n, the group's rows; and the number of groups.

    Rows are sorted by ranges of (group, order), so a group of any share is
    spread over tasks; what the driver sees is a number for each partition.
    """
    by = [group, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = scratch.keep(placed.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
    runs = placed.groupBy("part", F.col(group).alias("run_of")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy("run_of")
    runs = runs.withColumns({"n": F.sum("rows").over(whole), "start": F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    runs = scratch.keep(runs, "runs")
    begun = sorted(map(tuple, runs.where("start = 0").groupBy("part").count().collect()))
    if not begun:
        return placed, 0
    earlier, total = [], 0
    for part, n in begun:
        earlier.append((part, total))
        total += n
    bases = rows.sparkSession.createDataFrame(earlier, "part int, base long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    groups = scratch.keep(runs.where("start = 0").join(F.broadcast(bases), "part").select("run_of", (F.col("base") + inside).alias("g")), "groups")
    runs = runs.join(groups.withColumnRenamed("run_of", "named"), F.col("run_of").eqNullSafe(F.col("named"))).drop("named", "rows").withColumnRenamed("part", "run_part")
    runs = scratch.keep(runs, "numbered")
    on = (F.col("part") == F.col("run_part")) & F.col(group).eqNullSafe(F.col("run_of"))
    return placed.join(runs, on).select("g", (F.col("start") + F.col("place") - F.col("first")).alias("i"), "n", *[c for c in rows.columns if c != group]), total


def manifest(docs: DataFrame, checked: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A Merkle tree of documents a source, and one of the sources' roots: doc_id, g, rank, n, leaf, subroot, root, proof, folded_root.

    A leaf is the sha256 of doc_id, source, lang, n_chars and text, each '-'
    if null, else its UTF-8 byte count, ':' and its value. g is the source's
    place among the sources, rank the document's in its source, n the number
    of the source's documents; proof has the hashes of the siblings, joined,
    from the leaf up; folded_root is what the proof leads to from a leaf of
    the text `checked` instead (by default, from the text itself). levels is how
    many levels a bucket has, which doesn't change the result.

    A null or empty source is a source. Rows that share a doc_id are leaves
    each, in the order of their hashes; a null doc_id comes first. Columns of
    other names are not read. An empty table gives an empty result.

    Texts are read once and not moved: what is sorted and bucketed is a hash
    or two a document. The driver sees a number for each partition and the root.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    fields = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"), (F.col("text") if checked is None else checked).cast("string").alias("checked"))
    head = ("doc_id", "source", "lang", "n_chars")
    leaf = sha256(sized(*head, "text"))
    other = F.when(F.col("checked").eqNullSafe(F.col("text")), F.col("leaf")).otherwise(sha256(sized(*head, "checked")))
    leaves = scratch.keep(fields.withColumn("leaf", leaf).select("source", "doc_id", "leaf", other.alias("checked")), "leaves")
    rows, sources = ranked(leaves, scratch, "source", ["doc_id", "leaf", "checked"])
    spark = docs.sparkSession
    if not sources:
        return spark.createDataFrame([], _PROOF + ", root string")
    trees = Trees(rows.withColumnRenamed("leaf", "h"), scratch, "leaves", levels)
    top = Trees(trees.roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(sources).cast("long").alias("n"), "h"), scratch, "sources", levels)
    root = top.roots.first()["h"]
    none = F.array().cast("array<string>")
    above = top.paths(top.roots.select("g", "i", F.lit("").alias("subroot"), none.alias("lefts"), none.alias("rights")))
    above = trees.roots.select("g", "i", F.col("h").alias("subroot")).join(above.select(F.col("i").alias("g"), "lefts", "rights"), "g").select("g", "i", "subroot", "lefts", "rights")
    return trees.proofs(above).withColumn("root", F.lit(root))


def tampered() -> Column:
    """The text without line feeds, for documents whose doc_id, as decimal text, has an even crc32."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, for the manifest's documents after tampering."""
    found = manifest(docs, tampered(), levels)
    return found.select("doc_id", "leaf", "subroot", "root", sha256(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
