"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Blocks of a source are jobs of one slot. With weight w, block k (from 0) is
released at floor(k / w) and due at ceil((k + 1) / w); every slot takes the
released block with the earliest deadline. Weights are whole parts of a
period, so the schedule repeats: it is worked out for one period, a table
whose size doesn't depend on the corpus, and each block finds its slot there.
At every slot each source has got its share to within less than one block,
until the first source runs out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh

#: Documents in a block, slots in a period at least, power of a source's share that is its default target.
BLOCK, PERIOD, POWER = 16, 1000, 0.5
#: Documents that one task ranks, and that one file of an arranged table holds, about.
BUCKET_ROWS, FILE_ROWS = 4096, 8192
#: Tasks that a table is dealt over at most; beyond that they get larger, and sort with spilling.
TASKS = 20_000


def natural_targets(counts: DataFrame, power: float = POWER) -> DataFrame:
    """source, weight: shares of documents, tempered by a power."""
    return counts.groupBy("source").agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("weight"))


def parts(targets: DataFrame, period: int = PERIOD) -> DataFrame:
    """One row: period, names and whole parts, by name; largest remainders, at least one part each.

    Where single parts for small sources overdraw the period, the others give
    in proportion to what they have above one. Parts sum to the period.

    Sources with a null or non-positive weight are left out. With over a
    quarter as many sources as slots, the period is four times their number.
    """
    good = targets.where(F.col("weight") > 0).agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("t")).where(F.size("t") > 0)
    good = good.select("t", F.greatest(F.lit(period), 4 * F.size("t")).alias("period"), F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x.weight).alias("total"))
    ideal = good.withColumn("floors", F.transform("t", lambda x: F.greatest(F.lit(1), F.floor(x.weight / F.col("total") * F.col("period")).cast("int"))))
    ideal = ideal.withColumn("left", F.col("period") - F.aggregate("floors", F.lit(0), lambda acc, x: acc + x))
    rest = F.transform("t", lambda x, i: F.struct((F.get("floors", i) - x.weight / F.col("total") * F.col("period")).alias("short"), i.alias("i")))
    ideal = ideal.withColumn("order", F.transform(F.array_sort(rest), lambda x: x.i)).withColumn("n", F.size("t"))
    # What is left over goes round by largest remainder. What single parts overdrew comes off the others in
    # proportion to their parts above one, again by largest remainder; the period is longer than n, so none falls below one.
    add = lambda acc, x: acc + x
    ideal = ideal.withColumn("over", F.greatest(F.lit(0), -F.col("left")).cast("long")).withColumn("spare", F.greatest(F.lit(1), F.aggregate("floors", F.lit(0), add) - F.col("n")).cast("long"))
    owed = lambda p: (p - 1) * F.col("over")
    ideal = ideal.withColumn("cuts", F.transform("floors", lambda p: F.floor(owed(p) / F.col("spare")).cast("int")))
    ideal = ideal.withColumn("uncut", F.col("over").cast("int") - F.aggregate("cuts", F.lit(0), add))
    ideal = ideal.withColumn("cut_order", F.transform(F.array_sort(F.transform("floors", lambda p, i: F.struct((-(owed(p) % F.col("spare"))).alias("short"), i.alias("i")))), lambda x: x.i))
    gain = lambda i: F.floor((F.col("left") - F.array_position("order", i) + F.col("n")) / F.col("n")).cast("int")
    loss = lambda i: F.get("cuts", i) + F.when(F.array_position("cut_order", i) <= F.col("uncut"), 1).otherwise(0)
    extra = F.transform("floors", lambda p, i: p + F.when(F.col("left") > 0, gain(i)).otherwise(-loss(i)))
    return ideal.select("period", F.transform("t", lambda x: x.source).alias("names"), extra.alias("parts"))


def schedule(row: DataFrame) -> DataFrame:
    """source, parts, period, turn, slot for every slot of one period."""

    def release(count: Column, part: Column) -> Column:
        return F.floor(count * F.col("period") / part)

    def due(count: Column, part: Column) -> Column:
        return F.ceil((count + 1) * F.col("period") / part)

    def step(acc: Column, t: Column) -> Column:
        ready = F.transform(
            acc.counts,
            lambda c, i: F.when((c < F.get("parts", i)) & (release(c, F.get("parts", i)) <= t), F.struct(due(c, F.get("parts", i)).alias("due"), i.alias("i"))),
        )
        first = F.array_min(ready)
        return F.struct(
            F.transform(acc.counts, lambda c, i: F.when(i == first.i, c + 1).otherwise(c)).alias("counts"),
            F.concat(acc.picks, F.array(first.i)).alias("picks"),
        )

    start = F.struct(F.transform("parts", lambda _: F.lit(0)).alias("counts"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.col("period") - 1), start, step, lambda acc: acc.picks)
    slots = row.select("period", "names", "parts", F.posexplode(picks).alias("slot", "i"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return slots.select(F.get("names", F.col("i")).alias("source"), F.get("parts", F.col("i")).alias("parts"), "period", turn.alias("turn"), "slot")


def mix(docs: DataFrame, targets: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, rank, block, slot, release, deadline, position and on_target.

    targets has source and weight; by default the sources' shares to the power
    POWER. Each source's documents are ranked by md5(doc_id), then doc_id, and
    cut into blocks. position orders the mixture; positions of a source that
    has run out stay empty. on_target holds where the slot comes before the
    first that no document fills, up to which the weights are kept to less
    than one block.

    Rows of one doc_id and source share a rank and a row, whose `copies` says
    how many they are. A null source counts as a source of its own, named ''.
    Sources that targets leaves out have null block, slot and position: they
    aren't in the mixture. A null doc_id ranks as ''. An empty table gives an
    empty result.

    Ranks within a source are worked out in buckets of md5, each of about
    bucket_rows rows of all sources; the number of rows a source has in
    earlier buckets comes from a table of counts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    buckets = max(1, min(TASKS, -(-rows.count() // bucket_rows)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", key)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")).repartition(buckets, "bucket")

    counts = rows.groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket", "source").orderBy("key", "doc_id")) - 1
    ranked = rows.withColumn("within", within).join(before, ["bucket", "source"]).withColumn("rank", F.col("before") + F.col("within"))

    plan = parts(targets if targets is not None else natural_targets(counts), period)
    table = schedule(plan)
    sizes = counts.groupBy("source").agg(F.sum("n").alias("n"))
    share = plan.select("period", F.explode(F.arrays_zip("names", "parts")).alias("s")).select(F.col("s.names").alias("source"), F.col("s.parts").alias("parts"), "period")
    # A source's first slot that it can't fill: that of the block after its last document.
    lacks = share.join(sizes, "source", "left").withColumn("next", F.floor(F.coalesce("n", F.lit(0)) / block))
    lacks = lacks.withColumn("turn", (F.col("next") % F.col("parts")).cast("int")).join(table.select("source", "turn", "slot"), ["source", "turn"])
    ends = lacks.agg(F.min(F.floor(F.col("next") / F.col("parts")) * F.col("period") + F.col("slot")).alias("ends"))

    shares = share.withColumnRenamed("source", "s")
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block)).join(shares, F.col("source") == F.col("s"), "left").drop("s")
    placed = placed.withColumn("turn", (F.col("block") % F.col("parts")).cast("int"))
    placed = placed.join(table.select("source", "turn", F.col("slot").alias("in_period")), ["source", "turn"], "left").join(ends)  # ends is one row
    slot = F.floor(F.col("block") / F.col("parts")) * F.col("period") + F.col("in_period")
    return placed.select(
        "doc_id",
        "source",
        "copies",
        "rank",
        F.when(F.col("parts").isNotNull(), F.col("block")).alias("block"),
        slot.alias("slot"),
        F.floor(F.col("block") * F.col("period") / F.col("parts")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("period") / F.col("parts")).alias("deadline"),
        (slot * block + F.col("rank") % block).alias("position"),
        (slot < F.col("ends")).alias("on_target"),
    )


def arrange(docs: DataFrame, targets: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """docs in the order of the mixture, over files and within; rows of left-out sources go.

    Every column stays as it is, whatever its name. Rows of one doc_id and
    source stay together. Null ids and sources have their place as in mix. An
    empty table gives an empty result.
    """
    mixed = mix(docs, targets, block).where("position is not null")
    place, source, id_ = fresh(docs, "mix_position"), fresh(docs, "mix_source"), fresh(docs, "mix_id")
    places = mixed.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("position").alias(place))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(source))
    files = max(1, min(TASKS, -(-docs.count() // FILE_ROWS)))
    return docs.join(places, same).repartitionByRange(files, place).sortWithinPartitions(place).select(*docs.columns)
