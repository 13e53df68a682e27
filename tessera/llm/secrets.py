"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong patterns stand by themselves. Weak candidates (access identifiers,
random-looking secrets, endpoints) are reported only where complementary parts
lie in one scope: an interval join pairs each weak secret with identifiers and
endpoints of the same document at most SCOPE code points away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Code points between parts of one credential.
SCOPE = 200
# The strong kinds in their order, their patterns (Java), and the lengths that a match needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ["assign", "access", "hex"]
# Weak kinds.
IDENTIFIER = r"""(?i:access_?key_?id|client_?id|user_?name|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]+"""
SECRET = r"(?<![A-Za-z0-9+/_=.-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]+"""
WEAK = ["identifier", "secret", "endpoint"]

_BLOCK = 256


def spans(text: Column, pattern: str, kind: int, least: int = 1, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end>>, in code points.

    Matches whose group is shorter than `least` are dropped after matching.
    The text between matches and the matches themselves give the places: sums
    of lengths, block by block so that many matches don't cost their square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    lengths = F.transform(found, F.char_length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), lengths, lambda gap, length: gap + length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else lengths
    parts = F.struct(steps.alias("steps"), lengths.alias("lengths"), sizes.alias("sizes"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)

    def placed(p: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(p.steps) - 1) / _BLOCK).cast("int")),
            lambda b: total(F.slice(p.steps, b * _BLOCK + 1, F.lit(_BLOCK))),
        )

        def place(bs: Column) -> Column:
            def one(length: Column, i: Column) -> Column:
                b = F.floor(i / _BLOCK).cast("int")
                end = total(F.slice(bs, F.lit(1), b)) + total(F.slice(p.steps, b * _BLOCK + 1, i - b * _BLOCK + 1))
                return F.struct((end - length).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (F.get(p.sizes, i) >= least).alias("good"))

            good = F.filter(F.transform(p.lengths, one), lambda x: x.good)
            return F.transform(good, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))

        return F.flatten(F.transform(F.array(blocks), place))

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(parts), placed))).otherwise(none)


def written(found: Column, kinds: list[str]) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with its secrets.

    doc_id, n_assign, n_access, n_hex, base_sha256 (over the strong spans),
    spans (strong and linked spans, as kind:start:end), and secrets, the same
    as array<struct<start, kind, end>>; and the columns of `keep`, named
    in_<column>. Order: start, then kind as listed. A null text counts as
    empty and has no spans. Repeated or null ids give a row each time.

    What each row has is written to the shared folder first; the interval join
    then moves weak candidates only, keyed by row and scope, so a long text's
    candidates are dealt out by scope.
    """

    def cells(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope))).alias("cell")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"in_{c}") for c in keep or []]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *kept,
        F.array_sort(F.concat(spans(text, ASSIGN, 0, 8, 2), spans(text, ACCESS, 1, 16), spans(text, "(?<![0-9a-f])[0-9a-f]{32,}", 2))).alias("strong"),
        F.when(text.rlike(SECRET), F.concat(spans(text, IDENTIFIER, 3), spans(text, SECRET, 4), spans(text, ENDPOINT, 5))).alias("weak"),
    )
    rows = Scratch(docs.sparkSession, "secrets").keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    weak = rows.where(F.size("weak") > 1).select("row", F.explode("weak").alias("w")).select("row", "w")
    strong = rows.where(F.size("weak") > 0).select("row", F.explode(F.filter("strong", lambda x: x.kind == 1)).alias("w"))
    parts = weak.where("w.kind != 4").unionByName(strong)
    near = parts.select("row", F.col("w").alias("part"), cells(F.col("w.start") - scope, F.col("w.end") + scope))
    secrets = rows.where(F.size("weak") > 0).select("row", F.explode(F.filter("weak", lambda x: x.kind == 4)).alias("w"))
    linked = secrets.select("row", "w", cells(F.col("w.start"), F.col("w.end"))).join(near, ["row", "cell"])
    linked = linked.where(F.col("cell") == F.floor(F.greatest(F.col("w.start"), F.col("part.start") - scope) / scope))  # the first cell that both are in
    linked = linked.where((F.col("w.start") - F.col("part.end") <= scope) & (F.col("part.start") - F.col("w.end") <= scope) & ~((F.col("w.start") < F.col("part.end")) & (F.col("part.start") < F.col("w.end"))))
    linked = linked.select("row", F.explode(F.array("w", F.when(F.col("part.kind") != 1, F.col("part")))).alias("w")).where("w is not null")
    linked = linked.groupBy("row").agg(F.collect_set("w").alias("more"))

    found = rows.join(linked, "row", "left").withColumn("secrets", F.array_sort(F.concat("strong", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))))
    count = lambda k: F.size(F.filter("strong", lambda x: x.kind == k)).cast("long").alias(f"n_{BASE[k]}")
    return found.select("doc_id", *[count(k) for k in range(3)], F.sha2(written(F.col("strong"), BASE), 256).alias("base_sha256"), written(F.col("secrets"), BASE + WEAK).alias("spans"), "secrets", *[f"in_{c}" for c in keep or []])


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with each run of overlapping secrets replaced by the mark, and n_chars, if there, counted anew.

    No row goes and other columns stay as they are; a null text stays null.
    """
    found = scan(docs, scope, keep=docs.columns)
    text = F.col("in_text")

    def put(acc: Column, x: Column) -> Column:
        fresh = x.start >= acc.at
        out = F.when(fresh, F.concat(acc.out, F.substring(text, acc.at + 1, x.start - acc.at), F.lit(mark))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, x.end).alias("at"), out.alias("out"))

    done = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.char_length(text))))
    clean = F.when(F.size("secrets") > 0, done).otherwise(text)
    kind = dict(docs.dtypes)

    def column(c: str) -> Column:
        if c == "text":
            return clean.alias(c)
        if c == "n_chars":
            return F.when(F.size("secrets") > 0, F.char_length(clean).cast(kind[c])).otherwise(F.col(f"in_{c}")).alias(c)
        return F.col(f"in_{c}").alias(c)

    return found.select(*[column(c) for c in docs.columns])
