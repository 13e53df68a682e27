"""Language-model scoring with a log-frequency Bloom filter.

The filter holds, for words and word pairs, quantised counts: an item of level
q is entered q times, once with each of 1..q. A probe asks for 1, 2, ... until
one is missing, which gives the level back, never too low. Entries are made in
shards, each the owner of a part of the filter; the parts are put together
and broadcast. Probabilities of word pairs are Witten-Bell smoothed: what a
word is followed by, how often and by how many different words, all come from
probes.

The filter's size follows the number of entries, part by part, up to FILTER_MB
a pass; a corpus that needs more gets several passes by first word, which score
the texts one after another and never stand in memory together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, Tokens, fold, join_hash, mix, slices

#: Most MB of pair counts broadcast at once; bits for an entry and hashes of it; least shards; registers that estimate the number of pairs.
FILTER_MB, ENTRY_BITS, HASHES, SHARDS, REGISTER_BITS = 192, 8, 4, 8, 14
#: Text bytes for a shard of words and for a shard of pairs (what a task merges stays the same as the corpus grows); most tasks of a shuffle.
WORD_BYTES, PAIR_BYTES, TASKS = 16 << 20, 8 << 20, 20_000
#: A word that makes up over one part in COMMON of the tokens stays with its texts: its count comes to them. At most COMMON words.
COMMON = 20_000
#: Bytes of a line: all bits of an item and level are in one, so that a probe waits for memory once.
LINE = 64
#: Items whose levels a worker remembers for a filter, at most; a power of two.
KEPT = 1 << 19
#: Keys that probe a filter at once.
PROBES = 1 << 15
#: Ratios of successive levels: for counts of words and of what follows them, and for pairs. Levels of a pair on average, for sizing.
FINE, COARSE, PAIR_LEVELS = 1.25, 1.5, 1.7
#: A word is dealt over all shards by what follows it if it makes up over one part in HOT of the training tokens: at most HOT words.
HOT = 500
#: A pass whose pairs take over FILTER_MB is split in two, again and again until there are SPLITS for one (a single word can't be split).
SPLITS = 16
#: The hashes of the start and end of a text.
START, END = np.uint64(0x5157A27), np.uint64(0xE4D)
_WORD, _TOTAL, _KINDS, _PAIR = (np.uint64(k << 32) for k in (1, 2, 3, 4))


def levels(ratio: float, top: int = 1 << 40) -> np.ndarray:
    """The least count of each level: 1, 2, 3, ... and then in about the ratio."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


_FINE, _COARSE = levels(FINE), levels(COARSE)


@dataclass
class Filter:
    """A Bloom filter in parts, each of its own size; an item's part is given with it."""

    flat: np.ndarray  # the bytes of all parts, one after another
    at: np.ndarray  # where each part begins, with the end of the last

    @staticmethod
    def empty(parts: int, size: int | np.ndarray) -> Filter:
        at = np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.broadcast_to(size, parts) // LINE)) * LINE)])
        return Filter(np.zeros(at[-1], np.uint8), at)

    @staticmethod
    def joined(parts: list[np.ndarray | None]) -> Filter:
        """One filter of parts that were made on their own; a missing one holds nothing."""
        parts = [np.zeros(LINE, np.uint8) if x is None else x for x in parts]
        return Filter(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))

    @property
    def bits(self) -> list[np.ndarray]:
        return [self.flat[lo:hi] for lo, hi in zip(self.at[:-1], self.at[1:], strict=True)]

    def base(self, key: np.ndarray, level: int | np.ndarray) -> np.ndarray:
        return join_hash(key, np.uint64(level) if isinstance(level, int) else level.astype(np.uint64))

    def line(self, base: np.ndarray, lines: np.ndarray | np.uint64) -> np.ndarray:
        """The line of items within their part of so many: the base's lower half, scaled."""
        return ((base & np.uint64(0xFFFFFFFF)) * lines) >> np.uint64(32)

    def bit(self, base: np.ndarray, k: int) -> np.ndarray:
        """The k-th bit of items within their line, by two numbers of the base's upper half."""
        return ((base >> np.uint64(32)) + np.uint64(k) * ((base >> np.uint64(41)) | np.uint64(1))) & np.uint64(8 * LINE - 1)

    def enter(self, part: int, key: np.ndarray, level: np.ndarray) -> None:
        """Adds every key with each of 1..level."""
        deep, n = np.repeat(key, level), np.cumsum(level)
        base = self.base(deep, np.arange(len(deep)) - np.repeat(n - level, level) + 1)
        lo, hi = self.at[part], self.at[part + 1]
        on = np.zeros(8 * (hi - lo), bool)
        first = self.line(base, np.uint64((hi - lo) // LINE)) * np.uint64(8 * LINE)
        for k in range(HASHES):
            on[first + self.bit(base, k)] = True
        self.flat[lo:hi] |= np.packbits(on, bitorder="little")

    def level(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        """How far the probes of each key get. A bit is asked of those only that had all before.

        Keys go PROBES at a time and part by part, so that both they and the bits asked for stay in cache.
        """
        found = np.zeros(len(key), np.int64)
        starts, lines = self.at[:-1].astype(np.uint64), (np.diff(self.at) // LINE).astype(np.uint64)
        order = np.argsort(part.astype(np.uint16) if len(lines) <= 1 << 16 else part, kind="stable")  # short ones are sorted by radix
        for lo in range(0, len(key), PROBES):
            alive, level = order[lo : lo + PROBES], 0
            item, own = key[alive], part[alive]
            start, width = starts[own], lines[own]
            while len(alive):
                level += 1
                base = self.base(item, level)
                first, at = start + self.line(base, width) * np.uint64(LINE), None
                for k in range(HASHES):
                    bit = self.bit(base, k)
                    hit = np.flatnonzero((self.flat[(first + (bit >> np.uint64(3))).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    at, base, first = hit if at is None else at[hit], base[hit], first[hit]
                alive, item, start, width = alive[at], item[at], start[at], width[at]
                found[alive] = level
        return found


    def recalled(self, part: np.ndarray, key: np.ndarray) -> np.ndarray:
        """What level gives, remembering items of several levels: frequent ones come in every run of texts and are asked for most often."""
        if not hasattr(self, "names"):
            self.names, self.known = np.zeros(KEPT, np.uint64), np.zeros(KEPT, np.uint8)
        name = key + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot = (name & np.uint64(KEPT - 1)).view(np.int64)
        found = np.where(self.names[slot] == name, self.known[slot], 0).astype(np.int64)
        new = np.flatnonzero(found == 0)
        found[new] = self.level(part[new], key[new])
        several = new[found[new] > 1]
        several = several[found[several] >= self.known[slot[several]]]
        several = several[np.argsort(found[several].astype(np.uint8), kind="stable")]  # of several for a slot the highest is written last
        self.names[slot[several]], self.known[slot[several]] = name[several], found[several]
        return found


def quantised(count: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The level of each count: the number of levels that start at or below it."""
    return np.searchsorted(table, count, side="right")


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key) % np.uint64(shards)).astype(np.int64)


@dataclass
class Words:
    """The tokens of a run of texts: each text's words and one end."""

    texts: pa.Array
    hashes: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        tokens = Tokens(self.texts)
        known = tokens.hashes()
        n = len(self.texts)
        self.at = tokens.at + np.arange(n + 1)
        self.ids = np.full(self.at[-1], len(known), np.int64)
        inner = np.ones(self.at[-1], bool)
        inner[self.at[1:] - 1] = False
        self.ids[inner] = tokens.ids
        self.hashes = np.append(known, END)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.at))

    def before(self) -> np.ndarray:
        """For each token the place in hashes of the one before; the start of a text is one past the last."""
        out = np.concatenate([[0], self.ids[:-1]])
        out[self.at[:-1]] = len(self.hashes)
        return out


def rows_of(docs: DataFrame) -> DataFrame:
    """Rows with their text's hash; held_out is whether the id's fold is 1; rows without id aren't learnt from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("name"), F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), (F.coalesce(fold() != 1, F.lit(False))).alias("learnt"))


def split_by(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its rows."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def survey(rows: DataFrame, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Hashes of common words and of the end; and about how many distinct pairs the training texts hold. One pass over the texts.

    Common are words that make up over one part in COMMON of all tokens. A run
    of texts reports those of over half that share of its own tokens; so what
    is missed of a word's count is less than half the bound. Pairs are
    estimated by a register each for many hash ranges (about 1 % off).
    """
    m = 1 << REGISTER_BITS
    word_, total_, register_ = 0, 1, 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(m, np.int64)
        for part in slices(batches):
            words = Words(part.column("text"))
            count = np.bincount(words.ids, minlength=len(words.hashes))
            at = np.flatnonzero(count * 2 * COMMON > len(words.ids))
            yield batch(np.full(len(at), word_), words.hashes[at].view(np.int64), count[at])
            yield batch(np.array([total_]), np.array([0]), np.array([len(words.ids)]))
            learnt = np.repeat(part.column("learnt").to_numpy(zero_copy_only=False), np.diff(words.at))
            h = np.append(words.hashes, START)
            pair = join_hash(h[words.before()[learnt]], h[words.ids[learnt]])
            zeros = 64 - REGISTER_BITS - np.floor(np.log2(np.maximum((pair & np.uint64((1 << (64 - REGISTER_BITS)) - 1)).astype(float), 0.5))).astype(np.int64)
            np.maximum.at(best, (pair >> np.uint64(64 - REGISTER_BITS)).astype(np.int64), zeros)
        at = np.flatnonzero(best)
        yield batch(np.full(len(at), register_), at, best[at])

    def batch(kind: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    found = scratch.keep(rows.select("text", "learnt").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("n").alias("most")), "survey")
    totals = F.broadcast(found.where(F.col("kind") == total_).select(F.col("n").alias("tokens")))  # one row
    kept = found.where(F.col("kind") != total_).crossJoin(totals).where((F.col("kind") == register_) | (F.col("n") * COMMON > F.col("tokens"))).select("kind", "key", "most").toArrow()  # COMMON words and m registers at most
    kind, key, most = (kept[c].to_numpy().astype(np.int64) for c in ("kind", "key", "most"))
    common = np.unique(np.append(key[kind == word_].view(np.uint64), END))
    zeros = most[kind == register_].astype(float)
    if len(zeros) < 0.9 * m:  # few pairs: by the empty registers
        return common, math.ceil(-m * math.log(1 - len(zeros) / m))
    return common, math.ceil(0.7213 / (1 + 1.079 / m) * m * m / ((2.0**-zeros).sum() + (m - len(zeros))))


#: Rows of the word counts: words of a shard, or a run of texts (shard -1).
COUNTED = "shard int, slice long, parts array<binary>"
#: Per text, and per text and word.
_TEXT = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("name", "<i8"), ("n", "<i8")])
_POSTING = np.dtype([("word", "<u2"), ("doc", "<u2"), ("tf", "<u2")])
_SUM = np.dtype([("doc", "<u2"), ("score", "<f8"), ("known", "<u4")])


def count_words(rows: DataFrame, shards: int, common: np.ndarray) -> DataFrame:
    """Per run of texts and shard: words with training counts and where they stand; per run: its texts, and where common words stand.

    Common words reach their shards with counts only, so no shard holds a
    posting for nearly every text.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        first_slice = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for number, part in enumerate(slices(batches)):
            words = Words(part.column("text"))
            learnt = part.column("learnt").to_numpy(zero_copy_only=False)
            key = words.ids * len(learnt) + words.doc
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tf = np.diff(np.append(first, len(key)))
            word, doc = np.divmod(key[first], len(learnt))
            times = -(-tf // 65535)  # a larger number is written in several records
            word, doc, tf = np.repeat(word, times), np.repeat(doc, times), np.minimum(np.repeat(tf, times), 65535)
            trained = np.bincount(word, np.where(learnt[doc], tf, 0), len(words.hashes)).astype(np.int64)
            starts = np.searchsorted(word, np.arange(len(words.hashes) + 1))
            place = np.minimum(np.searchsorted(often, words.hashes), len(often) - 1)
            is_common = often[place] == words.hashes
            posted = is_common[word]
            texts, postings = np.zeros(part.num_rows, _TEXT), np.zeros(int(posted.sum()), _POSTING)
            texts["doc_id"], texts["no_id"] = pc.fill_null(part.column("doc_id"), 0).to_numpy(), part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            texts["name"], texts["n"] = part.column("name").to_numpy(), np.diff(words.at)
            postings["word"], postings["doc"], postings["tf"] = place[word[posted]], doc[posted], tf[posted]
            out = [(-1, [texts.tobytes(), postings.tobytes()])]
            sizes = np.where(is_common, 0, np.diff(starts))
            for s, at in split_by(shard_of(words.hashes, shards), shards):
                size = sizes[at]
                of = np.repeat(starts[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out.append((s, [x.tobytes() for x in (words.hashes[at], trained[at].astype(np.uint32), size.astype(np.uint16), doc[of].astype(np.uint16), tf[of].astype(np.uint16))]))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([first_slice + number] * len(out), pa.int64()), pa.array([x for _, x in out], pa.list_(pa.binary()))], ["shard", "slice", "parts"])

    return rows.select("doc_id", "name", "text", "learnt").mapInArrow(emit, COUNTED)


#: What a shard of words gives: its totals and filter, its common words' counts, and sums for runs of texts (kind: shard, common, slice, text).
MERGED = "kind string, slice long, word long, count long, kinds long, rounded long, parts array<binary>"


def merge_words(counted: DataFrame, shards: int, common: np.ndarray, scratch: Scratch) -> DataFrame:
    """Exact counts by shard: sums for each text, totals, common words, and the shard's part of the word filter."""
    shared = counted.sparkSession.sparkContext.broadcast(common)
    names = [x.split()[0] for x in MERGED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[bytes]]] = []
        now = None
        for b in batches:
            for s, i, x in zip(b.column("shard").to_pylist(), b.column("slice").to_pylist(), b.column("parts").to_pylist(), strict=True):
                if s < 0:
                    yield batch([("text", i, 0, 0, 0, 0, x)])
                    continue
                if s != now and held:
                    yield finish(now, held)
                    held = []
                now = s
                held.append((i, x))
        if held:
            yield finish(now, held)

    def finish(shard: int, held: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
        parts = [[np.frombuffer(x, t) for x, t in zip(w, (np.uint64, np.uint32, np.uint16, np.uint16, np.uint16), strict=True)] for _, w in held]
        distinct, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.bincount(which, np.concatenate([p[1] for p in parts]).astype(float), len(distinct)).astype(np.int64)
        out, lo = [], 0
        for (words, _, size, doc, tf), (i, _) in zip(parts, held, strict=True):
            c = np.repeat(count[which[lo : lo + len(words)]], size)
            lo += len(words)
            sums = text_sums(doc, tf, c)
            if len(sums):
                out.append(("slice", i, 0, 0, 0, 0, [sums.tobytes()]))
        seen = count > 0
        level = quantised(count[seen], _FINE)
        part = Filter.empty(1, int(level.sum()) * ENTRY_BITS // 8)
        part.enter(0, distinct[seen] ^ _WORD, level)
        out.append(("shard", shard, 0, int(count.sum()), int(seen.sum()), int(_FINE[level - 1].sum()), [part.flat.tobytes()]))
        for k in np.flatnonzero(np.isin(distinct, shared.value)):
            out.append(("common", 0, int(distinct[k].view(np.int64)), int(count[k]), 0, 0, None))
        return batch(out)

    moved = counted.repartitionById(min(shards, TASKS), F.when(F.col("shard") < 0, F.pmod(F.xxhash64("slice"), F.lit(shards)).cast("int")).otherwise(F.col("shard"))).sortWithinPartitions("shard")
    return scratch.keep(moved.mapInArrow(merge, MERGED), "words")


def text_sums(doc: np.ndarray, tf: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums over a run of texts' postings of words with their counts."""
    n = int(doc.max()) + 1 if len(doc) else 0
    at = np.flatnonzero(np.bincount(doc, minlength=n))
    out = np.zeros(len(at), _SUM)
    out["doc"], out["score"], out["known"] = at, np.bincount(doc, tf * np.log10(count + 0.5), n)[at], np.bincount(doc, tf * (count > 0), n)[at]
    return out


def base_scores(merged: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """base_id, base_name, logs, n, known of every text (one row for equal rows): sums over its tokens."""
    shared = merged.sparkSession.sparkContext.broadcast(counts)
    schema = "base_id long, base_name long, logs double, n long, known long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for i, k, x in zip(b.column("slice").to_pylist(), b.column("kind").to_pylist(), b.column("parts").to_pylist(), strict=True):
                if i != now and held:
                    yield whole(held)
                    held = []
                now = i
                held.append((k, x))
        if held:
            yield whole(held)

    def whole(held: list[tuple[str, list[bytes]]]) -> pa.RecordBatch:
        texts, postings = next((np.frombuffer(x[0], _TEXT), np.frombuffer(x[1], _POSTING)) for k, x in held if k == "text")
        sums = np.concatenate([np.frombuffer(x[0], _SUM) for k, x in held if k == "slice"] + [text_sums(postings["doc"], postings["tf"], shared.value[postings["word"]])])
        n = len(texts)
        columns = [pa.array(texts["doc_id"], mask=texts["no_id"] > 0), pa.array(texts["name"]), pa.array(np.bincount(sums["doc"], sums["score"], n)), pa.array(texts["n"]), pa.array(np.bincount(sums["doc"], sums["known"], n).astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    by_slice = merged.where("kind in ('text', 'slice')").select("slice", "kind", "parts").repartition("slice").sortWithinPartitions("slice")
    return by_slice.mapInArrow(run, schema).dropDuplicates(["base_id", "base_name"])


@dataclass
class Model:
    """What workers need to score texts."""

    tokens: int  # training tokens
    kinds: int  # distinct ones
    rounded: int  # training tokens, with counts as the filter gives them back
    word_parts: InitVar[list[np.ndarray | None]]
    hot: np.ndarray
    shards: int  # of pairs
    pairs: Filter | None = None
    words: Filter = field(init=False)

    def __post_init__(self, word_parts: list[np.ndarray | None]) -> None:
        self.words = Filter.joined(word_parts or [None])

    def word_counts(self, hashes: np.ndarray) -> np.ndarray:
        """By one round of probes for all parts: their number grows with the corpus."""
        level = self.words.recalled(shard_of(hashes, len(self.words.at) - 1), hashes ^ _WORD)
        return np.where(level > 0, _FINE[level - 1], 0)

    def part(self, first: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The shard of pairs: by their first word, or if that is frequent by both."""
        return shard_of(np.where(np.isin(first, self.hot), pair, first), self.shards)


def count_pairs(rows: DataFrame, model: Model, passes: int, this: int, scratch: Scratch, most: int | None = None) -> Filter | None:
    """The filter of pairs whose first word belongs to pass `this`, or None if that takes over `most` bytes.

    A part's size follows the entries that it gets: a word that isn't frequent
    has all its pairs in one part, however many shards there are.
    """
    context = rows.sparkSession.sparkContext
    hot, shards = context.broadcast(model.hot), model.shards
    # Entries of the frequent words' totals, which come last, at most.
    room = np.bincount(shard_of(model.hot, shards), minlength=shards) * 2 * len(_FINE)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = Model(0, 0, 0, [], hot.value, shards)
        for part in slices(batches):
            words = Words(part.column("text"))
            h = np.append(words.hashes, START)
            key = words.before() * len(h) + words.ids
            key.sort()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(at, len(key)))
            a, b = np.divmod(key[at], len(h))
            if passes > 1:
                mine = pass_of(h[a], passes) == this
                a, b, count = a[mine], b[mine], count[mine]
            times = -(-count // 255)
            a, b, count = np.repeat(a, times), np.repeat(b, times), np.minimum(np.repeat(count, times), 255)
            first, pair = h[a], join_hash(h[a], h[b])
            out = []
            for s, i in split_by(dealt.part(first, pair), shards):
                i = i[np.argsort(a[i], kind="stable")]
                new = np.flatnonzero(np.concatenate([[True], a[i][1:] != a[i][:-1]]))
                runs = np.diff(np.append(new, len(i))).astype(np.uint32)
                out.append((s, [first[i][new].tobytes(), runs.tobytes(), (pair[i] >> np.uint64(32)).astype(np.uint32).tobytes(), (pair[i] >> np.uint64(24)).astype(np.uint8).tobytes(), count[i].astype(np.uint8).tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.binary()))], ["shard", "pairs"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = []
        now = None
        for b in batches:
            for s, x in zip(b.column("shard").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                if s != now and held:
                    yield finish(now, held)
                    held = []
                now = s
                held.append(x)
        if held:
            yield finish(now, held)

    def finish(shard: int, held: list[list[bytes]]) -> pa.RecordBatch:
        first, runs, high, low, count = (np.concatenate([np.frombuffer(x[k], t) for x in held]) for k, t in enumerate((np.uint64, np.uint32, np.uint32, np.uint8, np.uint8)))
        held.clear()
        words, which = np.unique(first, return_inverse=True)
        key = high.astype(np.uint64) << np.uint64(8) | low  # 40 bits of the pair
        word = np.repeat(which, runs)
        order = np.lexsort((key, word))
        word, key, count = word[order], key[order], count[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (key[1:] != key[:-1])]))
        total, word, key = np.add.reduceat(count, at), word[at], key[at]
        level = quantised(total, _COARSE)
        after = np.bincount(word, _COARSE[level - 1].astype(float), len(words)).astype(np.int64)
        kinds = np.bincount(word, minlength=len(words))
        cold = ~np.isin(words, hot.value)
        entries = level.sum() + quantised(after[cold], _FINE).sum() + quantised(kinds[cold], _FINE).sum() + room[shard]
        part = Filter.empty(1, int(entries) * ENTRY_BITS // 8)
        part.enter(0, join_hash(words[word], key) ^ _PAIR, level)
        enter_totals(part, 0, words[cold], after[cold], kinds[cold])
        rows = [[-1 - shard, *words[~cold].view(np.int64).tolist()], [len(part.flat), *after[~cold].tolist()], [0, *kinds[~cold].tolist()]]
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in rows], pa.array([part.flat.tobytes()] + [None] * int((~cold).sum()), pa.binary()), pa.array([True] + [False] * int((~cold).sum()))], ["word", "after", "kinds", "filter", "part"])

    learnt = rows.where("learnt").select("text").mapInArrow(emit, "shard int, pairs array<binary>").repartitionById(min(shards, TASKS), "shard").sortWithinPartitions("shard")
    found = scratch.keep(learnt.mapInArrow(merge, "word long, after long, kinds long, filter binary, part boolean"), f"pairs{passes}-{this}")
    sizes = room * ENTRY_BITS // 8
    for row in found.where("part").select("word", "after").toLocalIterator():  # a row a shard
        sizes[-1 - row["word"]] = row["after"]
    if most is not None and sizes.sum() > most:
        scratch.drop(f"pairs{passes}-{this}")
        return None
    out = Filter.empty(shards, sizes)
    for row in found.where("part").select("word", "filter").toLocalIterator():  # a row a shard, of FILTER_MB together
        s = -1 - row["word"]
        out.flat[out.at[s] : out.at[s + 1]] = np.frombuffer(row["filter"], np.uint8)
    frequent = found.where("not part").groupBy("word").agg(F.sum("after").alias("after"), F.sum("kinds").alias("kinds")).toArrow()  # at most HOT rows
    if frequent.num_rows:
        words, after, kinds = (frequent[c].to_numpy().astype(np.int64) for c in ("word", "after", "kinds"))
        words = words.view(np.uint64)
        for s, at in split_by(shard_of(words, shards), shards):
            enter_totals(out, s, words[at], after[at], kinds[at])
    scratch.drop(f"pairs{passes}-{this}")
    return out


def enter_totals(to: Filter, part: int, words: np.ndarray, after: np.ndarray, kinds: np.ndarray) -> None:
    to.enter(part, words ^ _TOTAL, quantised(after, _FINE))
    to.enter(part, words ^ _KINDS, quantised(kinds, _FINE))


def pass_of(first: np.ndarray, passes: int) -> np.ndarray:
    return (mix(first ^ np.uint64(0xABCDEF)) % np.uint64(passes)).astype(np.int64)


def used(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n places occur, in order, and the number of each among them."""
    there = np.zeros(n, bool)
    there[places] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[places]


def log_scores(words: Words, model: Model, passes: int, this: int) -> np.ndarray:
    """The log10 probability of each text, or of its tokens whose first word belongs to pass `this`."""
    h = np.append(words.hashes, START)
    before, ids = words.before(), words.ids
    mine = slice(None) if passes == 1 else np.flatnonzero((pass_of(h, passes) == this)[before])
    key, which = np.unique(before[mine] * len(h) + ids[mine], return_inverse=True)
    a, b = np.divmod(key, len(h))
    (first, a), (second, b) = used(a, len(h)), used(b, len(h))  # only words that this pass needs are probed
    unit = (model.word_counts(h[second]) + 0.5) / (model.rounded + 0.5 * (model.kinds + 1))
    h1, h2 = h[first], h[second]
    home = shard_of(h1, model.shards)
    totals, kinds = (model.pairs.recalled(home, h1 ^ k) for k in (_TOTAL, _KINDS))
    total = np.where(totals > 0, _FINE[np.minimum(totals, len(_FINE) - 1)] - 1, 0)  # no less than what was counted
    kind = np.where(totals > 0, np.maximum(_FINE[np.maximum(kinds, 1) - 1], 1), 0)
    pair = join_hash(h1[a], h2[b])
    seen = np.flatnonzero(total[a] > 0)
    level = np.zeros(len(key), np.int64)
    level[seen] = model.pairs.recalled(model.part(h1[a[seen]], pair[seen]), join_hash(h1[a[seen]], pair[seen] >> np.uint64(24)) ^ _PAIR)
    count = np.minimum(np.where(level > 0, _COARSE[level - 1], 0), total[a])
    p = np.where(total[a] > 0, (count + kind[a] * unit[b]) / np.maximum(total[a] + kind[a], 1), unit[b])
    logs = np.zeros(len(ids))
    logs[mine] = np.log10(p)[which]
    return np.add.reduceat(logs, words.at[:-1]) if len(words.texts) else np.zeros(0)


def score(docs: DataFrame, filter_mb: int = FILTER_MB) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Tokens are words (A-Z lower-cased, split at ASCII white space) and one end
    a text. Texts are learnt from unless the fold of their id is 1.
    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens with
    exact counts; n_known counts tokens with c > 0; score is the pair model's
    log10 probability, lower than the true model's by rounding of counts only.

    A null text counts as empty: one token, the end. A row without doc_id is
    scored but not learnt from, and not held out. Repeated rows are learnt
    from and returned each. Other columns are not read. With nothing to learn
    from, N and V are 0 and all tokens are unknown. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    rows = rows_of(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards, pair_shards = max(SHARDS, size // WORD_BYTES), max(SHARDS, size // PAIR_BYTES)
    common, distinct = survey(rows, scratch)
    merged = merge_words(count_words(rows, word_shards, common), word_shards, common, scratch)
    shards = merged.where("kind = 'shard'").select("slice", "count", "kinds", "rounded", F.col("parts")[0].alias("filter")).toLocalIterator()  # a row a shard
    totals, parts = np.zeros(3, np.int64), [None] * word_shards
    for row in shards:
        totals += row["count"], row["kinds"], row["rounded"]
        parts[row["slice"]] = np.frombuffer(row["filter"], np.uint8)
    model = Model(*totals.tolist(), parts, np.zeros(0, np.uint64), pair_shards)
    del parts
    known = merged.where("kind = 'common'").select("word", "count").toArrow()  # at most COMMON rows
    words, count = known["word"].to_numpy().astype(np.int64).view(np.uint64), known["count"].to_numpy().astype(np.int64)
    counts = np.zeros(len(common), np.int64)
    counts[np.searchsorted(common, words)] = count
    model.hot = np.sort(np.append(words[count * HOT > model.tokens], START))

    entries = distinct * PAIR_LEVELS * 1.1 + 12 * model.kinds
    needed = int(entries * ENTRY_BITS / 8)
    passes = max(1, -(-needed // (filter_mb << 20)))
    scores, done, ahead, finest = None, 0, [(passes, this) for this in range(passes)], passes * SPLITS
    while ahead:
        of, this = ahead.pop(0)
        model.pairs = count_pairs(rows, model, of, this, scratch, filter_mb << 20 if of < finest else None)
        if model.pairs is None:  # more than was estimated: what the hash leaves modulo 2 * of is this or of + this
            ahead = [(2 * of, this), (2 * of, of + this), *ahead]
            continue
        found, done = score_pass(rows, model, of, this), done + 1
        if of > 1:
            found = scratch.keep(found, f"scores{of}-{this}")
        scores = found if scores is None else scores.unionByName(found)
    if done > 1:
        scores = scores.groupBy("doc_id", "name", "held_out").agg((F.sum("score") / F.count(F.lit(1)) * done).alias("score"), (F.count(F.lit(1)) / done).cast("int").alias("k")).withColumn("k", F.explode(F.sequence(F.lit(1), "k"))).drop("k")

    base = base_scores(merged, common, counts)
    both = scores.join(base, (F.col("name") == F.col("base_name")) & F.col("doc_id").eqNullSafe(F.col("base_id")))
    norm = math.log10(model.tokens + 0.5 * (model.kinds + 1))
    return both.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * norm).alias("base_score"),
        "score",
    )


def score_pass(rows: DataFrame, model: Model, passes: int, this: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches):
            logs = log_scores(Words(part.column("text")), m, passes, this)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("name"), part.column("held_out"), pa.array(logs)], ["doc_id", "name", "held_out", "score"])

    return rows.select("doc_id", "name", "held_out", "text").mapInArrow(run, "doc_id long, name long, held_out boolean, score double")
