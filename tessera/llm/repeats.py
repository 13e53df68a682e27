"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through the first LENGTH bytes only, most significant
digit first; groups that are still together at that depth are exactly the
repeated windows. The digits are taken around an anchor: the window's least
hashed GRAM-byte string, which equal windows share. So the first digit is the
anchor string, and neighbouring windows with one anchor go through the early
passes as one run.

Pass 1 deals the runs out by anchor string and orders them by anchor, then by
all bytes of the run together: what a run shares with an earlier document's
whole run is settled. Runs that differ leave the sort unless they share HALF
bytes beside the anchor, as they must to share a window. Pass 2 orders the
single windows of those that stay, by their bytes, eight at a time, dropping
groups of one after each digit.

Every text is read where it lies in pass 1; pass 2 and the cut move those texts
only that runs were kept of. Nothing is broadcast but a bit table of such
documents, whose size is checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_hash, marked_rows, mix, slices, text_bytes

#: Bytes of a window and of an anchor string; half of the bytes beside the anchor in a window.
LENGTH, GRAM = 50, 16
WINDOWS = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2
SIDE = LENGTH - GRAM
#: Text bytes for a shard of the sort (what a task orders stays the same as the corpus grows), least shards, most tasks of a shuffle.
SHARD_BYTES, SHARDS, TASKS = 16 << 20, 8, 20_000
#: Text bytes whose runs are packed together, bytes hashed at once, and bits of a place within them; windows ordered at once, about.
SLICE, PIECE, PLACE_BITS, WINDOWS_MOST = 4 << 20, 1 << 20, 21, 1 << 18
#: Bits of the names of anchor strings and of runs.
NAME_BITS = 48

_W = np.random.default_rng(6).integers(1, 2**63, 7, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.random.default_rng(5).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.uint64((1 << NAME_BITS) - 1)

#: A run on its way to its shard, a removed run or an asked one on its way back, windows of a run on their way to theirs.
RUN = np.dtype([("key1", "<u8"), ("key2", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<u8"), ("name", "<u2"), ("start", "<u4"), ("count", "u1"), ("before", "u1")])
BACK = np.dtype([("doc", "<u8"), ("name", "<u2"), ("start", "<u4"), ("count", "u1"), ("before", "u1"), ("key1", "<u8")])
ASKED = np.dtype([("key1", "<u8"), ("start", "<u4"), ("count", "u1"), ("before", "u1")])
CONTEXT = np.dtype([("key1", "<u8"), ("doc", "<u8"), ("name", "<u2"), ("start", "<u4"), ("count", "u1"), ("before", "u1"), ("bytes", "u1", (GRAM + 2 * SIDE,))])
#: `before` of a run that is removed as a whole.
SETTLED = 255
PACKED = "shard int, payload binary"


@cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(records: np.ndarray, delta: str | None = None) -> bytes:
    """Records as compressed byte planes of their fields; ids count from the least, and `delta` holds steps."""
    least = int(records["doc"].min()) if len(records) else 0
    planes = [least.to_bytes(8, "little")]
    for field in records.dtype.names:
        x = records[field] - np.uint64(least) if field == "doc" else np.diff(records[field], prepend=np.uint64(0)) if field == delta else records[field]
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(records), -1).T.tobytes())
    return _codec()[0].compress(b"".join(planes))


def unpack(payloads: list[bytes], kind: np.dtype, delta: str | None = None) -> np.ndarray:
    parts = []
    for p in payloads:
        raw = _codec()[1].decompress(p)
        out, at = np.empty((len(raw) - 8) // kind.itemsize, kind), 8
        for field in kind.names:
            width = kind[field].itemsize
            x = np.frombuffer(raw, np.uint8, width * len(out), at).reshape(width, len(out)).T
            x = np.ascontiguousarray(x)
            out[field] = x if kind[field].shape else x.view(kind[field]).ravel()
            at += width * len(out)
        out["doc"] += np.uint64(int.from_bytes(raw[:8], "little"))
        if delta:
            out[delta] = np.cumsum(out[delta], dtype=np.uint64)
        parts.append(out)
    return np.concatenate(parts)


class Runs:
    """Runs of windows with one anchor, of a run of texts.

    doc, start, count: the text, the place of the first window in the text and
    the number of windows; before: bytes of the first window before the anchor;
    key1 names the anchor string, key2 all bytes of the run; left and right
    name the HALF bytes beside the anchor (0: the run doesn't reach that far).
    """

    FIELDS = (("doc", np.int64), ("start", np.int64), ("count", np.int64), ("before", np.int64), ("key1", np.uint64), ("key2", np.uint64), ("left", np.uint16), ("right", np.uint16))

    def __init__(self, texts: pa.Array):
        data, off = text_bytes(texts)
        total = int(off[-1])
        # Where a cut between pieces falls doesn't change which windows are found repeated: runs that it splits are compared by windows.
        found = [self.piece(data, off, lo, min(lo + PIECE, total)) for lo in range(0, total, PIECE)]
        for k, (field, kind) in enumerate(self.FIELDS):
            setattr(self, field, np.concatenate([x[k] for x in found]).astype(kind) if found else np.zeros(0, kind))

    def piece(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple:
        """The runs whose windows start in bytes lo to hi; texts may begin before or end after."""
        body = data[lo : min(len(data), hi + LENGTH - 1)]
        n = len(body)
        wide = np.zeros(n + 2 * LENGTH, np.uint8)
        wide[:n] = body
        v = np.empty(n + LENGTH, np.uint64)  # eight bytes from each place
        for k in range(8):
            part = wide[k : k + (n + LENGTH - k + 7) // 8 * 8 + 8]
            v[k::8] = part[: len(part) // 8 * 8].view(np.uint64)[: len(v[k::8])]
        h = mix(v[:n] * _C[0] + v[8 : n + 8] * _C[1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        best, reach = (h & ~low) | np.arange(n, dtype=np.uint64), 1
        while reach < WINDOWS:
            step = min(reach, WINDOWS - reach)
            best[:-step] = np.minimum(best[:-step], best[step:])
            reach += step
        # Windows that start in lo..hi and end inside their text.
        sizes = np.diff(np.clip(off, lo, hi))
        owner = np.repeat(np.arange(len(off) - 1, dtype=np.int32), sizes)
        room = np.repeat(off[1:] - LENGTH - lo, sizes).astype(np.int32)
        starts = np.flatnonzero(room >= np.arange(hi - lo, dtype=np.int32))
        anchor, owner = (best[starts] & low).astype(np.int64), owner[starts]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(starts) != 1)])) if len(starts) else np.zeros(0, np.int64)
        first, count, a, doc = starts[cut], np.diff(np.append(cut, len(starts))), anchor[cut], owner[cut]
        w = v[LENGTH - 8 : n + LENGTH - 8] * _W[6]
        for k in range(6):
            w += v[8 * k : n + 8 * k] * _W[k]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w))])
        key2 = join_hash(sums[first + count] - sums[first], ((a - first) << 8 | count).astype(np.uint64))

        def beside(at: np.ndarray, reaches: np.ndarray) -> np.ndarray:
            at = np.maximum(at, 0)
            name = mix(v[at] * _C[2] + v[at + 5] * _C[3] + v[at + HALF - 8] * _C[4]) >> np.uint64(48)
            return np.where(reaches, name | np.uint64(1), np.uint64(0)).astype(np.uint16)

        left = beside(a - HALF, a - first >= HALF)
        right = beside(a + GRAM, first + count - 1 >= a - HALF)
        return doc, first + lo - off[doc], count, a - first, h[a] & _MASK, key2 & _MASK, left, right


def split_by(shard: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with its records, their order kept."""
    order = np.argsort(shard, kind="stable")
    shard, records = shard[order], records[order]
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            yield int(shard[lo]), records[lo:hi]


def dealt(records: np.ndarray, by: str, shards: int, delta: str | None = None) -> pa.RecordBatch:
    """A row a shard with its records packed."""
    shard = (mix(records[by].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    rows = [(s, pack(r, delta)) for s, r in split_by(shard, records)]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["shard", "payload"])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each shard with its payloads, rows coming sorted by shard."""
    held, now = [], None
    for b in batches:
        for s, p in zip(b.column("shard").to_pylist(), b.column("payload").to_pylist(), strict=True):
            if s != now and held:
                yield now, held
                held = []
            now = s
            held.append(p)
    if held:
        yield now, held


def gathered(packed: DataFrame, shards: int) -> DataFrame:
    return packed.repartitionById(min(shards, TASKS), "shard").sortWithinPartitions("shard")


def rows_of(docs: DataFrame) -> DataFrame:
    """The rows that take part, each named by its id and 16 bits of its text's hash, which tell rows of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("name", F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).cast("int"))


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_SIGN = np.uint64(1 << 63)


def ordered_ids(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ _SIGN


def order_runs(rows: DataFrame, shards: int) -> DataFrame:
    """Pass 1: packed runs to remove and to ask for windows, dealt by document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            found = Runs(part.column("text"))
            r = np.zeros(len(found.doc), RUN)
            for field in ("key1", "key2", "left", "right", "start", "count", "before"):
                r[field] = getattr(found, field)
            r["doc"] = ordered_ids(part.column("doc_id").to_numpy())[found.doc]
            r["name"] = part.column("name").to_numpy()[found.doc]
            r = r[np.lexsort((r["doc"], r["key2"], r["key1"]))]
            new = starts_of(r["key1"], r["key2"])
            later = r["doc"] > np.repeat(r["doc"][new], np.diff(np.append(new, len(r))))  # an earlier document of this slice has the whole run
            yield dealt(r[~later], "key1", shards, delta="key1")
            # What is settled here needs no comparing; it goes along under numbers of its own, whole shards of documents.
            settled = dealt(returned(r[later], SETTLED), "doc", shards)
            yield pa.RecordBatch.from_arrays([pa.array(settled.column("shard").to_numpy() + shards, pa.int32()), settled.column("payload")], ["shard", "payload"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, payloads in by_shard(batches):
            if s < shards:
                yield dealt(compared(unpack(payloads, RUN, "key1")), "doc", shards)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([s - shards] * len(payloads), pa.int32()), pa.array(payloads, pa.binary())], ["shard", "payload"])

    return gathered(rows.mapInArrow(emit, PACKED), shards).mapInArrow(order, PACKED)


def returned(r: np.ndarray, before: int | np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), BACK)
    for field in ("doc", "name", "start", "count"):
        out[field] = r[field]
    out["before"] = before
    return out


def compared(r: np.ndarray) -> np.ndarray:
    """Of all runs of some anchor strings: those to remove, and those to ask for windows."""
    r = r[np.lexsort((r["doc"], r["key2"], r["key1"]))]
    new = starts_of(r["key1"], r["key2"])
    size = np.diff(np.append(new, len(r)))
    later = r["doc"] > np.repeat(r["doc"][new], size)
    # Of runs that differ, those that share bytes beside the anchor are asked for their windows, in every place of the first document.
    one = r[new]
    ask = np.zeros(len(one), bool)
    for side in ("left", "right"):
        s = np.lexsort((one[side], one["key1"]))
        k, x = one["key1"][s], one[side][s]
        same = (k[1:] == k[:-1]) & (x[1:] == x[:-1]) & (x[1:] > 0)
        ask[s[1:][same]] = True
        ask[s[:-1][same]] = True
    places = r[np.repeat(ask, size) & ~later]
    asked = returned(places, places["before"])
    asked["key1"] = places["key1"]
    return np.concatenate([returned(r[later], SETTLED), asked])


def by_document(packed: DataFrame, shards: int) -> DataFrame:
    """doc_id, name, runs to remove (merged: first and last window) and asked (packed), a row a document."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in by_shard(batches):
            r = unpack(payloads, BACK)
            r = r[np.lexsort((r["start"], r["name"], r["doc"]))]
            at = np.append(starts_of(r["doc"], r["name"]), len(r))
            ids, names = (r["doc"][at[:-1]] ^ _SIGN).view(np.int64), r["name"][at[:-1]].astype(np.int32)
            runs, asks = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                one = r[lo:hi]
                gone, ask = one[one["before"] == SETTLED], one[one["before"] != SETTLED]
                runs.append(merged(gone["start"].astype(np.int64), gone["count"].astype(np.int64)) if len(gone) else None)
                asks.append(ask[list(ASKED.names)].astype(ASKED).tobytes() if len(ask) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names), pa.array(runs, pa.binary()), pa.array(asks, pa.binary())], ["doc_id", "name", "runs", "asked"])

    return gathered(packed, shards).mapInArrow(merge, "doc_id long, name int, runs binary, asked binary")


def merged(start: np.ndarray, count: np.ndarray) -> bytes:
    """Runs of windows sorted by start, with those that touch joined, as pairs of first and last plus one."""
    reach = np.maximum.accumulate(start + count)
    at = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return np.stack([start[at], np.append(reach[at[1:] - 1], reach[-1])], axis=1).astype("<i8").tobytes()


def order_windows(asked: DataFrame, shards: int) -> DataFrame:
    """Pass 2: packed removals among single windows of asked runs; asked has doc_id, name, text and asked."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            data, off = text_bytes(part.column("text"))
            asks = [np.frombuffer(x, ASKED) for x in part.column("asked").to_pylist()]
            doc, a = np.repeat(np.arange(len(asks)), [len(x) for x in asks]), np.concatenate(asks)
            r = np.zeros(len(a), CONTEXT)
            for field in ASKED.names:
                r[field] = a[field]
            r["doc"] = ordered_ids(part.column("doc_id").to_numpy())[doc]
            r["name"] = part.column("name").to_numpy()[doc]
            anchor = off[doc] + a["start"].astype(np.int64) + a["before"]
            r["bytes"] = data[np.clip(anchor[:, None] + np.arange(-SIDE, GRAM + SIDE), 0, len(data) - 1)]
            yield dealt(r, "key1", shards)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in by_shard(batches):
            for r, row, step in windows_of(unpack(payloads, CONTEXT)):
                later = radix(r["key1"][row], r["before"][row].astype(np.int64) - step, r["bytes"], row, r["doc"][row])
                out = returned(r[row[later]], SETTLED)
                out["start"] += step[later].astype(np.uint32)
                out["count"] = 1
                yield dealt(out, "doc", shards)

    return gathered(asked.mapInArrow(emit, PACKED), shards).mapInArrow(order, PACKED)


def windows_of(r: np.ndarray, most: int = WINDOWS_MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs and their windows (the run's place and the window's step), about `most` windows at a time.

    Windows that can be equal come together: those of one anchor string, or of
    a frequent one those at one offset from it.
    """
    r = r[np.argsort(r["key1"], kind="stable")]
    ends = np.append(starts_of(r["key1"])[1:], len(r))
    total, lo = np.cumsum(r["count"].astype(np.int64)), 0
    while lo < len(r):
        before = total[lo - 1] if lo else 0
        fit = ends[(ends > lo) & (total[ends - 1] - before <= most)]
        if len(fit):
            part = r[lo : fit[-1]]
            count = part["count"].astype(np.int64)
            row = np.repeat(np.arange(len(part)), count)
            yield part, row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo = fit[-1]
            continue
        hi = ends[ends > lo][0]
        part = r[lo:hi]
        for offset in range(WINDOWS):
            step = part["before"].astype(np.int64) - offset
            row = np.flatnonzero((step >= 0) & (step < part["count"]))
            if len(row) > 1:
                yield part, row, step[row]
        lo = hi


def radix(key1: np.ndarray, offset: np.ndarray, contexts: np.ndarray, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows are also in a document with a smaller id.

    Most significant digit first: the anchor string and its offset, then the
    window's bytes, eight at a time. Windows alone in their group leave.
    """
    active = np.arange(len(row))
    group = np.unique(join_hash(key1, offset.astype(np.uint64)), return_inverse=True)[1]
    padded = np.zeros((len(contexts), contexts.shape[1] + 8), np.uint8)
    padded[:, : contexts.shape[1]] = contexts
    for digit in range(0, LENGTH, 8):
        width = min(8, LENGTH - digit)
        column = (SIDE - offset[active] + digit)[:, None] + np.arange(width)
        raw = np.zeros((len(active), 8), np.uint8)
        raw[:, :width] = padded[row[active][:, None], column]
        value = raw.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((value, group[active]))
        active, value = active[order], value[order]
        at = starts_of(group[active], value)
        size = np.diff(np.append(at, len(active)))
        group[active] = np.repeat(np.arange(len(at)), size)
        active = active[np.repeat(size, size) > 1]
    active = active[np.lexsort((ids[active], group[active]))]
    at = starts_of(group[active])
    return active[ids[active] > np.repeat(ids[active][at], np.diff(np.append(at, len(active))))]


def deduplicate(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row.

    Each byte of a text (UTF-8) that lies in a LENGTH-byte string which also
    starts in a document with a smaller doc_id is removed; what counts is the
    input. n_spans is the number of maximal removed runs, kept_sha256 of the
    remaining bytes joined. With texts, those come along as kept (binary: a
    cut may fall inside a character).

    Matches don't cross documents. A null text counts as empty. Rows that
    repeat a doc_id are one document for this rule; a row without doc_id loses
    nothing and takes nothing from others. Other columns are not read. An
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = rows_of(docs)
    usable = rows.where("doc_id is not null")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, size // SHARD_BYTES)
    runs = scratch.keep(by_document(order_runs(usable, shards), shards), "runs")
    asked = runs.where("asked is not null").select("doc_id", "name", "asked")
    wanted, _ = marked_rows(usable, asked, ["doc_id", "name"])
    windows = scratch.keep(by_document(order_windows(wanted.join(asked, ["doc_id", "name"]), shards), shards), "windows")

    gone = runs.where("runs is not null").select("doc_id", "name", "runs").unionByName(windows.select("doc_id", "name", "runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = part.column("runs").to_pylist() if "runs" in part.schema.names else [None] * part.num_rows
            found = [cut_one(t.encode(), x) for t, x in zip(part.column("text").to_pylist(), lists, strict=True)]
            columns = list(zip(*found, strict=True))
            arrays = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array([hashlib.sha256(x).hexdigest() for x in columns[3]], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[3], pa.binary())] * texts, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    touched, whole = marked_rows(rows, gone.select("doc_id", "name"), ["doc_id", "name"], rest=(cut, schema))
    joined = touched.join(gone.groupBy("doc_id", "name").agg(F.collect_list("runs").alias("runs")), ["doc_id", "name"], "left")  # a document's own runs only
    return joined.select("doc_id", "text", "runs").mapInArrow(cut, schema).unionByName(whole)


def cut_one(text: bytes, payloads: list[bytes] | None) -> tuple[int, int, int, bytes]:
    if not payloads:
        return len(text), 0, 0, text
    runs = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in payloads])
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1] - 1 + LENGTH, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()
