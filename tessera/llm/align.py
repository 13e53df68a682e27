"""Alignment of two tokenizers over a corpus: where tokens of both end, texts are cut into groups.

A run of texts is one array of bytes with the offsets of its documents. The
ends of both tokenizers' tokens are counted by place (bincount); a cut is where
both have one. Sums of those counts up to a place give groups and numbers of
tokens of every document, as differences at the documents' bounds. Token pairs
that end together are counted over the corpus; the table of counts is bounded
by the vocabularies, so that it goes to all workers.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, as_bytes, slices, text_bytes

#: Bytes of a run of texts, units (a word and the white space before it) whose ids a worker remembers, bytes of those that it doesn't, and units that go to a library at once.
RUN_BYTES, UNITS_KEPT, LONG_UNIT, UNITS_AT_ONCE = 1 << 20, 150_000, 256, 4_000

_SPACE = 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of characters that may be white space outside ASCII.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Tokenizer:
    """Ids of units of text by one vocabulary, remembered; token bytes by id."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.tokens, self.encode_units = pa.array(tokens, pa.large_binary()), encode
        self.known: dict[bytes, bytes] = {}
        #: Known units that were asked for again since room was last made.
        self.again: set[bytes] = set()
        #: Of the known units those whose ids don't stand for their very bytes.
        self.wrong: set[bytes] = set()

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return bytes(self.tokens.take(pa.array(ids)).buffers()[2] or b"") if len(ids) else b""

    def learn(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit (int32). Where room runs out, units that were asked for once only go."""
        self.again.update(u for u in units if u in self.known)
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > UNITS_KEPT:
            stay = self.again if len(self.again) + len(new) <= UNITS_KEPT else self.again.intersection(units)
            self.known, self.wrong, self.again = {u: self.known[u] for u in stay}, self.wrong & stay, set()
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for lo in range(0, len(new), UNITS_AT_ONCE):
            lists = self.encode_units([u.decode() for u in new[lo : lo + UNITS_AT_ONCE]])
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            flats.append(np.fromiter(chain.from_iterable(lists), np.int32, sizes[-1].sum()))
        at, flat = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(flats)
        blob, ends = flat.tobytes(), (4 * at).tolist()
        fresh = {u: blob[lo:hi] for u, lo, hi in zip(new, ends[:-1], ends[1:], strict=True)}
        self.known.update(fresh)
        if self.bytes_of(flat) != b"".join(new):
            self.wrong.update(u for u, ids in fresh.items() if self.bytes_of(np.frombuffer(ids, np.int32)) != u)
        found = [self.known[u] for u in units]
        for u in new:
            if len(u) > LONG_UNIT and u not in self.wrong:
                del self.known[u]
        return found


def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file of the tokenizers library; its text is encoded as it is."""
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads of the library's own cost more CPU
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    engine = tokenizers.Tokenizer.from_file(path)
    engine.encode_special_tokens = True
    tokens = [b""] * (1 + max([*vocabulary.values(), *engine.get_added_tokens_decoder()]))
    for text, i in vocabulary.items():
        tokens[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
    return Tokenizer(tokens, lambda units: [e.ids for e in engine.encode_batch_fast(units, add_special_tokens=False)])


def pieces(path: str) -> Tokenizer:
    """A sentencepiece model that puts a space before its text and has no piece over a word's bound."""
    import sentencepiece

    engine = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [engine.id_to_piece(i) for i in range(engine.get_piece_size())]
    if any("▁" in t.lstrip("▁") for t in texts):
        raise ValueError("a piece reaches over the start of a word")
    tokens = [bytes([int(t[1:-1], 16)]) if engine.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
    alone = engine.piece_to_id("▁")

    def encode(units: list[str]) -> list[list[int]]:
        # The model adds the space again that a unit begins with.
        return [ids or [alone] for ids in engine.encode([u[1:] for u in units], num_threads=1)]

    return Tokenizer(tokens, encode)


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units begin: at each text's first byte, and at a space after something that isn't white space."""
    white = _WHITE[data]
    for k, lead in enumerate([np.flatnonzero(_LEAD[data])] * 3):
        white[np.minimum(lead + k, len(data) - 1)] = True
    start = data == _SPACE
    start[1:] &= ~white[:-1]
    start[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(start)


class Run:
    """Ids of both tokenizers for the texts of a run, with where each token ends; texts that don't come out byte for byte have none."""

    def __init__(self, texts: pa.Array, a: Tokenizer, b: Tokenizer):
        data, off = text_bytes(pc.replace_with_mask(spaced := pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), ""), pc.equal(spaced, " "), pa.scalar("")))
        starts = unit_starts(data, off) if len(data) else np.zeros(0, np.int64)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct, which = as_bytes(units.dictionary), units.indices.to_numpy(zero_copy_only=False)
        of = np.searchsorted(off, starts, "right") - 1
        found = [t.learn(distinct) for t in (a, b)]
        good = np.ones(len(off) - 1, bool)
        if wrong := a.wrong | b.wrong:
            good[of[np.array([u in wrong for u in distinct], bool)[which]]] = False
        for d in np.flatnonzero(~good):  # a unit differs; whole texts decide
            at = which[np.searchsorted(of, d) : np.searchsorted(of, d, "right")]
            whole = bytes(data[off[d] : off[d + 1]])
            good[d] = all(t.bytes_of(np.frombuffer(b"".join([f[u] for u in at]), np.int32)) == whole for t, f in zip((a, b), found, strict=True))
        which = which[good[of]]
        size = np.where(good, np.diff(off), 0)
        #: Bounds of the texts in the bytes of those that have tokens.
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.ids, self.ends = [], []
        for t, f in zip((a, b), found, strict=True):
            lengths = np.fromiter(map(len, f), np.int64, len(f)) // 4
            flat, first = np.frombuffer(b"".join(f), np.int32), np.concatenate([[0], np.cumsum(lengths)])
            at = np.concatenate([[0], np.cumsum(lengths[which])])
            self.ids.append(flat[np.repeat(first[which] - at[:-1], lengths[which]) + np.arange(at[-1])])
            self.ends.append(np.cumsum(t.sizes[self.ids[-1]]))


class Cuts:
    """Where tokens of both sides end together in a run, and sums up to each place."""

    def __init__(self, run: Run):
        counts = [np.bincount(ends, minlength=run.off[-1] + 1) for ends in run.ends]
        cut = (counts[0] > 0) & (counts[1] > 0)
        self.places = np.flatnonzero(cut)
        #: For either side the tokens that end up to a place, and for groups the cuts.
        self.upto = [np.cumsum(c, dtype=np.int64) for c in counts]
        self.groups = np.cumsum(cut)
        #: The group of each token: cuts before its end.
        self.group = [self.groups[ends - 1] for ends in run.ends]
        # Tokens have bytes, so at most one of a side ends at a place.
        self.links = [run.ids[k][self.upto[k][self.places] - 1] for k in (0, 1)]

    def of(self, sums: np.ndarray, off: np.ndarray) -> np.ndarray:
        """What lies between the bounds of each text."""
        return np.diff(sums[off])


def written(run: Run, cuts: Cuts, digits: list[pa.Array]) -> list[bytes]:
    """The groups of each text as `a1,a2|b1;a3|b2,b3`.

    digits has the decimal ids, first each with a comma, then with what ends a
    side of a group.
    """
    total = [len(x) for x in run.ids]
    parts, places = [], []
    for k in (0, 1):
        group = cuts.group[k]
        last = np.append(group[1:] != group[:-1], True) if total[k] else np.zeros(0, bool)
        parts.append(run.ids[k] + last * (len(digits[k]) // 2))
        # Before a token of the left side stand the right side's of earlier groups; before one of the right also the left's of its own.
        per_group = np.concatenate([[0], np.cumsum(np.bincount(cuts.group[1 - k], minlength=len(cuts.places)))])
        places.append(np.arange(total[k]) + per_group[group + k])
    order = np.empty(sum(total), np.int64)
    order[places[0]], order[places[1]] = parts[0], parts[1] + len(digits[0])
    text = pa.concat_arrays(digits).take(pa.array(order))
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    body = memoryview(text.buffers()[2] or b"") if len(text) else memoryview(b"")
    at = bounds[cuts.upto[0][run.off] + cuts.upto[1][run.off]]
    return [bytes(body[lo : hi - 1]) if lo < hi else b"" for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def side_digits(size: int, end: str) -> pa.Array:
    ids = [str(i) for i in range(size)]
    return pa.array([x + "," for x in ids] + [x + end for x in ids], pa.large_string())


_sides: dict[tuple[str, str], tuple[Tokenizer, Tokenizer, list[pa.Array]]] = {}


def sides(a_path: str, b_path: str) -> tuple[Tokenizer, Tokenizer, list[pa.Array]]:
    if (key := (a_path, b_path)) not in _sides:
        a, b = byte_level(a_path), pieces(b_path)
        _sides.clear()
        _sides[key] = a, b, [side_digits(len(a.tokens), "|"), side_digits(len(b.tokens), ";")]
    return _sides[key]


def links_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of linked pairs of a batch, and where each row's begin."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.uint32), (off - off[0]) // 4


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text; with groups, the groups as text too.

    A (a byte-level BPE file) encodes a space and the text, B (a sentencepiece
    model) the text, to which it adds the space. Tokens of both that end at
    the same byte are linked and end a group. A pair's count is the number of
    its links in the corpus; n_best counts links whose pair has the highest
    count among all of its B id, count_sum adds up the counts.

    Texts that are null or empty, or that either side doesn't give back byte
    for byte (such as those with U+2581, which B reads as a space), have zeros
    and an empty groups_sha256. Rows are rows: ids may repeat or be null. Other columns
    are not read; an empty table gives an empty result.

    Both encode a run's distinct units (a word with the white space before it)
    once; neither has a token over the bound of two units. The linked pairs go
    into a table in the shared folder, four bytes each, and texts are not read
    again. Of two tokens that end together one is an ending of the other, so
    there are no more pairs than both vocabularies have endings (some 700,000
    here): counts are summed by Spark and sent to all workers.
    """
    spark, schema = docs.sparkSession, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary" + ", groups string" * groups

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, digits = sides(a_path, b_path)
        if len(a.tokens) * len(b.tokens) >= 1 << 32 or not b.sizes.all():
            raise ValueError("vocabularies whose pairs of ids fit 32 bits, without empty tokens, are needed")
        for part in slices(batches, limit=RUN_BYTES):
            run = Run(part.column("text"), a, b)
            cuts = Cuts(run)
            n = [cuts.of(x, run.off) for x in (*cuts.upto, cuts.groups)]
            code = (cuts.links[0].astype(np.uint32) * np.uint32(len(b.tokens)) + cuts.links[1].astype(np.uint32)).tobytes()
            pairs = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * cuts.groups[run.off]).astype(np.int32)), pa.py_buffer(code)])
            texts = written(run, cuts, digits)
            hashes = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
            columns = [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (*n, n[2])], hashes, pairs, *[pa.array(texts, pa.binary()).cast(pa.string())] * groups]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", *["groups"] * groups])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            found = [np.unique(x, return_counts=True) for x in waiting]
            every, places = np.unique(np.concatenate([keys, *[f[0] for f in found]]), return_inverse=True)
            return every, np.bincount(places, np.concatenate([sums, *[f[1] for f in found]]).astype(float), len(every)).astype(np.int64)

        for batch in batches:
            waiting.append(links_of(batch.column("pairs"))[0])
            if sum(map(len, waiting)) > 2_000_000:
                (keys, sums), waiting = fold(), []
        keys, sums = fold()
        for lo in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 50_000].astype(np.int64)), pa.array(sums[lo : lo + 50_000])], ["pair", "n"])

    scratch = Scratch(spark, "align")
    rows = scratch.keep(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(cut, schema), "links")
    _, b, _ = sides(a_path, b_path)
    width = len(b.tokens)
    counts = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    known = scratch.keep(counts, "counts").toArrow().sort_by("pair")
    keys, n = known["pair"].to_numpy().astype(np.uint32), known["n"].to_numpy()
    most = np.zeros(width, np.int64)
    np.maximum.at(most, keys % width, n)
    shared = spark.sparkContext.broadcast((keys, n, n == most[keys % width]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            codes, at = links_of(batch.column("pairs"))
            where = np.searchsorted(keys, codes)
            sums = [np.concatenate([[0], np.cumsum(x[where])])[at] for x in (best, n)]
            yield batch.drop_columns(["pairs"]).append_column("n_best", pa.array(np.diff(sums[0]), pa.int64())).append_column("count_sum", pa.array(np.diff(sums[1]), pa.int64()))

    return rows.mapInArrow(look_up, schema.replace(", pairs binary", "") + ", n_best long, count_sum long")
