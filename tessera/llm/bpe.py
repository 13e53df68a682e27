"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a block of texts are laid end to end as bytes. An
inverted index holds, for the rank that merging a pair would give, the places
where such a pair stands. Ranks are replayed from the lowest; a merge touches
the two neighbours of its place only. Words then map to their ids, so a text
costs one look-up a word however often a word occurs.

A merge can open a pair of a lower rank than its own, so a rank is applied to
the leftmost of its places in each word, and further places of that word go
back into the index: the ids are those of the always-lowest-rank-first rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import as_bytes, slices, text_bytes

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Units that a Python worker remembers before it starts anew, and the text bytes whose new units are learnt at once.
UNITS_KEPT, LEARN_BYTES = 300_000, 6 << 20
_NONE = np.int64(1 << 40)
#: White space of one byte, and bytes that other white space starts with.
_BLANK, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Letters, and marks or nothing, that a blank led: one match of the pattern each. Other units go through the pattern.
_SIMPLE = re.compile("( [A-Za-zÀ-ÖØ-öø-ƺ]+)([!-&(-/:-@]*)").fullmatch

#: Texts on which a pattern must cut at white space, and units that _SIMPLE may split for it.
_PROBES = ["one two\nthree", "a, b. (c) d's we'll 12 34x", " lead\ttab x", "é ü 日本 😀 x", "end."]
_SHORT_PROBES = [" word", " word.", " word!?", " Wörd)", " a-", " abc,.", " x&"]


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


class Merges:
    """Merges of a vocabulary: the rank, which is the id, that each pair of ids gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys, found = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    found.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.found = np.array(keys, np.int64)[order], np.array(found, np.int64)[order]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_NONE where the pair gives no token; the end of a word is id -1."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and where each word's begin, with the end of the last."""
        raw = np.frombuffer(b"\0".join([b"", *words, b""]), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])
        ids = self.bytes[raw]
        ids[ends] = -1
        n = len(ids)
        owner = np.repeat(np.arange(len(words) + 1), np.concatenate([[1], lengths + 1]))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        now = np.full(n, _NONE)
        now[:-1] = self.rank(ids[:-1], ids[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi:
                    if (r := int(ranks[lo])) in index:
                        index[r].append(places[lo:hi])
                    else:
                        index[r] = [places[lo:hi]]
                        heapq.heappush(heap, r)

        there = np.flatnonzero(now < _NONE)
        post(there, now[there])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[now[places] == r]
            if len(places) > 1:
                same = owner[places[1:]] == owner[places[:-1]]
                if same.any():
                    post(places[1:][same], np.full(int(same.sum()), r))
                    places = places[np.concatenate([[True], ~same])]
            if not len(places):
                continue
            gone = after[places]
            right, left = after[gone], before[places]
            ids[places] = r
            ids[gone] = -2
            now[gone] = _NONE
            after[places], before[right] = right, places
            touched = np.concatenate([left, places])
            ranks = now[touched] = self.rank(ids[touched], np.concatenate([ids[places], ids[right]]))
            good = ranks < _NONE
            if good.any():
                post(touched[good], ranks[good])
        left = ids >= 0
        return ids[left], np.cumsum(np.bincount(owner[left], minlength=len(words) + 1))


class Codec:
    """Encodes and decodes runs of texts; remembers the units that it has met.

    A unit is a part of a text that starts at white space after something
    else, where the split pattern always cuts; the pattern must let white
    space be at the start of a match only, or by itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.ranks = Merges(ranks), ranks
        self.split = regex.compile(pattern).findall
        self.ids: dict[bytes, bytes] = {}
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            tokens[r] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.digits = pa.array([str(r) for r in range(len(tokens))], pa.large_string())

        for text in _PROBES:
            units = ["".join(p) for p in re.findall(r"((?:^|[\x09-\x0d\x1c-\x20])[\x09-\x0d\x1c-\x20]*)([^\x09-\x0d\x1c-\x20]*)", text)]
            if [w for u in units for w in self.split(u)] != self.split(text):
                raise ValueError("the pattern doesn't always cut where white space begins")
        probes = [p for p in _SHORT_PROBES if _SIMPLE(p)]
        self.short = all(self.split(p) == [x for x in _SIMPLE(p).groups() if x] for p in probes)

    def words(self, unit: bytes) -> list[bytes]:
        """The matches of the pattern in a unit."""
        if (simple := _SIMPLE(text := unit.decode())) and self.short:
            word, mark = simple.groups()
            return [word.encode(), mark.encode()] if mark else [unit]
        return [w.encode() for w in self.split(text)]

    def learn(self, units: list[bytes]) -> None:
        fresh = [u for u in units if u not in self.ids]
        if len(self.ids) + len(fresh) > UNITS_KEPT:
            self.ids.clear()
            fresh = units
        split = [self.words(u) for u in fresh]
        found: dict[bytes, bytes] = {}
        rest: list[bytes] = []
        for w in {w for words in split for w in words}:
            if (r := self.ranks.get(w)) is not None:
                found[w] = r.to_bytes(4, sys.byteorder)
            else:
                rest.append(w)
        if rest:
            ids, bounds = self.merges.replay(rest)
            blob = ids.astype(np.int32).tobytes()
            ends = (4 * bounds).tolist()
            found.update((w, blob[lo:hi]) for w, lo, hi in zip(rest, ends[:-1], ends[1:], strict=True))
        for u, words in zip(fresh, split, strict=True):
            self.ids[u] = b"".join([found[w] for w in words]) if len(words) > 1 else found[words[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and where each text's begin, with the end of the last."""
        data, off = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        blank = _BLANK[data]
        cut = blank.copy()
        lead = np.flatnonzero(_LEAD[data])  # characters that may be white space outside ASCII
        for k in range(3):
            blank[np.minimum(lead + k, len(data) - 1)] = True
        cut[1:] &= ~blank[:-1]
        cut[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = as_bytes(units.dictionary)
        self.learn(distinct)
        known = [self.ids[u] for u in distinct]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, first = np.frombuffer(b"".join(known), np.int32), np.concatenate([[0], np.cumsum(lengths)])
        which = units.indices.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(lengths[which])])
        ids = flat[np.repeat(first[which] - bounds[:-1], lengths[which]) + np.arange(bounds[-1])]
        return ids, bounds[np.searchsorted(starts, off)]

    def written(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of each text as decimals joined by commas."""
        lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), self.digits.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(",", pa.large_string())).cast(pa.large_binary()).to_pylist()

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        found = self.tokens.take(pa.array(ids))
        off, data = np.frombuffer(found.buffers()[1], np.int64), memoryview(found.buffers()[2] or b"")
        return [bytes(data[lo:hi]) for lo, hi in zip(off[at[:-1]].tolist(), off[at[1:]].tolist(), strict=True)]


_codec: dict[tuple[str, str], Codec] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over
    the bytes that the ids decode to; with ids, the ids come along as
    array<int>. A null text counts as empty: no tokens, hashes of nothing.
    A doc_id that repeats or is null gives a row each time. Other columns are
    not read. An empty table gives an empty result.

    The pattern must cut wherever white space begins; that is checked on some
    texts, and another pattern is an error. No shuffle: each task replays merges over its own words. The broadcast is
    the rank file, whose size doesn't depend on the corpus.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := (ranks_path, pattern)) not in _codec:
            _codec.clear()
            _codec[key] = Codec(parse_ranks(shared.value), pattern)
        codec = _codec[key]
        for part in slices(batches, limit=LEARN_BYTES):
            found, at = codec.encode(part.column("text"))
            columns = [
                part.column("doc_id"),
                pa.array(np.diff(at), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in codec.written(found, at)], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(found, at)], pa.string()),
            ]
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found))] if ids else []
            yield pa.RecordBatch.from_arrays(columns + lists, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * ids)
