"""Personal data: fixed patterns, and a linear-chain CRF over word-shape features.

The patterns' spans always stand. The conditional random field adds spans in
spellings that no pattern covers (bracketed or spelt-out signs, numbers split
by other signs, national telephone numbers); it is trained by maximum
likelihood on a small labelled table, and decoded by Viterbi over batches of
token sequences. An added span must also be sound (digits, parts, check sum)
and clear of pattern spans.

Only stretches round a digit, an at sign or a spelt-out sign are decoded: a
token whose surroundings hold none of these has one and the same score, which
favours "no data" by more than any transition can win (checked after
training). A stretch is made of whole words, with two more on either side. One
of more than PIECE tokens is decoded in pieces that overlap by OVERLAP tokens
on either side; its tokens are kept as numbers, 24 bytes each.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import slices

# Kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
# The first two take a whole run of signs that can begin a match, and then what makes it one (group 1), if that follows:
# where a run fails, its later signs fail as well. So a long run is read once, not once from each of its signs.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
#: Characters either side of a trigger that are decoded at least, and tokens decoded in one batch.
REACH, BATCH_TOKENS = 48, 1 << 16
#: Tokens of a long stretch that are labelled at once, and those before and after them that are read with them.
PIECE, OVERLAP = 512, 64
Span = tuple[int, int, int]  # kind, start, end

_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|[^\s]")
_SPACE = re.compile(r"\s+")
_TRIGGER = re.compile(r"[0-9@]+|[\[({]\s?(?:at|dot)\s?[\])}]|(?<=\s)dot(?=\s)", re.IGNORECASE)
_ANY = r"(?i)[0-9@]|[\[({]\s?(at|dot)\s?[\])}]|\sdot\s"  # the same for RE2, at least


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    return len(x := digits.lstrip("0")) <= 3 and int(x or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start; failing matches are dropped without another try."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, *m.span()) for m in EMAIL.finditer(text) if m[1]]
    if "." in text:
        found += [(1, *m.span()) for m in IP.finditer(text) if m[1] and all(byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return found


# The field.

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_WORDS = {w: w for w in "at dot com org net de fr es io edu phone tel fax mobile call mail email card visa ip host server".split()}


def shape(token: str) -> str:
    if token.isascii() and token.isdigit():
        n = len(token)
        return f"d{n}" if n <= 4 else "d5-7" if n < 8 else "d8-12" if n < 13 else "d13-19" if n < 20 else "d20+"
    if token.isalpha():
        low = token.lower()
        return _WORDS.get(low) or ("upper" if token.isupper() and len(token) > 1 else "word")
    return token if token.isascii() else "sign"


def features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    """Names of each token's features: shapes up to two tokens around, joined neighbours, and gaps."""
    shapes = ["<", "<", *[shape(t) for t, _, _ in tokens], ">", ">"]
    gaps = ["_" if k and tokens[k][1] > tokens[k - 1][2] else "" for k in range(len(tokens))] + [""]
    out = []
    for k in range(len(tokens)):
        s = shapes[k : k + 5]
        out.append(["1", *[f"{o}{x}" for o, x in enumerate(s)], f"a{s[1]}{gaps[k]}|{s[2]}", f"b{s[2]}{gaps[k + 1]}|{s[3]}", f"c{s[1]}|{s[2]}|{s[3]}", f"g{gaps[k]}{s[2]}"])
    return out


def tokenise(text: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def training_table(rows: int = 500, seed: int = 17) -> list[tuple[str, list[Span]]]:
    """Small made-up texts with the spans of personal data in them."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick(*"bcdfghlmnprstvw") + pick(*"aeiou") for _ in range(rng.integers(1, 4)))

    def email() -> str:
        user, host, tld = word() + pick("", "", digits(2), "." + word(), "_" + word()), word() + pick("", digits(1)), pick("com", "org", "net", "de", "io")
        at, dot = pick(("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" {at} ", " {dot} "), (" @ ", " . "))
        return f"{user}{at}{host}{dot}{tld}"

    def ip() -> str:
        return pick(".", ".", "[.]", "(.)", " . ", "[dot]").join(str(x) for x in rng.integers(0, 256, 4))

    def card() -> str:
        return pick("", " ", "-", ".", "/", " - ", "_").join(digits(4) for _ in range(4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"({a}){b}-{c}", f"+{digits(2)} {a} {b}{c}")

    def other() -> str:
        return pick(
            word, lambda: f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", lambda: f"version {rng.integers(1, 9)}.", lambda: str(rng.integers(1900, 2030)), lambda: f"{rng.integers(0, 24)}:{rng.integers(10, 60)}",
            lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(24))}"',
            lambda: f"{digits(2)} %", lambda: f"# {digits(3)}", lambda: f"({digits(1)})", lambda: f"at {word()}", lambda: f"dot {word()}", lambda: f"{word()} | {word()}", lambda: f"{word()}, at the {word()}.", lambda: f"{digits(2)} {word()} {digits(3)}", lambda: f"page {digits(3)}", lambda: f"{digits(3)}.{digits(3)}",
        )()

    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.integers(3, 8)):
            text += " ".join(pick(word, word, lambda: word().capitalize(), lambda: word().upper())() + pick("", "", "", ",", ".", "###", "!!", "%%%", " |") for _ in range(rng.integers(1, 5))) + " "
            kind = int(rng.integers(0, 8))
            if kind < 4:
                text += pick("", "", "", ["mail ", "ip ", "card ", "phone: "][kind])
                value = (email, ip, card, phone)[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick(" ", " ", ". ", ", ", "### ")
            else:
                text += other() + " "
        out.append((text, spans))
    return out


@dataclass
class Field:
    """Weights of features by label, transitions, and starts."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    @cached_property
    def shapes(self) -> dict[str, int]:
        """Numbers of the shapes seen in training, the ends' included; 0 is for all others."""
        seen = sorted({f[1:] for f in self.names if len(f) > 1 and f[0] in "01234"})
        return {x: k for k, x in enumerate(seen, 1)}

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """Numbers of features by shapes and gaps: of one shape at each place, of two with their gap (left, right), of three, and of one with its gap."""
        unknown, get = len(self.names), self.names.get
        x = ["\0", *self.shapes]  # no token has the first
        of = lambda names: np.array([get(n, unknown) for n in names], np.int32)
        n, gaps = len(x), ("", "_")
        return (
            of(f"{o}{s}" for o in range(5) for s in x).reshape(5, n),
            of(f"a{s}{g}|{t}" for s in x for g in gaps for t in x).reshape(n, 2, n),
            of(f"b{s}{g}|{t}" for s in x for g in gaps for t in x).reshape(n, 2, n),
            of(f"c{s}|{t}|{u}" for s in x for t in x for u in x).reshape(n, n, n),
            of(f"g{g}{s}" for g in gaps for s in x).reshape(2, n),
        )

    def read(self, text: str, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens' starts and ends, and their shapes with two ends either side."""
        flat, known = array("q"), self.shapes
        for m in _TOKEN.finditer(text, start, len(text) if end is None else end):
            flat.extend((m.start(), m.end(), known.get(shape(m[0]), 0)))
        rows = np.frombuffer(flat, np.int64).reshape(-1, 3) if flat else np.zeros((0, 3), np.int64)
        left, right = known.get("<", 0), known.get(">", 0)
        return rows[:, 0], rows[:, 1], np.concatenate([[left, left], rows[:, 2], [right, right]])

    def emissions(self, shapes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Scores (tokens, labels), from shapes with two more either side, and whether a gap lies before each token and after the last."""
        one, left, right, three, own = self.tables
        s = [shapes[o : len(shapes) - 4 + o] for o in range(5)]
        before, after = gaps[:-1], gaps[1:]
        always = np.full(len(s[0]), self.names["1"])
        ids = np.stack([always, *[one[o, s[o]] for o in range(5)], left[s[1], before, s[2]], right[s[2], after, s[3]], three[s[1], s[2], s[3]], own[before, s[2]]], axis=1)
        return np.vstack([self.weights, np.zeros(len(LABELS))])[ids].sum(axis=1)

    def decode(self, sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The best labels of each sequence of tokens as read: Viterbi over batches of pieces of like lengths."""
        out = [np.zeros(len(s), np.int8) for s, _, _ in sequences]
        pieces = []  # sequence, first and end of what is read, first and end of what is labelled
        for k, (s, _, _) in enumerate(sequences):
            n = len(s)
            whole = n <= PIECE + 2 * OVERLAP
            for lo in range(0, n, n if whole and n else PIECE):
                hi = n if whole else min(n, lo + PIECE)
                pieces.append((k, max(0, lo - OVERLAP), min(n, hi + OVERLAP), lo, hi))
        pieces.sort(key=lambda p: p[2] - p[1])
        at = 0
        while at < len(pieces):
            least, n, total = pieces[at][2] - pieces[at][1], 0, 0
            batch, scores = [], []
            while at + n < len(pieces) and (not n or (total < BATCH_TOKENS and pieces[at + n][2] - pieces[at + n][1] <= 2 * least)):
                k, a, b, _, _ = piece = pieces[at + n]
                starts, ends, shapes = sequences[k]
                gaps = np.zeros(b - a + 1, np.int64)  # 0 at the ends
                lo, hi = max(a, 1), min(b + 1, len(starts))
                gaps[lo - a : hi - a] = starts[lo:hi] > ends[lo - 1 : hi - 1]
                batch.append(piece)
                scores.append((shapes[a : b + 4], gaps))
                total += b - a
                n += 1
            at += n
            lengths = np.array([b - a for _, a, b, _, _ in batch])
            found = np.concatenate([self.emissions(*x) for x in scores]) if len(scores) == 1 else self.joint_emissions(scores)
            for (k, a, _, lo, hi), labels in zip(batch, self.viterbi(found, lengths), strict=True):
                out[k][lo:hi] = labels[lo - a : hi - a]
        return out

    def joint_emissions(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of several pieces, one after the other, worked out at once: the places between them are left out."""
        shapes = np.concatenate([s for s, _ in parts])
        gaps = np.concatenate([np.concatenate([g, [0, 0, 0]]) for _, g in parts])[: len(shapes) - 3]
        inside = np.concatenate([np.arange(len(s)) < len(s) - 4 for s, _ in parts])[: len(shapes) - 4]
        return self.emissions(shapes, gaps)[inside]

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        n, width = len(lengths), int(lengths.max())
        at = np.concatenate([[0], np.cumsum(lengths)])
        grid = np.zeros((n, width, len(LABELS)))
        row = np.repeat(np.arange(n), lengths)
        grid[row, np.arange(at[-1]) - at[row]] = scores
        back = np.zeros((n, width, len(LABELS)), np.int8)
        best = self.starts + grid[:, 0]
        for t in range(1, width):
            step = best[:, :, None] + self.moves
            back[:, t] = step.argmax(axis=1)
            best = np.where((t < lengths)[:, None], step.max(axis=1) + grid[:, t], best)
        labels = np.zeros((n, width), np.int64)
        now = best.argmax(axis=1)
        for t in range(width - 1, -1, -1):
            labels[:, t] = now
            now = np.where((t < lengths) & (t > 0), back[np.arange(n), t, now], now)
        return [labels[k, : lengths[k]] for k in range(n)]

    def margin(self) -> float:
        """By how much a token among plain words favours O, less what leaving O and coming back can win; positive if such tokens may be skipped."""
        worst = np.inf
        for token in ("bala", "BALA", "Bala"):
            for gap in (0, 1):
                starts, _, shapes = self.read(" ".join([token] * 7))
                e = self.emissions(shapes, np.array([0, *[gap] * (len(starts) - 1), 0]))[3]
                worst = min(worst, e[0] - e[1:].max())
        other = self.moves.copy()
        other[0, 0] = -np.inf
        return float(worst - 2 * max(0.0, other.max() - self.moves[0, 0]))


def allowed_moves() -> tuple[np.ndarray, np.ndarray]:
    """0 where a label may follow another (or start), else a large penalty: I only after B or I of its kind."""
    moves, starts = np.zeros((len(LABELS), len(LABELS))), np.zeros(len(LABELS))
    for b, to in enumerate(LABELS):
        if to.startswith("I-"):
            starts[b] = -1e4
            moves[:, b] = np.where([x[2:] == to[2:] and x != "O" for x in LABELS], 0, -1e4)
    return moves, starts


def labelled(table: list[tuple[str, list[Span]]]) -> tuple[list[list[tuple[str, int, int]]], list[np.ndarray]]:
    sequences, labels = [], []
    for text, spans in table:
        tokens = tokenise(text)
        y = np.zeros(len(tokens), np.int64)
        for kind, start, end in spans:
            inside = [k for k, (_, a, b) in enumerate(tokens) if a < end and b > start]
            y[inside] = 2 + 2 * kind
            y[inside[0]] = 1 + 2 * kind
        sequences.append(tokens)
        labels.append(y)
    return sequences, labels


def train(table: list[tuple[str, list[Span]]] | None = None, steps: int = 60, rate: float = 0.15, l2: float = 1e-4) -> Field:
    """Maximum likelihood by forward-backward over the whole table and Adam steps."""
    sequences, labels = labelled(table or training_table())
    named = [[f for f in features(s)] for s in sequences]
    names: dict[str, int] = {}
    for fs in named:
        for f in fs:
            for x in f:
                names.setdefault(x, len(names))
    ids = np.array([[names[x] for x in f] for fs in named for f in fs])
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    n, width, k = len(lengths), int(lengths.max()), len(LABELS)
    row = np.repeat(np.arange(n), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gold = np.concatenate(labels)
    mask, start_mask = allowed_moves()
    live = np.zeros((n, width), bool)
    live[row, col] = True
    parts = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    inner = np.flatnonzero(col > 0)

    order = np.argsort(ids.ravel(), kind="stable")
    first = np.searchsorted(ids.ravel()[order], np.arange(len(names)))
    token = order // ids.shape[1]
    for step in range(1, steps + 1):
        weights, moves, starts = parts[0], np.exp(parts[1] + mask), np.exp(parts[2] + start_mask)
        scores = weights[ids].sum(axis=1)
        e = np.ones((width, n, k))
        e[col, row] = np.exp(scores - scores.max(axis=1, keepdims=True))
        alpha, beta, scale = np.zeros((width, n, k)), np.ones((width, n, k)), np.ones((width, n, 1))
        for t in range(width):  # each step's probabilities are scaled to 1
            a = (alpha[t - 1] @ moves if t else starts) * e[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        for t in range(width - 2, -1, -1):
            beta[t] = np.where(live[:, t + 1, None], (e[t + 1] * beta[t + 1] / scale[t + 1]) @ moves.T, 1.0)
        p = (alpha * beta)[col, row]
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(gold)), gold] -= 1
        g_weights = np.add.reduceat(p[token], first)
        right = np.where(live.T[1:, :, None], e[1:] * beta[1:] / scale[1:], 0.0)
        g_moves = np.einsum("tni,tnj->ij", alpha[:-1], right) * moves
        np.subtract.at(g_moves, (gold[inner - 1], gold[inner]), 1)
        g_starts = p[col == 0].sum(axis=0)
        for part, grad, (m, v) in zip(parts, (g_weights, g_moves, g_starts), moments, strict=True):
            grad = grad / n + l2 * part
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(names, parts[0], parts[1] + mask, parts[2] + start_mask)


@cache
def trained() -> Field:
    """The field of the standing table, trained once a session."""
    return train()


def sound(kind: int, tokens: list[tuple[str, int, int]]) -> bool:
    """Whether an added span holds up as what it is taken for."""
    numbers = [t for t, _, _ in tokens if t.isascii() and t.isdigit()]
    digits = "".join(numbers)
    words = [t.lower() for t, _, _ in tokens]
    if kind == 0:
        ats = [i for i, w in enumerate(words) if w in ("@", "at")]
        dots = [i for i, w in enumerate(words) if w in (".", "dot")]
        return len(ats) == 1 and bool(dots) and dots[-1] > ats[0] + 1 and words[-1] not in ("at", "dot") and words[-1].isalpha() and 2 <= len(words[-1]) <= 6 and words[0].isalnum() and words[0] not in ("at", "dot")
    if kind == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and byte(x) for x in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and not any(w.isalpha() for w in words) and luhn(digits)
    return 9 <= len(digits) <= 15 and 2 <= len(numbers) <= 6 and not any(w.isalpha() for w in words)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text round its triggers, in order and apart: REACH characters either side, the words they end in, and two words more."""
    out: list[list[int]] = []
    reached = -1
    for m in _TRIGGER.finditer(text):
        if (hi := m.end() + REACH) <= reached:
            continue  # within the last stretch, and so is all before it
        for k in range(3):
            space = _SPACE.search(text, min(hi, len(text)))
            reached = reached if k else space.start() if space else len(text)
            hi = space.end() if space else len(text)
        lo, floor = max(0, m.start() - REACH), out[-1][1] if out else 0
        for _ in range(3):
            while lo > floor and text[lo - 1].isspace():
                lo -= 1
            lo = max(floor, text.rfind(" ", floor, lo) + 1, text.rfind("\n", floor, lo) + 1) if lo > floor else lo
        if out and lo <= floor:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def added_spans(field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Sound spans that the field finds in each text, clear of base spans."""
    owner, sequences = [], []
    for k, text in enumerate(texts):
        for lo, hi in stretches(text):
            owner.append(k)
            sequences.append(field.read(text, lo, hi))
    found: list[list[Span]] = [[] for _ in texts]
    taken = [Taken(b) for b in base]
    for k, (starts, ends, _), labels in zip(owner, sequences, field.decode(sequences), strict=True):
        begins = np.flatnonzero(labels % 2 == 1)
        # A span goes on while tokens have the label inside of its kind: up to the next place where that stops.
        stops = np.append(np.flatnonzero((labels[1:] == 0) | (labels[1:] % 2 == 1) | (labels[1:] > labels[:-1] + 1) | (labels[1:] < labels[:-1])) + 1, len(labels))
        for i, j in zip(begins.tolist(), stops[np.searchsorted(stops, begins, side="right")].tolist(), strict=True):
            kind, start, end = int(labels[i]) // 2, int(starts[i]), int(ends[j - 1])
            tokens = [(texts[k][a:b], a, b) for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]
            if sound(kind, tokens) and not taken[k].meets(start, end):
                found[k].append((kind, start, end))
    return found


class Taken:
    """Base spans of a text, which can overlap between kinds: asked whether any of them meets another span."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts = np.array(sorted(s for _, s, _ in spans))
        self.ends = np.maximum.accumulate(np.array([e for _, _, e in sorted(spans, key=lambda x: x[1])], np.int64))

    def meets(self, start: int, end: int) -> bool:
        n = int(np.searchsorted(self.starts, end))  # spans that begin before the end
        return n > 0 and int(self.ends[n - 1]) > start


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row.

    The numbers and base_sha256 are of the pattern spans; spans has the
    field's as well. The field reads at least REACH characters, in whole words,
    either side of a digit, an at sign or a spelt-out sign. Both are written
    kind:start:end in code points, end exclusive, by kind as listed and then
    start. A null text counts as empty; long ones are decoded in pieces.
    Repeated or null ids give a row each time; other columns are not read; an
    empty table gives an empty result. Nothing is shuffled.
    """
    field = field or trained()
    if field.margin() <= 0:
        raise ValueError("the field is too unsure about plain words to skip them")
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for part in slices(batches):
            column = pc.fill_null(part.column("text"), "")
            some = np.flatnonzero(pc.match_substring_regex(column, _ANY).to_numpy(zero_copy_only=False))
            counts = np.zeros((4, part.num_rows), np.int64)
            shas, spans = [nothing] * part.num_rows, [""] * part.num_rows
            texts = column.take(pa.array(some)).to_pylist()
            base = [base_spans(t) for t in texts]
            for k, own, more in zip(some.tolist(), base, added_spans(f, texts, base), strict=True):
                for kind, _, _ in own:
                    counts[kind, k] += 1
                if own:
                    shas[k] = hashlib.sha256(written(own).encode()).hexdigest()
                spans[k] = written(sorted(own + more))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in counts], pa.array(shas), pa.array(spans)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
