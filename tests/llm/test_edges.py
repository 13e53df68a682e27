"""Operators against plain versions written from their rules, and rows that ask for care."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, near
from tests.llm.test_texts import SF, empty, fold

M64 = (1 << 64) - 1
#: Names that operators use for columns of their own.
NAMES = ["near_id", "near_name", "near_id_", "gone_id", "near_repeat", "marked_at", "mix_id", "mix_source", "mix_position", "node", "name", "at", "cell", "strong", "weak", "row", "held_out", "score", "Source_"]


def table(n=6000):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).slice(0, n)
    return list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ids with several texts, and clashing names."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, "one text of some length that is not like others at all", "a"), (2, "one text of some length that is not like others at all", "a"), (2, "here is something wholly different that nobody else says", None)]
    rows += [(3, None, "b"), (4, "", "b"), (None, "no id here but words enough to make a shingle or two", "b"), (None, None, None), (5, long, "a"), (6, long + " more", "b"), (7, "twice the same row with words", "a"), (7, "twice the same row with words", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for k, c in enumerate(NAMES):
        df = df.withColumn(c, F.lit(k))
    return df.withColumn("nothing", F.lit(None).cast("int")).withColumn("n_chars", F.length("text")).cache()


def test_one_row_of_a_group_stays_whatever_its_id(odd):
    from tessera.llm.near import keep_one

    kept = keep_one(odd, 5, 80)
    assert kept.columns == odd.columns
    got = Counter((r["doc_id"], (r["text"] or "-")[:12]) for r in kept.collect())
    assert got == Counter([(1, "one text of "), (2, "here is some"), (3, "-"), (4, "-"), (None, "no id here b"), (None, "-"), (5, "w0 w1 w2 w3 "), (7, "twice the sa")])
    assert [tuple(r[c] for c in NAMES) for r in kept.collect()] == [tuple(range(len(NAMES)))] * 8


def test_stages_keep_odd_rows_and_columns(spark, odd):
    import corpus_pipeline
    from tessera.llm.mixing import arrange
    from tessera.llm.quality import keep_good
    from tessera.llm.secrets import redact

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for found in (arrange(odd), redact(odd), keep_good(odd, labels.limit(0))):
        assert found.columns == odd.columns
        assert Counter(map(str, found.collect())) == Counter(map(str, odd.collect()))
    docs = odd.withColumn("lang", F.lit("en"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


def mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 32


def joined(a, b):
    return mixed((a * 0x9E3779B97F4A7C15 + (b ^ 0xC2B2AE3D27D4EB4F)) & M64)


def plain_features(text):
    tokens = re.findall(rb"[^ \t\n\x0b\x0c\r]+", (text or "").encode())
    word = [xxhash.xxh3_64_intdigest(bytes(c + 32 if 65 <= c <= 90 else c for c in t), 1) for t in tokens]
    classes = [bytes(b"A"[0] if 65 <= c <= 90 else b"9"[0] if 48 <= c <= 57 else b"a"[0] if 97 <= c <= 122 or c >= 128 else c for c in t) for t in tokens]
    shape = [xxhash.xxh3_64_intdigest(re.sub(rb"(?s)(.)\1+", rb"\1", c), 2) for c in classes]
    hashes = word + [joined(a, b) for a, b in zip(word, word[1:], strict=False)] + [mixed(s) for s in shape]
    hashes += [joined(joined(shape[k], shape[k + 1]), int(word[k] == word[k + 1])) for k in range(len(shape) - 1)]
    values = {b: math.log1p(n) for b, n in Counter(h >> 44 for h in hashes).items()}
    norm = math.sqrt(sum(v * v for v in values.values())) if values else 1
    return {b: v / norm for b, v in values.items()}


def test_classifier_equals_plain_ftrl(spark):
    from tessera.llm.quality import score, train

    texts = dict(table(60))
    labels = {i: int(len(texts[i] or "") % 3 > 0) for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("score", F.lit("x"))
    weights = train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), updates=150)
    z, n, known = defaultdict(float), defaultdict(float), {i: plain_features(t) for i, t in texts.items()}

    def weight(b):
        return 0.0 if abs(z[b]) <= 0.02 else (math.copysign(0.02, z[b]) - z[b]) / ((1 + math.sqrt(n[b])) / 0.3 + 0.1)

    order = sorted((i for i in texts if fold(i) != 0), key=lambda i: xxhash.xxh3_64_intdigest(str(i).encode(), 3))
    for _ in range(-(-150 // len(order))):
        for i in order:
            x = {b: float(np.float32(v)) for b, v in known[i].items()} | {"bias": 1.0}
            w = {b: weight(b) for b in x}
            miss = 1 / (1 + math.exp(-sum(w[b] * v for b, v in x.items()))) - labels[i]
            for b, v in x.items():
                g = miss * v
                z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / 0.3 * w[b]
                n[b] += g * g
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in score(docs, weights).collect()}
    for i, x in known.items():
        expected = 1 / (1 + math.exp(-sum(weight(b) * v for b, v in x.items()) - weight("bias")))
        assert abs(got[i][0] - expected) < 1e-5
        assert got[i][1] == int(got[i][0] >= 0.3)


def test_scores_do_not_depend_on_the_batch():
    from tessera.llm import quality

    texts = [t for _, t in table(120)]
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    together = quality.probability(pa.array(texts, pa.string()), weights)
    assert together.tolist() == [quality.probability(pa.array([t], pa.string()), weights)[0] for t in texts]


def test_a_label_of_an_id_with_many_rows(spark):
    from tessera.llm.quality import train

    learnt = next(i for i in range(100) if fold(i) != 0)
    many = spark.createDataFrame([(learnt, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(learnt, 1)], "doc_id long, quality int")
    assert any((train(many, labels, updates=3) == train(many.where(F.col("text") == f"text {k}"), labels, updates=3)).all() for k in range(50))


# The patterns as they are stated.
PLAIN = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    def check(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    good = [lambda m: True, lambda m: max(map(int, m[0].split("."))) <= 255, lambda m: 16 <= len(digits(m)) <= 19 and check(digits(m)), lambda m: 8 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k in range(4) for m in PLAIN[k].finditer(text) if good[k](m)]


def test_personal_patterns_equal_plain_ones():
    from tessera.llm import pii

    rng, found = random.Random(2), 0
    for k in range(20_000):
        text = "".join(rng.choice(["a@.", "1.2", "ab1@.+-_% ", "0123456789 -.+()", "é1@a._"][k % 5]) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text)
        found += len(plain_spans(text))
    for _, text in table():
        assert pii.base_spans(text or "") == plain_spans(text or "")
    assert found > 1000
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(1, 0, 5007)]


def test_personal_patterns_read_long_runs_once():
    from tessera.llm import pii

    began = time.time()
    for text in ("1" * 10**6 + ".", "a" * 10**6 + "@", "1." * 300_000, "+1" + " " * 10**6, "a@" * 300_000):
        pii.base_spans(text)
    assert time.time() - began < 15


def test_reading_round_triggers_equals_reading_all(monkeypatch):
    from tessera.llm import pii

    field = pii.train()
    texts = [t for _, t in table() if t and len(t) < 3000] + [t for t, _ in pii.training_table(300, 5)] + ["z " * 60 + t + " q" * 60 for t, _ in pii.training_table(100, 6)]
    base = [pii.base_spans(t) for t in texts]
    cut = pii.added_spans(field, texts, base)
    monkeypatch.setattr(pii, "stretches", lambda t: [(0, len(t))])
    assert cut == pii.added_spans(field, texts, base)
    assert sum(map(len, cut)) > 300


def test_names_of_any_length_are_found():
    from tessera.llm import pii

    field, rng = pii.trained(), random.Random(4)
    name = lambda n: "".join(rng.choice("bcdfghlmnprst") for _ in range(n))
    texts = [f"write to {name(n)} [at] {name(6)} [dot] com today" for n in range(1, 301)]
    texts += [f"write to{sep}{name(n)}[at]example[dot]com today" for n in (40, 80, 300) for sep in (" ", "\n", "\t")]
    texts += [f"write to {'.'.join(name(2) for _ in range(n))} [at] exam [dot] com" for n in (2, 5, 11, 30, 100)]
    found = pii.added_spans(field, texts, [[] for _ in texts])
    for text, spans in zip(texts, found, strict=True):
        assert [text[s:e].split(" [at]")[0].split("[at]")[0] for _, s, e in spans] == [text.split("[at]")[0].split()[-1]]


def test_stretches_hold_whole_words_and_two_more():
    from tessera.llm import pii

    text = "x " * 100 + "aa bb " + "c" * 200 + " [at] " + "d" * 200 + " ee ff gg" + " y" * 100
    ((lo, hi),) = pii.stretches(text)
    assert text[lo:hi].split() == ["x" if lo < text.index("aa") else "aa", *text[lo:hi].split()[1:]]
    assert lo <= text.index("aa") and hi >= text.index("gg")
    for t in ("", "1", "[at]", "1" * 500, "a" * 500 + "1" + "b" * 500, " " * 500 + "1" + " " * 500):
        assert all(0 <= a < b <= len(t) for a, b in pii.stretches(t))


def test_pieces_of_long_stretches_equal_the_whole(monkeypatch):
    from tessera.llm import pii

    field = pii.trained()
    text = " ".join(t for t, _ in pii.training_table(150, 8))
    spans = pii.added_spans(field, [text], [[]])
    monkeypatch.setattr(pii, "stretches", lambda t: [(0, len(t))])
    assert pii.added_spans(field, [text], [[]]) == spans
    monkeypatch.setattr(pii, "PIECE", 1 << 30)
    assert pii.added_spans(field, [text], [[]]) == spans and len(spans[0]) > 100


def test_viterbi_equals_all_paths():
    from itertools import product

    from tessera.llm import pii

    field, rng = pii.trained(), np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 5])
    scores = rng.normal(0, 3, (lengths.sum(), len(pii.LABELS)))
    got, at = field.viterbi(scores, lengths), 0
    for labels, n in zip(got, lengths, strict=True):
        own, at = scores[at : at + n], at + n
        value = lambda path: field.starts[path[0]] + sum(own[k, p] for k, p in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        best = max(product(range(len(pii.LABELS)), repeat=int(n)), key=value)
        assert tuple(labels) == best


def test_numbers_without_end_take_bounded_memory():
    import tracemalloc

    from tessera.llm import pii

    field, text = pii.trained(), "12 34, " * 300_000
    tracemalloc.start()
    began = time.time()
    pii.added_spans(field, [text], [[]])
    assert time.time() - began < 60
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # of 2.1 MB and 900,000 tokens
    tracemalloc.stop()


def steps(ratio):
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


def test_model_scores_equal_a_model_without_filter(spark):
    """Witten-Bell over exact pairs with counts rounded down to the same steps; probes may say yes too often only."""
    from tessera.llm import lm

    rows = table()
    fine, coarse = steps(1.25), steps(1.5)
    down = lambda n, t: t[int(np.searchsorted(t, n, side="right")) - 1] if n else 0
    split = lambda t: ["<", *(t or "").encode().lower().split(), ">"]
    words, pairs = Counter(), Counter()
    for i, t in rows:
        if fold(i) != 1:
            w = split(t)
            words.update(w[1:])
            pairs.update(zip(w, w[1:], strict=False))
    after, kinds = Counter(), Counter()
    for (a, _), n in pairs.items():
        after[a] += down(n, coarse)
        kinds[a] += 1
    total = sum(down(n, fine) for n in words.values())

    def log_p(a, b):
        unit = (down(words[b], fine) + 0.5) / (total + 0.5 * (len(words) + 1))
        if not after[a]:
            return math.log10(unit)
        most = fine[int(np.searchsorted(fine, after[a], side="right"))] - 1
        return math.log10((min(down(pairs[a, b], coarse), most) + down(kinds[a], fine) * unit) / (most + down(kinds[a], fine)))

    got = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = []
    for i, t in rows:
        w = split(t)
        off.append((got[i][0] - sum(log_p(a, b) for a, b in zip(w, w[1:], strict=False))) / got[i][1])
    assert np.mean(np.abs(off)) < 0.02
    assert np.quantile(np.abs(off), 0.9) < 0.06


def test_repeats_beside_a_frequent_anchor(spark, monkeypatch):
    """Windows of one anchor string are ordered offset by offset when there are many."""
    from tessera.llm import repeats

    rng = random.Random(9)
    core = "".join(rng.choice("abcdef") for _ in range(44))
    texts = [(i, "".join(rng.choice("uvwxyz") for _ in range(30 + i % 7)) + rng.choice("pq") + rng.choice("rs") + core + rng.choice("mn") + rng.choice("mn") + rng.choice("jkl") + "".join(rng.choice("ghi") for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def found():
        return sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.deduplicate(docs).collect())

    plain = found()
    first = {}
    for i, t in texts:
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    for (i, t), (_, n, _, _) in zip(texts, plain, strict=True):
        gone = {p for s in range(len(t) - 49) if first[t[s : s + 50]] < i for p in range(s, s + 50)}
        assert len(gone) == n
    assert sum(n > 0 for _, n, _, _ in plain) > 300
    whole = repeats.windows_of
    monkeypatch.setattr(repeats, "windows_of", lambda r: whole(r, 50))
    assert found() == plain


def test_repeats_of_a_passage_that_one_document_holds_several_times(spark):
    """Every place loses what an earlier document has a part of, not only the first place."""
    from tessera.llm import repeats

    rng = random.Random(4)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(20)]
    texts = [(k, p[: 60 + 5 * k]) for k, p in enumerate(passages)] + [(100 + k, f"-{p}-{p}+{p[5:]}") for k, p in enumerate(passages)] + [(100, f"+{passages[1]}+{passages[1]}")]
    first = {}
    for i, t in texts:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(i, first.get(t[s : s + 50], i))
    expected = [(i, len({p for s in range(len(t) - 49) if first[t[s : s + 50]] < i for p in range(s, s + 50)})) for i, t in texts]
    got = [(r["doc_id"], r["n_removed"]) for r in repeats.deduplicate(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(expected)


def test_marked_rows_lose_none(spark):
    from tessera.llm.common import marked_rows

    rows = spark.range(5000).select("id", F.col("id").alias("marked_at"))
    some, rest = marked_rows(rows, rows.where("id % 3 = 0").select("id"), ["id"])
    assert some.count() + rest.count() == 5000
    assert rest.where("id % 3 = 0").count() == 0
    assert rest.count() > 2500
    some, rest = marked_rows(rows, rows.limit(0).select("id"), ["id"])
    assert (some.count(), rest.count()) == (0, 5000)
    assert empty(spark).count() == 0


@pytest.mark.parametrize("size", [1e-200, 1e200])
def test_links_of_tiny_and_huge_vectors(spark, size):
    from tessera.llm import embeddings

    rows = [(1, [size, 0.0]), (2, [size, size / 100]), (3, [0.0, size])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(1, 1), (1, 1), (0, 3)]


def test_share_of_blocks_that_the_tables_let_be_skipped(capsys):
    """The made-up embeddings point anywhere: bounds skip next to nothing there, which README says with these figures."""
    from tessera.llm import embeddings, topk

    found = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")["embedding"].to_pylist()
    x = np.array(found, float)
    blocks = topk.Blocks(np.arange(len(x)), np.floor(1024 * x))
    for k in range(0, len(x), 100):
        blocks.best(k, np.floor(1024 * x[k]), 10)
    scored = blocks.scored / (len(range(0, len(x), 100)) * (len(blocks.edges) - 1))
    unit = embeddings.normed(x)
    _, turned = np.linalg.eigh(np.cov(unit.T))
    place = unit @ turned[:, ::-1][:, :8]
    epsilon = math.sqrt(0.1)
    place = place[np.lexsort(np.floor(place / epsilon).T[::-1])]
    boxes = [embeddings.box(place[k : k + 16]) for k in range(0, len(place), 16)]
    near = [(np.maximum(np.maximum(a[0] - b[1], b[0] - a[1]), 0) ** 2).sum() <= epsilon**2 for i, a in enumerate(boxes) for b in boxes[i:]]
    with capsys.disabled():
        print(f"\nblocks scored {scored:.3f}, pairs of runs joined {np.mean(near):.3f}")
    assert 0 < scored <= 1
    assert 0 < np.mean(near) <= 1


def test_patterns_that_cut_elsewhere_are_refused():
    import public_tokenizers as P

    from tessera.llm.bpe import Codec, parse_ranks

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = parse_ranks(f.read())
    assert Codec(ranks, P.PATTERN).short
    with pytest.raises(ValueError, match="white space"):
        Codec(ranks, r"\w+\s*|.")
    whole = Codec(ranks, r"\s*\S+|\s+")
    assert not whole.short
    assert whole.words(b" word.") == [b" word."]


def test_written_tables_can_be_deleted(spark, tmp_path):
    from tessera.llm.common import Scratch, clean_up

    one = Scratch(spark, "gone")
    one.keep(spark.range(3), "rows")
    assert clean_up() >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{one.root}/rows")


def test_near_long_lists_are_cut_by_size_of_set(spark):
    rows = [(k, 7 + (5 << 32), k + 1, 1) for k in range(400)]  # node, list, n, weight
    cut = near.banded(spark.createDataFrame(rows, "node long, group long, n long, weight int"), 85).collect()
    held = {}
    for r in cut:
        assert r["group"] % 2**near.BAND == 7 + (5 << 32)
        held.setdefault(r["group"], set()).add(r["node"])
    together = {(a, b) for nodes in held.values() for a in nodes for b in nodes if a < b}
    assert all((a, b) in together for a in range(400) for b in range(a + 1, 400) if 100 * (a + 1) >= 85 * (b + 1))
    assert len(cut) == 800 and len(together) < 0.4 * 400 * 399 / 2


def test_near_fetches_the_sets_of_members_only(spark, tmp_path):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(9))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = common.Scratch(spark, "sets-test")
    members = scratch.keep(near.signatures(docs, 3, 11).where("doc_id < 300").select("node", F.col("doc_id").alias("doc")), "members")
    got = near.fetch_sets(docs, members, 3, scratch, "sets").select("doc").toPandas()["doc"]
    assert set(range(300)) <= set(got) and len(got) < 330  # 16 bits a member by id alone let one other in 10 through


def test_near_second_meeting_moves_only_the_sets_that_are_asked_for(spark, monkeypatch):
    """Small units have met when parts of large ones meet once more."""
    monkeypatch.setattr(near, "UNIT", 8)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words[: 57 - k % 3], f"end{k}"])) for k in range(40)]
    rows += [(1000 + 2 * k + j, " ".join([*(f"p{k}x{i}" for i in range(60)), f"e{j}"])) for k in range(300) for j in range(2)]
    seen = []
    monkeypatch.setattr(near, "marked_rows", lambda rows, marked, key, **how: seen.append((key, marked.count())) or common.marked_rows(rows, marked, key, **how))
    label = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["component_id"] for r in label.where("doc_id < 1000").collect()} == {0}
    assert label.where("doc_id >= 1000 and component_id = doc_id").count() == 300
    assert all(n <= 40 for key, n in seen if key == ["node"])
    assert any(key == ["node"] for key, _ in seen)


def test_near_looks_up_a_node_once_for_all_lists_that_it_is_in(spark, monkeypatch):
    """Long lists hold a node up to 2 * prefix times; labels are joined to nodes and not to those entries."""
    monkeypatch.setattr(near, "LIST", 8)
    monkeypatch.setattr(near, "UNIT", 8)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words[: 57 - k % 3], f"end{k}"])) for k in range(40)]
    made, keep = {}, common.Scratch.keep

    def kept(self, df, name, by=None):
        made[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = keep(self, df, name, by)
        if name == "own":
            assert out.count() == out.select("node").distinct().count() <= 40
        return out

    monkeypatch.setattr(common.Scratch, "keep", kept)
    label = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["component_id"] for r in label.collect()} == {0}
    assert "own" in made and "LeftOuter" in made["own"]
    assert not any("LeftOuter" in made[name] for name in ("more-pairs", "more-tiles"))


def test_filter_keeps_the_bits_of_a_probe_in_one_line():
    from tessera.llm import lm

    rng = np.random.default_rng(3)
    key, level = rng.integers(0, 2**63, 40_000, dtype=np.uint64), rng.choice([1, 2, 5], 40_000)
    one = lm.Filter.empty(3, 8192)
    one.enter(1, key[:1], np.array([1]))
    on = np.flatnonzero(one.flat)
    assert 1 <= len(on) <= lm.HASHES and len(set(on // 64)) == 1 and 8192 <= on[0] < 16384
    full = lm.Filter.empty(2, int(level.sum()) * lm.ENTRY_BITS // 8)
    full.enter(1, key, level)
    assert (full.level(np.ones(len(key), np.int64), key) >= level).all()
    assert (full.level(np.ones(100_000, np.int64), rng.integers(0, 2**63, 100_000, dtype=np.uint64)) > 0).mean() < 0.03
    assert not full.level(np.zeros(100, np.int64), key[:100]).any()


def test_filter_asks_once_for_items_of_several_levels(monkeypatch):
    from tessera.llm import lm

    monkeypatch.setattr(lm, "KEPT", 1 << 12)
    rng = np.random.default_rng(4)
    key, level = rng.integers(0, 2**63, 2_000, dtype=np.uint64), rng.choice([1, 2, 9], 2_000)
    part = rng.integers(0, 2, 2_000)
    full = lm.Filter.empty(2, int(level.sum()) * lm.ENTRY_BITS // 8)
    for s in range(2):
        full.enter(s, key[part == s], level[part == s])
    plain, asked, ask = full.level(part, key), [], lm.Filter.level
    monkeypatch.setattr(lm.Filter, "level", lambda self, part, key: asked.append(len(key)) or ask(self, part, key))
    for _ in range(3):
        assert (full.recalled(part, key) == plain).all()
    assert (full.recalled(1 - part, key) == ask(full, 1 - part, key)).all()
    assert asked[0] == 2_000 and asked[1] < 0.6 * 2_000
