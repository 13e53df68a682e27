"""Manifest, alignment and page operators against plain versions written from their rules."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with nulls in any column, repeated rows, ids with several texts, a long text and clashing names."""
    odd = [(10**7, None, "en", 1, "a\nb"), (10**7, "", None, None, None), (10**7, "é", "en", 3, ""), (None, None, None, None, "x"), (10**7 + 1, "é", "en", 5, "twice\n"), (10**7 + 1, "é", "en", 5, "twice\n"), (10**7 + 1, "é", "en", 5, "other")]
    odd += [(10**7 + 2, "long", "de", 9, "wort für wort\n" * 30_000), (10**7 + 3, "long", "de", 9, " ▁ two  spaces <s> <|endoftext|>　日本語 😀 ")]
    frame = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in DOC.split(", ")]).unionByName(spark.createDataFrame(odd, DOC))
    for k, c in enumerate(["g", "i", "n", "h", "leaf", "checked", "part", "place", "pairs", "bucket", "items"]):
        frame = frame.withColumn(c, F.lit(k))
    return frame.cache()


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        lo = i // 3 * 3
        run = level[lo : lo + 3]
        yield run[: i - lo], run[i - lo + 1 :]
        i //= 3


def plain_manifest(rows):
    def leaf(d, s, lang, n, t):
        return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, lang, n, t)))

    def altered(d, t):
        return t if t is None or d is None or zlib.crc32(str(d).encode()) % 2 else t.replace("\n", "")

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: tree([leaf(*r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root = top[-1][0]
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            now = leaf(*r[:4], altered(r[0], r[4]))
            for lo, hi in path:
                now = digest(*lo, now, *hi)
            yield (r[0], leaf(*r), trees[s][-1][0], root, digest(*[h for lo, hi in path for h in lo + hi]), now, now == root)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_plain_trees(docs, levels):
    from tessera.llm.merkle import audit

    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in audit(docs, levels).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_of_no_rows(spark):
    from tessera.llm.merkle import audit, manifest

    one = spark.createDataFrame([(7, "s", "en", 3, "abc")], DOC)
    row = audit(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == digest("1:71:s2:en1:33:abc") and row["proof_sha256"] == digest("") and row["verified"]
    assert audit(one.limit(0)).count() == 0
    assert manifest(one.limit(0)).columns == manifest(one).columns


def test_many_sources_share_a_tree(spark):
    """Sources by the hundred, one of which has most rows; bucket and partition bounds fall anywhere."""
    from tessera.llm.merkle import audit

    rows = [(k, f"s{k % 400}" if k % 3 else "hot", "en", k, f"t{k}\n") for k in range(2000)]
    got = sorted(map(tuple, audit(spark.createDataFrame(rows, DOC), 2).collect()))
    assert got == sorted(plain_manifest(rows))


def plain_alignment(rows, a_path, b_path):
    """The rule word by word: whole texts by the libraries, sets of ends, counters."""
    import json

    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    entries = {i: t for t, i in json.load(open(a_path))["model"]["vocab"].items()}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}

    def a_bytes(i):
        return bytes(back[c] for c in entries[i])

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    done, count = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            both = [(a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)]
            if all(b"".join(map(f, ids)) == (" " + text).encode() for ids, f in both):
                ends = []
                for ids, f in both:
                    at, n = {}, 0
                    for i in ids:
                        n += len(f(i))
                        at[n] = i
                    ends.append(at)
                bounds = sorted(ends[0].keys() & ends[1].keys())
                for lo, hi in zip([0, *bounds[:-1]], bounds, strict=True):
                    groups.append(tuple([i for e, i in side.items() if lo < e <= hi] for side in ends)) if len(bounds) < 300 else groups.append((lo, hi))
                if len(bounds) >= 300:  # the same by one walk
                    walks = [iter(side.items()) for side in ends]
                    groups = []
                    for hi in bounds:
                        sides = []
                        for w in walks:
                            side = []
                            for e, i in w:
                                side.append(i)
                                if e == hi:
                                    break
                            sides.append(side)
                        groups.append(tuple(sides))
        links = [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        done.append((doc_id, groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for doc_id, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest(text) if text else "")


def test_alignment_equals_plain_version(spark, docs):
    import random

    import public_tokenizers as P

    from tessera.llm.align import align

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rng = random.Random(5)
    more = ["".join(rng.choice(list("abtheron  \n\t.,'é12　 ") + ["日本", "😀", "▁", "ﬁ", "\x00", "é", " the ", "<s>", "</s>", "<|endoftext|>", "<0x0A>"]) for _ in range(120)) for _ in range(150)]
    more += [" ", "  ", "a ", "a  ", "\n", "▁", "x▁y", "a" * 5000, "don't we'll", " lead", "​ x", "١٢٣ ٤"]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(2 * 10**7 + k, t) for k, t in enumerate(more)], "doc_id long, text string")).repartition(3)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in align(frame.withColumn("pairs", F.lit(1)), *paths).select(names).collect()]
    want = list(plain_alignment([tuple(r) for r in frame.collect()], *paths))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    texts = align(frame, *paths, groups=True).where("groups_sha256 <> ''").select("groups", "groups_sha256").collect()
    assert texts and all(digest(r["groups"]) == r["groups_sha256"] for r in texts)
    assert align(frame.limit(0), *paths).count() == 0


#: What stands around an article: by element, by class, by link density, and by being the same in all pages.
SHELLS = {
    "elements": "<!doctype html><html><head><title>{t} | Site</title><style>p{{}}</style><script>var a = '</p><p>no';</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/{k}>menu {k}</a><li><a>more</a></ul></nav><!-- <p>no</p> --><main><aside>aside {k}</aside><article>{a}<footer>by line {k}</footer></article><form><p>mail {k}</p></form></main><section><article class='comment'><p>a reader says {k}</p></article></section><footer>&copy; {k}</footer>",
    "classes": "<html><body class='has-sidebar'><div id=top-banner><p>buy {k}</p></div><div class='cookie-notice'>we bake {k}</div><div class=post>{a}</div><div class='userComments'><p>first! {k}</p></div><div class=rightSidebar><p>side {k}</p></div><div style='display: none'>unseen {k}</div></body></html>",
    "plain": "<html><body><div class=x1><a href=1>news {k}</a> <a href=2>sport {k}</a></div><div class=x2>{a}<p>Share this with all your friends</p></div><div class=x3><p>About us and what we do</p><a href=3>contact {k}</a></div></body></html>",
}


def site(shell, k):
    words = [f"w{(k * 31 + j * 7) % 97}" for j in range(40)]
    body = [f"Title {k}", " ".join(words[:15]) + " &amp; x<b>y</b>&#233;", " ".join(words[15:])]
    html = f"<h1>{body[0]}</h1><p>{body[1]}\n<p>{body[2]}<br>end\t {k}</p>"
    text = f"Title {k} {' '.join(words[:15])} & xyé {body[2]} end {k}"
    return SHELLS[shell].format(t=body[0], k=k, a=html), text


@pytest.fixture(scope="module")
def sites(spark):
    rows, want = [], {}
    for n, shell in enumerate(SHELLS):
        for k in range(12):
            html, text = site(shell, k)
            rows.append((100 * n + k, f"http://{shell}.example/{k}", html))
            want[100 * n + k] = text
    odd = [(900, None, None), (901, "http://one.example/", ""), (902, "nonsense", "just text"), (903, "http://b.example/", "<p>a<div>b</div>c"), (904, "http://b.example/", "<article><p>open <b>ends"), (905, "http://b.example/x", "<script>x"), (906, "http://b.example/y", '<p title="a>b" x=\'>\'>q &lt;i&gt; &nbsp; z'), (907, "http://b.example/z", "<article>" + "<p>long text\n</p>" * 20_000 + "</article>")]
    odd += [(908, "http://twice.example/", "<p>same</p>")] * 5
    want |= {900: "", 901: "", 902: "just text", 903: "a b c", 904: "open ends", 905: "", 906: "q <i> z", 907: " ".join(["long text"] * 20_000), 908: "same"}
    frame = spark.createDataFrame(rows + odd, "page_id long, url string, html string").repartition(5)
    for k, c in enumerate(["host", "weight", "token", "text", "n_chars", "template", "kind"]):
        frame = frame.withColumn(c, F.lit(k))
    return frame.cache(), want


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_pages_give_their_articles(sites, monkeypatch, most):
    """Templates sent to all workers, and joined to their hosts' pages."""
    from tessera.llm import pages

    monkeypatch.setattr(pages, "MOST_SENT", most)
    frame, want = sites
    got = pages.extract(frame).collect()
    assert len(got) == frame.count()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert pages.extract(frame.limit(0)).count() == 0


def test_templates_hold_a_hosts_tokens(spark, sites):
    """The class of all pages has the skeleton and the text that never changes; a copied article is not the template's."""
    from tessera.llm import pages
    from tessera.llm.common import Scratch

    frame, _ = sites
    rows = frame.where("url is not null").select("html", F.regexp_extract("url", "//([^/]*)", 1).alias("host")).withColumn("weight", F.xxhash64("html"))
    found = pages.deduce(rows, Scratch(spark, "t")).where("host = 'plain.example'").collect()
    template = pages.templates_of(pa.Table.from_pylist([r.asDict() for r in found]))["plain.example"]
    blocks = pages.parsed(site("plain", 3)[0])[1]
    assert [b.text for b in blocks if b.token in template.same] == ["Share this with all your friends", "About us and what we do"]
    copies = spark.createDataFrame([(k, f"http://c.example/{k}", site("elements", 5)[0]) for k in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in pages.extract(copies).collect()} == {site("elements", 5)[1]}


def test_alignment_remembers_units_that_come_again(monkeypatch):
    from tessera.llm import align

    monkeypatch.setattr(align, "UNITS_KEPT", 12)
    asked = []
    side = align.Tokenizer([bytes([k]) for k in range(256)], lambda units: asked.extend(units) or [list(u.encode()) for u in units])
    common = [f" often{k}".encode() for k in range(4)]
    for run in range(30):
        units = [*common, *(f" once{run}x{k}".encode() for k in range(5))]
        got = side.learn(units)
        assert [np.frombuffer(x, np.int32).astype(np.uint8).tobytes() for x in got] == units
        assert len(side.known) <= 12
    assert all(asked.count(u.decode()) == 1 for u in common) and len(asked) == 4 + 30 * 5


def test_alignment_takes_one_core_a_task(monkeypatch):
    import os

    import public_tokenizers as P

    from tessera.llm.align import byte_level

    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    byte_level(P.path("byte_bpe_50k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
