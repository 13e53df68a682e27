"""The pipeline against a plain version of its stages."""

import hashlib
import re
from pathlib import Path

import corpus_pipeline
from tests.llm.test_texts import ASSIGN, SF, brute_components


def redacted(text):
    """Strong secrets taken out; weak parts of credentials don't occur in these documents."""
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_run_equals_plain_stages(spark):
    import public_tokenizers as P
    import tiktoken

    from tessera.llm.bpe import parse_ranks
    from tessera.llm.quality import classify

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in classify(docs, labels).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    kept = {d for d, _, c in brute_components(rows, 5, 80) if d == c}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(Path(P.path("byte_bpe_multi_50k.tiktoken")).read_bytes()), special_tokens={})
    expected = {d: hashlib.sha256(",".join(map(str, enc.encode_ordinary(redacted(t)))).encode()).hexdigest() for d, t in rows if d in kept}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
