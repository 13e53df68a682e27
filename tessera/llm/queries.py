"""The queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log probabilities of every document, learnt outside the held-out fold."""
    from tessera.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op2_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings of earlier documents."""
    from tessera.llm.repeats import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op3_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector, exactly."""
    from tessera.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and decision for every document, learnt from labels outside the held-out fold."""
    from tessera.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, 85 % alike."""
    from tessera.llm.near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, least=85)


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: patterns and what the field adds."""
    from tessera.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mixture of sources by tempered shares."""
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    from tessera.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: strong patterns and linked parts of credentials."""
    from tessera.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("secrets")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and of decoded bytes, for every document."""
    import public_tokenizers

    from tessera.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document, half of them tampered with."""
    from tessera.llm.merkle import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's template."""
    from tessera.llm.pages import extract

    return extract(table(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of a byte-level BPE and a sentencepiece model, for every document."""
    import public_tokenizers

    from tessera.llm.align import align

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bloom_lm, op2_suffix_radix, op3_block_top_k, op4_quality_ftrl, op5_minhash_join, op6_pii_crf, op7_pfair_mixing, op8_grid_order_join, op9_secret_links, op10_byte_bpe, op11_merkle_manifest, op12_page_templates, op13_token_alignment)}


_VECTORS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) x FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e IS NULL OR NOT isfinite(e))) = 0)"""


def _leaf(text: str) -> str:
    """SQL for a document's leaf with this column as its text."""
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _decoded(text: str) -> str:
    """SQL for a text with the character references of the test tables decoded."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = {
    "op2_suffix_radix": """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) s FROM h, LATERAL (SELECT unnest(range(len(h) // 2 - 49)) i)),
f AS (SELECT s, min(doc_id) least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) before FROM w JOIN f USING (s) WHERE doc_id > least),
t AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) k FROM g),
u AS (SELECT doc_id, k, min(i) a, max(i) + 50 b FROM t GROUP BY 1, 2),
v AS (SELECT doc_id, sum(b - a) n, count(*) k, list(a ORDER BY a) starts, list(b ORDER BY a) ends FROM u GROUP BY 1),
o AS (SELECT h.doc_id, h, coalesce(n, 0) n, coalesce(k, 0) k, list_concat([0], coalesce(ends, [])) x, list_concat(coalesce(starts, []), [len(h) // 2]) y FROM h LEFT JOIN v USING (doc_id))
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS n_removed, CAST(k AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(x, lambda p, j: substr(h, 2 * p + 1, 2 * (y[j] - p))), ''))) AS kept_sha256 FROM o""",
    "op5_minhash_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id node, doc_id reach FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT node, min(reach) m FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM documents d JOIN m ON d.doc_id = node LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op3_block_top_k": f"""WITH {_VECTORS}, w AS (SELECT vec_id, list_transform(x, lambda e: floor(1024 * e)) x FROM v),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) score FROM w q JOIN w c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op7_pfair_mixing": """WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') source, count(*) copies FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 rank FROM d),
c AS (SELECT source, count(*) n, pow(CAST(count(*) AS DOUBLE), 0.5) w FROM d GROUP BY source),
i AS (SELECT source, n, w / sum(w) OVER () * 1000 ideal, row_number() OVER (ORDER BY source) - 1 i, count(*) OVER () k FROM c),
f AS (SELECT *, greatest(1, floor(ideal)) fl, 1000 - sum(greatest(1, floor(ideal))) OVER () left_over FROM i),
o AS (SELECT *, row_number() OVER (ORDER BY fl - ideal, i) pos, row_number() OVER (ORDER BY fl DESC, i) big FROM f),
p AS (SELECT source, n, i, CAST(fl + CASE WHEN left_over > 0 THEN floor((left_over - pos + k) / k) WHEN big = 1 THEN left_over ELSE 0 END AS BIGINT) parts FROM o),
l AS (SELECT list(parts ORDER BY i) parts FROM p),
s AS (SELECT CAST(-1 AS BIGINT) t, list_transform(parts, lambda x: CAST(0 AS BIGINT)) counts, CAST(0 AS BIGINT) pick, parts FROM l
  UNION ALL
  SELECT t + 1, list_transform(counts, lambda x, j: x + CASE WHEN j = pk THEN 1 ELSE 0 END), pk, parts FROM (
    SELECT t, counts, parts, CAST(list_position(dues, list_min(dues)) AS BIGINT) pk FROM (
      SELECT t, counts, parts, list_transform(counts, lambda x, j: CASE WHEN x < parts[j] AND x * 1000 // parts[j] <= t + 1 THEN ((x + 1) * 1000 + parts[j] - 1) // parts[j] ELSE 1000000000 END) dues FROM s WHERE t < 999))),
q AS (SELECT pick - 1 i, t slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 turn FROM s WHERE t >= 0),
e AS (SELECT min(n // 16 // parts * 1000 + slot) ends FROM p JOIN q ON p.i = q.i AND q.turn = n // 16 % parts),
b AS (SELECT r.*, rank // 16 block, parts, i FROM r JOIN p USING (source))
SELECT doc_id, source, copies, rank, block, block // parts * 1000 + slot AS slot, block * 1000 // parts AS release, ((block + 1) * 1000 + parts - 1) // parts AS deadline,
  (block // parts * 1000 + slot) * 16 + rank % 16 AS position, block // parts * 1000 + slot < ends AS on_target
FROM b JOIN q ON b.i = q.i AND q.turn = block % parts CROSS JOIN e""",
    "op8_grid_order_join": f"""WITH RECURSIVE {_VECTORS}, l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, a.x) > 0 AND list_dot_product(b.x, b.x) > 0
  AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95),
r AS (SELECT vec_id node, vec_id reach FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
n AS (SELECT a, count(*) n FROM l GROUP BY a), m AS (SELECT node, min(reach) m FROM r GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN m ON vec_id = node LEFT JOIN n ON vec_id = a""",
    # The pages of these tables have one article element each.
    "op12_page_templates": f"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') t FROM pages),
d AS (SELECT page_id, url, trim(regexp_replace({_decoded("t")}, '\\s+', ' ', 'g')) AS text FROM a) SELECT *, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
    "op11_merkle_manifest": f"""WITH RECURSIVE s8 AS (SELECT i k, i c, 0 t FROM range(256) x(i) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, t + 1 FROM s8 WHERE t < 8),
ct AS (SELECT list(CAST(c AS BIGINT) ORDER BY k) tab FROM s8 WHERE t = 8),
d0 AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor(a >> 8, tab[1 + CAST(xor(a, c) & 255 AS INT)])) crc FROM documents, ct),
d1 AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END other FROM d0),
d AS (SELECT doc_id, source, {_leaf("text")} leaf, {_leaf("other")} checked FROM d1),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, checked) - 1 i, count(*) OVER (PARTITION BY source) n, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 g FROM d),
a AS (SELECT g, 0 l, i, n, leaf h FROM r UNION ALL SELECT g, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY g, l, n, i // 3),
u AS (SELECT g, l top, h subroot FROM a WHERE n = 1),
b AS (SELECT 0 l, g i, count(*) OVER () n, subroot h FROM u UNION ALL SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY l, n, i // 3),
x AS (SELECT g, l, i, h FROM a WHERE n > 1),
w AS (SELECT x.g, x.l, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') lo, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') hi FROM x JOIN x y ON y.g = x.g AND y.l = x.l AND y.i // 3 = x.i // 3 GROUP BY 1, 2, 3),
v AS (SELECT x.l, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') lo, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') hi FROM b x JOIN b y ON y.l = x.l AND y.i // 3 = x.i // 3 WHERE x.n > 1 GROUP BY 1, 2),
f AS (SELECT r.g, r.i, r.i node, 0 l, doc_id, leaf, checked h, '' p FROM r UNION ALL
  SELECT f.g, f.i, CAST(node // 3 AS BIGINT), f.l + 1, doc_id, leaf, sha256(w.lo || f.h || w.hi), p || w.lo || w.hi FROM f JOIN w ON w.g = f.g AND w.l = f.l AND w.i = f.node),
e AS (SELECT f.g, f.i, f.g node, 0 l, doc_id, leaf, f.h, p, subroot FROM f JOIN u ON u.g = f.g AND u.top = f.l UNION ALL
  SELECT e.g, e.i, CAST(node // 3 AS BIGINT), e.l + 1, doc_id, leaf, sha256(v.lo || e.h || v.hi), p || v.lo || v.hi, subroot FROM e JOIN v ON v.l = e.l AND v.i = e.node)
SELECT doc_id, leaf, subroot, b.h AS root, sha256(p) AS proof_sha256, e.h AS folded_root, e.h = b.h AS verified FROM e JOIN b ON b.n = 1 AND e.l = b.l""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
