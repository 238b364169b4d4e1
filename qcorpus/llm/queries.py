"""Registered queries of the operators in this subpackage, with DuckDB SQL
where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qcorpus.session import table

from . import byte_bpe
from .conversation_repair import damage, repair_report
from .embedding_dedup import near_duplicates
from .fill_in_middle import fill_in_middle, restored
from .license_scan import scan_licenses
from .ngram_jaccard import ngram_jaccard_components
from .page_wrapper import extract_pages
from .quality_rules import quality_rules
from .sentence_spans import remove_repeated_passages
from .sentencepiece_codec import encode_texts
from .source_mixing import mix_sources
from .toxicity import held_out, score, train
from .warc import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query
    return put


# Lower A-Z only, ASCII white space only: fixed by the contract.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


@registered("op8_ngram_jaccard", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@registered("op6_sentence_spans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_passages(docs)


@registered("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules(docs, ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "class_distance", "word_distance")


@registered("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@registered("op10_source_mixing", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, n, [5, 2, 1][i % 3 + 1] AS w, 2 * n / [5, 2, 1][i % 3 + 1] AS cap FROM s),
f AS (
  SELECT *, coalesce(sum(2 * n) OVER before, 0) AS spent, sum(w) OVER rest AS left_w,
    (SELECT 1.5::DOUBLE * sum(n) FROM s) AS whole FROM w
  WINDOW before AS (ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (
  SELECT max((whole - spent)::DOUBLE / left_w) FILTER ((whole - spent)::DOUBLE / left_w <= cap) AS unit FROM f),
t AS (
  SELECT source, n, CASE WHEN cap >= unit THEN unit * w ELSE (2 * n)::DOUBLE END AS target FROM w, u),
p AS (
  SELECT d.doc_id, d.source, d.size, t.n AS source_size, t.target, floor(t.target)::BIGINT AS goal,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
need AS (
  SELECT source, blocks, sum(blocks) OVER ()::BIGINT AS total, row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 AS final,
    sum(blocks) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM (SELECT source, (floor(target)::BIGINT + 511) // 512 AS blocks FROM t)),
cut AS (
  SELECT source, blocks, (upto - blocks)::HUGEINT * 18446744073709551616 // greatest(total, 1) AS lo,
    CASE WHEN final THEN 18446744073709551616::HUGEINT ELSE upto::HUGEINT * 18446744073709551616 // greatest(total, 1) END AS hi FROM need),
point AS (
  SELECT i AS slot, i::HUGEINT * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT AS x
  FROM (SELECT unnest(range((SELECT max(total) FROM need))) AS i)),
g AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM point JOIN cut ON x >= lo AND x < hi QUALIFY rank < blocks)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(a + size, goal) - a) + greatest(0, least(a + source_size + size, goal) - a - source_size) AS BIGINT)
    AS taken, CASE WHEN size > 0 AND a < goal THEN coalesce(g.slot, (SELECT max(total) FROM need)) END AS first_slot
FROM p LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source AND g.rank = p.a // 512""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@registered("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, TOKENIZER).select("doc_id", "n_tokens", "token_ids", "roundtrip", "parity")


@registered("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "offending")


@registered("op9_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN l ON l.a = e.vec_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@registered("op2_page_wrapper")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@registered("op7_warc", """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@registered("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = byte_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    out = byte_bpe.decode_ids(docs, ranks, pattern)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@registered("op12_fill_in_middle", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
c AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS lo,
    greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:lo], ''), '') AS a,
    coalesce(array_to_string(w[lo + 1:hi], ''), '') AS b, coalesce(array_to_string(w[hi + 1:n], ''), '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))


@registered("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(rows, damage(rows))
