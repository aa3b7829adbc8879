"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm.collocation_sql import COLLOCATIONS
from seqspark.llm.collocations import collocations
from seqspark.llm.common import id_bucket, table
from seqspark.llm.decontaminate import contaminated
from seqspark.llm.embeddings import near_duplicates as near_vectors
from seqspark.llm.html import extract
from seqspark.llm.langid import train_and_identify
from seqspark.llm.leak_sql import LEAKS
from seqspark.llm.lm import train_and_score
from seqspark.llm.merkle import manifest
from seqspark.llm.merkle_sql import MANIFEST
from seqspark.llm.packing import pack
from seqspark.llm.pii import pseudonymise
from seqspark.llm.sentencepiece import encode_decode
from seqspark.llm.simhash import near_duplicates
from seqspark.llm.toxicity import fit as fit_toxicity
from seqspark.llm.toxicity import score as score_toxicity
from seqspark.llm.warc import round_trip

#: The key of the surrogates in these queries; production takes its own.
PII_KEY = "surrogate-key"

PIECE_MODEL = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"


def piece_model(path: str | None = None) -> bytes:
    """The bytes of the public tokenizer file; path: another model's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECE_MODEL)
    with open(path, "rb") as f:
        return f.read()


def word_tokenizer(path: str | None = None) -> str:
    """The text of the public tokenizer file; path: another tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(WORD_TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = train_and_score(docs, id_bucket(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY, count_col="n_entities")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = train_and_identify(docs, id_bucket(F.col("doc_id"), 3) != 1, spans=False)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_words")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), piece_model(), ids=False, text=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("doc_id"), 3) != 1)
    out = score_toxicity(docs, model)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", tampered=id_bucket(F.col("doc_id"), 5) == 0)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_html_extraction": op4_html_extraction,
    "op5_warc": op5_warc,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_embeddings": op10_embeddings,
    "op11_merkle": op11_merkle,
    "op12_packing": op12_packing,
    "op13_collocations": op13_collocations,
}

#: The others can't be expressed in SQL (64-bit XXHash, the tokenizer's library,
#: trained models, page trees, keyed hashes of text parts); tests/llm holds them
#: against brute force, the library or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, n) AS top FROM b)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM m""",
    "op7_decontamination": LEAKS,
    "op11_merkle": MANIFEST,
    "op13_collocations": COLLOCATIONS,
    "op10_embeddings": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS v, b AS o FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.o = l.a),
c AS (SELECT v, min(o) AS low FROM r GROUP BY v), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept FROM v LEFT JOIN c ON c.v = vec_id LEFT JOIN n ON n.a = vec_id""",
}
