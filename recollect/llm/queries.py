"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.bpe import encode_decode
from recollect.llm.byte_bpe import encode_decode_bytes
from recollect.llm.common import table
from recollect.llm.importance import resample
from recollect.llm.jaccard_join import jaccard_components
from recollect.llm.language import identify
from recollect.llm.packing import pack
from recollect.llm.pivot_search import top_k
from recollect.llm.secrets import secret_report
from recollect.llm.sharding import shard
from recollect.llm.simhash import fingerprint_report
from recollect.llm.token_files import token_files
from recollect.llm.unigram import count_tokens
from recollect.llm.whitening import whiten


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as token files, read back."""
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count of unigram tokens and the score of its best segmentation."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of every document under a Jaccard similarity of 0.85 of four-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85).drop("component", "mark")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), shards=16)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A source is an owner, a source's language one of its repositories."""
    docs = table(spark, sf_dir, "documents")
    return secret_report(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the word-level BPE and decoded again."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; every hundredth id is searched among all."""
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return identify(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 leading components, whitened."""
    return whiten(table(spark, sf_dir, "embeddings"), wanted=16).withColumn("deviation", F.col("deviation").cast("long"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and its place in a draw of a tenth."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, least_words=20, share=10, seed=2024)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the byte-level BPE of many languages and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode_bytes(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_token_counts": op2_token_counts,
    "op3_jaccard": op3_jaccard,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_top_k": op10_top_k,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL: dict[str, str] = {
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), n AS (
            SELECT *, row_number() OVER () AS no FROM v WHERE vec_id IS NOT NULL AND len(x) > 0
        ), q AS (
            SELECT * FROM n WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x, no) = 1
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM q JOIN n c ON c.no <> q.no AND len(q.x) = len(c.x)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op12_resampling": r"""
        WITH crc AS (
            SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS of
            FROM range(256) r(b)
        ), d AS (
            SELECT doc_id, row_number() OVER () AS no,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), b AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM benchmark
        ), dw AS (
            SELECT no, unnest(words) AS word FROM d
        ), spelt AS (
            SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)
        ), bytes AS (
            SELECT word, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS x FROM spelt
        ), hashed AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, crc.of[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM bytes, crc
        ), s AS (
            SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket
        ), t AS (
            SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket
        ), gains AS (
            SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket)
        ), weighed AS (
            SELECT no, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY no
        ), noisy AS (
            SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
            FROM d LEFT JOIN weighed USING (no)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM noisy
        )
        SELECT doc_id, n_features, weight, score,
            CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM noisy WHERE n_features >= 20) // 100 THEN place END AS rank
        FROM placed
    """,
}
