"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from salescope.llm.alignment import align_tokens
from salescope.llm.contamination import contamination
from salescope.llm.jaccard import similar_groups
from salescope.llm.language_model import score_texts
from salescope.llm.lines import dedup_lines
from salescope.llm.mixing import mix
from salescope.llm.passages import remove_repeated
from salescope.llm.pieces import encode_texts
from salescope.llm.toxicity import fit_toxicity, id_remainder, score_toxicity
from salescope.llm.urls import filter_urls
from salescope.llm.vectors import top_k
from salescope.llm.warc import archived
from salescope.llm.whitening import by_component, whiten

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear log-probability of every document; a tenth is held out."""
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    docs = _documents(spark, sf_dir).withColumn("held_out", held_out)
    return score_texts(docs, F.col("doc_id").isNotNull() & ~F.col("held_out"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quarters of ``labels`` that a classifier may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return labels.where(id_remainder(F.col("doc_id"), 4) != 2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that learns from the training labels."""
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return score_toxicity(docs, fit_toxicity(docs, training_labels(spark, sf_dir))).select("doc_id", held_out, "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    found = contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text", "hit_spans")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    return encode_texts(_documents(spark, sf_dir), MODEL, with_ids=False)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document and the group of documents that links reach."""
    return similar_groups(_documents(spark, sf_dir)).drop("digest")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document and the digest of what is kept."""
    return dedup_lines(_documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says, after writing and reading them."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("url")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document as parts of repeated passages."""
    return remove_repeated(_documents(spark, sf_dir), with_text=False)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and linked pairs of two tokenizers' tokens in every document."""
    return align_tokens(_documents(spark, sf_dir), BYTE_LEVEL, MODEL)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first whitened components of every usable vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return by_component(whiten(vectors)).drop("embedding")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_mixing": op11_mixing,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

_BITS4 = "".join(f"{n:04b}" for n in range(16))
_BITS5 = ", ".join(f"'{n:05b}'" for n in range(32))

ORACLES = {
    "op3_decontamination": r"""
        WITH words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), item_words AS (
            SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM item_words WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT size FROM windows),
        starts AS (
            SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size
        ), hits AS (
            SELECT doc_id, i, s.size, item_id FROM starts s JOIN windows v ON s.size = v.size AND array_to_string(w[i : i + s.size - 1], ' ') = phrase
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op5_exact_top_k": r"""
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.t AS DOUBLE[]), CAST(d.t AS DOUBLE[])) AS BIGINT) AS score
            FROM usable q JOIN usable d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.t) = len(d.t)
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), repeated AS (
            SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT doc_id, pos, line, coalesce(doc_id <> last_doc, false) AS dropped FROM keyed LEFT JOIN repeated USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op8_warc": f"""
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), bits AS (
            SELECT *, array_to_string(list_transform(string_split(hex, ''),
                   lambda c: substr('{_BITS4}', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), '') AS b,
                   max(page_id) OVER (PARTITION BY html) AS largest
            FROM payloads
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   list_position([{_BITS5}], substr(b, 5 * i + 1, 5)), 1)), '') AS payload_digest,
               CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> largest THEN largest END AS refers_to
        FROM bits
    """,
    "op10_url_filters": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), rules(rh, rp, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), fitting AS (
            SELECT page_id, max_by(struct_pack(r := rh || rp, v := v), length(rh || rp)) AS best
            FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            GROUP BY page_id
        )
        SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (page_id)
    """,
    "op11_mixing": r"""
        WITH units AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, count(*) AS copies
            FROM documents GROUP BY ALL
        ), sizes AS (
            SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size, sum(copies) AS source_rows FROM units GROUP BY source
        ), weighed AS (
            SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sizes
        ), filled AS (
            SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS w_left,
                   150 * (sum(source_size) OVER ()) - 200 * coalesce(sum(source_size) OVER f, 0) AS size_left
            FROM weighed WINDOW f AS (ORDER BY source_size * (10 // w), source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), judged AS (
            SELECT *, 200 * source_size * w_left <= w * size_left AS limited FROM filled
        ), aimed AS (
            SELECT *, CASE WHEN limited THEN 2.0 * CAST(source_size AS DOUBLE)
                ELSE CAST(w * (150 * total - 200 * (sum(CASE WHEN limited THEN source_size ELSE 0 END) OVER ())) AS DOUBLE)
                     / CAST(100 * (sum(CASE WHEN limited THEN 0 ELSE w END) OVER ()) AS DOUBLE) END AS target FROM judged
        ), cut AS (
            SELECT *, coalesce(CAST(greatest(1, least(64, floor(min(CASE WHEN NOT limited THEN target END) OVER () / 1000))) AS BIGINT), 64) AS block FROM aimed
        ), seated AS (
            SELECT *, CAST(round(sum(CASE WHEN limited THEN 0 ELSE target END) OVER () / block) AS BIGINT) AS seats FROM cut
        ), quotients AS (
            SELECT source_no, seats, w / (2 * k + 1) AS q FROM (SELECT source_no, seats, w, unnest(range(0, CAST(2 * target / block AS BIGINT) + 10)) AS k FROM seated WHERE NOT limited)
        ), source_quotas AS (
            SELECT source_no, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source_no) AS r FROM quotients) WHERE r <= seats GROUP BY source_no
        ), sources AS (
            SELECT s.*, coalesce(quota, 0) AS quota, CAST(ceil(greatest(source_size / (block * 1024), source_rows / 50000, 1)) AS BIGINT) AS n_shards
            FROM seated s LEFT JOIN source_quotas USING (source_no)
        ), pieces AS (
            SELECT u.doc_id, u.size, s.source_no, s.n_shards, greatest(1, least(block * 1024 // (4 * greatest(u.size, 1)), 12500)) AS held, u.copies,
                   unnest(range(0, (u.copies - 1) // held + 1)) AS piece
            FROM units u JOIN sources s ON u.source IS NOT DISTINCT FROM s.source
        ), dealt AS (
            SELECT *, least(held, copies - piece * held) AS own, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || piece) AS key FROM pieces
        ), laid AS (
            SELECT *, CAST('0x' || substr(key, 1, 12) AS BIGINT) % n_shards AS shard,
                   coalesce(sum(size * own) OVER (PARTITION BY source_no, shard ORDER BY key, doc_id, size, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM dealt
        ), shards AS (
            SELECT source_no, shard, sum(size * own) AS words FROM laid GROUP BY ALL
        ), shard_quotients AS (
            SELECT source_no, shard, quota, words / (2 * k + 1) AS q
            FROM (SELECT source_no, shard, words, quota, unnest(range(0, CAST(2 * quota * words / greatest(source_size, 1) AS BIGINT) + 10)) AS k FROM shards JOIN sources USING (source_no))
        ), shard_quotas AS (
            SELECT source_no, shard, count(*) AS got
            FROM (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY q DESC, shard) AS r FROM shard_quotients) WHERE r <= quota GROUP BY ALL
        ), shared AS (
            SELECT h.*, s.source_size, s.target, s.block, CAST(ceil(words / block) AS BIGINT) AS blocks,
                   CASE WHEN limited THEN 2 * blocks ELSE least(coalesce(got, 0), 2 * blocks) END AS take
            FROM shards h JOIN sources s USING (source_no) LEFT JOIN shard_quotas USING (source_no, shard)
        ), picked AS (
            SELECT *, take // blocks + CAST(row_number() OVER (PARTITION BY source_no, shard ORDER BY md5('mix|' || source_no || '|' || shard || '|' || b)) <= take % blocks AS INTEGER) AS times
            FROM (SELECT *, unnest(range(0, blocks)) AS b FROM shared)
        ), copied AS (
            SELECT doc_id, size, source_no, shard, start + c * size AS start FROM (SELECT *, unnest(range(0, own)) AS c FROM laid)
        ), numbered AS (SELECT *, row_number() OVER () AS n FROM copied),
        covered AS (
            SELECT n, sum((least(start + size, (b + 1) * block) - greatest(start, b * block)) * times) AS taken
            FROM numbered JOIN picked USING (source_no, shard) WHERE b * block < start + size AND (b + 1) * block > start AND size > 0 GROUP BY n
        )
        SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
        FROM numbered JOIN sources USING (source_no) LEFT JOIN covered USING (n)
    """,
}
