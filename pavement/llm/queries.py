"""The registered query of each operator of this subpackage, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavement.llm import (bpe, collocations, decontaminate, extract, neardup, passages, pii, quality, repeats, sharding,
                          tokencount, toxicity, whitening)
from pavement.llm.columns import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
COUNTED_VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def _flat(found: tuple[DataFrame, str], *keys: str) -> DataFrame:
    df, name = found
    return df.select(*keys, f"{name}.*")


@query
def op1_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document that repeat elsewhere, and the spans to remove."""
    return (passages.repeated_passages(table(spark, folder, "documents")).drop("row_hash")
            .withColumn("repeated", (F.col("n_repeated") > 0) | (F.col("removed_words") > 0)))


@query
def op2_interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards 0 to 15 of all documents by proportional stratified interleaving; the law is ``rows``."""
    return (sharding.shard_rows(table(spark, folder, "documents"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "source"))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the calibrated classifier's verdict on every document."""
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return _flat(quality.judged(docs, model), "doc_id")


@query
def op4_pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return _flat(pii.pii_digest(table(spark, folder, "documents")), "doc_id")


@query
def op5_chosen_path_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near duplicates: 3-word shingles, Jaccard of 0.85 or more."""
    return (neardup.near_duplicates(table(spark, folder, "documents"), k=3, percent=85)
            .select("doc_id", "n_shingles", "component_id", "kept"))


@query
def op6_prefix_free_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that lie in a 400-byte string with another occurrence."""
    return repeats.repeats(table(spark, folder, "documents")).drop("spans")


@query
def op7_block_labeller(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    return _flat(extract.main_text(pages, extract.train(pages)), "page_id", "url")


@query
def op8_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    df, name = toxicity.scored(docs, model)
    return df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), f"{name}.*")


@query
def op9_benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    df, name = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hits = F.col(name)
    return df.select("doc_id", hits.n_words.alias("n_words"), hits.n_hit.alias("n_hit"),
                     F.size(hits["items"]).cast("long").alias("n_items"),
                     F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
                     (hits.n_hit > 0).alias("contaminated"))


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    path = public_tokenizers.path(VOCABULARY)
    return _flat(bpe.token_columns(table(spark, folder, "documents"), path, public_tokenizers.PATTERN), "doc_id")


@query
def op11_finite_state_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, folder, "documents")
    return _flat(tokencount.token_counts(docs, public_tokenizers.path(COUNTED_VOCABULARY)), "doc_id")


@query
def op12_block_matrix_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whitened(table(spark, folder, "embeddings"))


@query
def op13_partitioned_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2,000 phrases of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


SQL["op2_interleaved_shards"] = """
WITH base AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS stratum, coalesce(text, '') AS body,
         CASE WHEN doc_id IS NULL THEN '' ELSE md5(concat(doc_id, ':11')) END AS k,
         coalesce(md5(text), '') AS m
  FROM documents),
table_ AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i:
           CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)),
sized AS (
  SELECT *, octet_length(encode(body)) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           CASE WHEN body = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(hex(encode(body)), '..') END,
           lambda h: CAST('0x' || h AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc,
         md5(concat(k, ':', m)) AS mixed
  FROM base, table_),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY mixed) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n
  FROM sized),
placed AS (
  SELECT *, (r + (CAST('0x' || substr(md5(concat(stratum, ':11')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE) / n AS at_
  FROM ranked),
final AS (
  SELECT *, row_number() OVER (ORDER BY at_, stratum, mixed) - 1 AS pos, count(*) OVER () AS total FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(pos * 16 // total AS INT) AS shard, CAST(pos - ((pos * 16 // total) * total + 15) // 16 AS BIGINT) AS slot,
       CAST(NULL AS INT) AS grown_shard, source
FROM final"""

SQL["op5_chosen_path_near_duplicates"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
often AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
shared AS (SELECT doc_id, n, g FROM grams SEMI JOIN often USING (g)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT a AS x, b AS y FROM links
  UNION
  SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sets LEFT JOIN low ON doc_id = x"""

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
SQL["op9_benchmark_hits"] = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, p.n, i FROM places p JOIN wins USING (win)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids
              FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

SQL["op13_partitioned_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
cands AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
parts AS (
  SELECT lang, max(n) AS around, array_to_string(w[i:i + j - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(1, k)) AS j FROM cands)) GROUP BY ALL),
kept AS (SELECT c.* FROM cands c LEFT JOIN parts p USING (lang, phrase) WHERE p.around IS NULL OR 100 * p.around < 80 * c.n),
cuts AS (SELECT *, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
         FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.n AS a, c, h.n AS l, t.n AS r, (2000000::HUGEINT * cuts.n) // (h.n + t.n) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS p FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE p = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
