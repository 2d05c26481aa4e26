"""The ``opN_*`` queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import bpe, clustering, decontamination, exact_dedup, language_model, licences, packing, quality, repeats, simhash, sketches, spelling, warc

QUERIES: dict = {}
ORACLE: dict = {}


def tokenizer_path() -> str:
    """Vocabulary file of the queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row that stays of each group of equal texts, for every document."""
    return exact_dedup.decisions(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES["op9_exact_dedup"] = op9_exact_dedup
ORACLE["op9_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    found = simhash.groups(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES["op8_simhash_groups"] = op8_simhash_groups


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return bpe.round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


QUERIES["op5_bpe_round_trip"] = op5_bpe_round_trip


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document packed into sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


QUERIES["op1_best_fit_packing"] = op1_best_fit_packing


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a repeated 400-byte string covers, and what is left.

    ``passage_words`` counts the words that a passage of more than 50 words covers which
    stands anywhere else too; nothing goes for its sake.
    """
    found = repeats.removals(_table(spark, sf_dir, "documents", "doc_id", "text"), more=(repeats.PASSAGES,))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("covered")[1].alias("passage_words"))


QUERIES["op4_repeated_passages"] = op4_repeated_passages


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document and whether it is kept."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.fit(docs).judge(docs)


QUERIES["op2_quality_classifier"] = op2_quality_classifier


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records by way of ARC, and read back."""
    found = warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op3_warc_round_trip"] = op3_warc_round_trip
ORACLE["op3_warc_round_trip"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
  b AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY x) AS best, array_to_string(list_transform(range(32),
      lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM b
"""


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and wordings in every document."""
    return licences.scan(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


QUERIES["op6_licence_scan"] = op6_licence_scan


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return sketches.with_next(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all others."""
    return language_model.score(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES |= {"op7_document_fingerprints": op7_document_fingerprints, "op10_language_model_scores": op10_language_model_scores}


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of ten words of the benchmark, and the items they are of."""
    return decontamination.decontaminate(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES["op12_benchmark_decontamination"] = op12_benchmark_decontamination
ORACLE["op12_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size,
      unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda k: array_to_string(w[k + 1 : k + 10], ' '))) AS x FROM b WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT size FROM windows),
  starts AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size),
  hits AS (SELECT s.doc_id, s.k, s.size, v.item_id FROM starts s JOIN windows v ON v.size = s.size AND v.x = array_to_string(s.w[s.k + 1 : s.k + s.size], ' ')),
  covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds of Lloyd's method with forty centroids."""
    return clustering.cluster(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _lloyd_sql(rounds: int) -> str:
    """Each round: assignment a<i> to centroids c<i> (number, v), then the means c<i + 1>."""
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40)""",
    ]
    apart = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT vec_id, any_value(v.v) AS v, arg_min(c.c, (d, c.c)) AS c, min(d) AS d FROM (SELECT v.*, c.c, {apart} AS d FROM v, c{i} c) AS v JOIN c{i} c ON c.c = v.c GROUP BY vec_id)")
        if i < rounds:
            parts.append(
                f"""m{i} AS (SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM a{i}) GROUP BY c, k),
  c{i + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS v FROM m{i} GROUP BY c) m USING (c))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


QUERIES["op13_centroid_clustering"] = op13_centroid_clustering
ORACLE["op13_centroid_clustering"] = _lloyd_sql(clustering.ROUNDS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common form and root of every word of the documents that occurs three times or more."""
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES["op11_spelling_variants"] = op11_spelling_variants
ORACLE["op11_spelling_variants"] = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
  runs AS (SELECT doc_id, run, count(*) AS times, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text,
    '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 5 GROUP BY doc_id, run),
  hashed AS (SELECT run, times, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM runs, t),
  words AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
  keys AS (SELECT word, n, unnest(range(length(word) + 1)) AS k, CASE WHEN k = 0 THEN word ELSE substr(word, 1, k::INT - 1) || substr(word, k::INT + 1) END AS key FROM words),
  pairs AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
    WHERE CASE WHEN length(a.word) = length(b.word) THEN a.k = b.k ELSE a.k = 0 OR b.k = 0 END),
  best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
  chains AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
  roots AS (SELECT c.word, c.root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
