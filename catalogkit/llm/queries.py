"""The registered queries of this subpackage: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, common, decontamination, fingerprints, license_scan, near_dedup, ngram_lm, packing, simhash, substrings, token_files, toxicity, url_filter, vector_codes
from .tokens import Vocabulary

#: The rules of the URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunk sets of all documents, of their edited texts and of the next documents."""
    return fingerprints.fingerprint_documents(common.table(spark, sf_dir, "documents"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney scores of all documents, learned from those outside fold 0 of ten."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.fold_mod("doc_id", 10) == 0
    scored = ngram_lm.score(docs, ngram_lm.fit(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled ones outside fold 2 of four."""
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), held_out_fold=2, folds=4)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (common.fold_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, exact and misspelled ones."""
    found = license_scan.scan_licenses(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents, by shingles of four words."""
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows of 35 words that occur twice or more."""
    found = substrings.remove_repeats(common.table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the longest fitting rule on all pages."""
    index = url_filter.build_index(spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    return url_filter.apply(common.table(spark, sf_dir, "pages"), index)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark found in all documents."""
    items = decontamination.index_items(common.table(spark, sf_dir, "benchmark"))
    return decontamination.find_contaminated(common.table(spark, sf_dir, "documents"), items)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, read back from the files that they were written to."""
    vocabulary = Vocabulary(public_tokenizers.path("word_bpe_49k.json"), spaced=False)
    return token_files.read_documents(spark, token_files.write_tokens(common.table(spark, sf_dir, "documents"), vocabulary, end_id=2))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), spaced=True)
    packed = packing.pack(common.table(spark, sf_dir, "documents"), vocabulary, end_id=2, size=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 64-bit fingerprints differ in three bits or fewer, by shingles of three words."""
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), shingle_words=3, radius=3)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of eight entries, with codebooks of 16 learned in six rounds."""
    return vector_codes.encode_vectors(common.table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two public tokenizers aligned in all documents."""
    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(common.table(spark, sf_dir, "documents"), pair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_fingerprints, op2_ngram_lm, op3_toxicity, op4_license_scan, op5_near_dedup, op6_substring_dedup, op7_url_filter, op8_decontamination, op9_token_ids, op10_best_fit_packing, op11_simhash, op12_vector_codes, op13_alignment)
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_URL_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)}),
fits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""


_WORDS = r"'[^\x20\x09-\x0D]+'"

_NEAR_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
mutual AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT mutual.b, reach.root FROM reach JOIN mutual ON mutual.a = reach.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_REPEATS_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
each AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
windows AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i+34], ' ') END AS s FROM each),
counted AS (SELECT doc_id, i, word, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS twice FROM windows),
marked AS (
  SELECT doc_id, i, word, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
totals AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS k, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN totals USING (doc_id)
"""


def _codes_sql(rounds: int = 6) -> str:
    """k-means round by round; an entry's index rides in the low digits of a distance, so that ties go to the lower one."""
    steps = [
        """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, k AS part, v[k * len(v) // 8 + 1 : (k + 1) * len(v) // 8] AS x FROM kept, range(8) t(k)),
book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM part
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, p.part, any_value(p.x) AS x, min(16 * list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + entry) AS m
  FROM part p JOIN book{r} b ON b.part = p.part GROUP BY vec_id, p.part)""")
        if r < rounds:
            steps.append(f"""
sum{r} AS (
  SELECT part, m % 16 AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY ALL),
mean{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sum{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON m.part = b.part AND m.entry = b.entry)""")
    return (
        ",".join(steps)
        + f""",
coded AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, sum(m // 16)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS d FROM book{rounds})
SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, (SELECT d FROM digest) AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id)
"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": _NEAR_SQL, "op6_substring_dedup": _REPEATS_SQL, "op7_url_filter": _URL_SQL, "op12_vector_codes": _codes_sql()}
