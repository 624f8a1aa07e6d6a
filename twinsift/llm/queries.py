"""The queries of this subpackage, by the columns that their contracts name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, near_dup, ngram_lm, packing, phrase_dedup, token_files, toxicity, url_filters
from .common import remainder_of_id, table
from .tokens import default_tokenizer


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer("byte_bpe_50k.json"), end_id=0)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_of_id("doc_id", 5) == 1
    model = ngram_lm.train(docs.where(~held_out), prune=False)
    scored = ngram_lm.score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["n"]).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_of_id("doc_id", 4) == 2
    model = language_id.train_language_codes(docs.where(~held_out))
    found = language_id.identify(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder_of_id("doc_id", 5) == 0
    model = toxicity.train_toxicity(docs.where(~held_out), table(spark, sf_dir, "labels"))
    found = toxicity.score_toxicity(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark))


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), default_tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(files)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_decontaminate, op2_best_fit_packing, op3_exact_dedup, op4_ngram_lm, op5_near_duplicates,
            op6_language_id, op7_toxicity, op8_url_filters, op9_phrase_dedup, op10_token_files,
        )
    }


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
cut AS (SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i+9]) END) AS x FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS p FROM cut),
pos AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT q.doc_id, q.i, q.n, q.p FROM (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS p FROM pos) q SEMI JOIN win ON win.n = q.n AND win.p = q.p),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT h.doc_id, CAST(item_id AS VARCHAR) AS item FROM hit h JOIN win USING (n, p)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_OP3 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""

_OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM d WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies FROM s GROUP BY s),
x AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
pairs AS (SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS u, rep AS v FROM c UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v),
class AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u),
links AS (SELECT u, count(*) AS n_links FROM pairs GROUP BY u)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.s = s.s LEFT JOIN class ON class.u = c.rep LEFT JOIN links ON links.u = c.rep
"""

_OP8 = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, pre, v)),
m AS (SELECT page_id, host, path, h || pre AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC NULLS LAST) AS k
      FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY p) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM later)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.k) AS words, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.k = x.k GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": _OP1, "op3_exact_dedup": _OP3, "op5_near_duplicates": _OP5, "op8_url_filters": _OP8, "op9_phrase_dedup": _OP9}
