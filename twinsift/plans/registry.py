"""Queries over the given tables, and their SQL. Documents serve as units: words as tokens, source as file, lang as package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import paths
from ..operators import baseline, calibration, candidates, edits, families, lifecycle, modules, pairs, reports, scan, similarity
from ..sources import changes, code

MIN_TOKENS = 15

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), C.word_tokens("text").alias("tokens"))
    return docs.where(F.size("tokens") >= MIN_TOKENS)


_T = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_U = rf"u AS (SELECT doc_id AS id, {_T} AS t FROM documents WHERE len({_T}) >= {MIN_TOKENS})"
_CAP = "(SELECT CASE WHEN count(*) >= 30 THEN greatest(2, ceil(0.25 * count(*))) ELSE count(*) + 2 END FROM u)"
_S = _U + ", s AS (SELECT DISTINCT id, len(t) AS tc, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], chr(31)))) AS g FROM u), n AS (SELECT id, tc, count(*) AS n FROM s GROUP BY id, tc)"
_P = _S + f""", df AS (SELECT g FROM s GROUP BY g HAVING count(*) BETWEEN 2 AND {_CAP}),
c AS (SELECT DISTINCT a.id AS i, b.id AS j FROM s a JOIN df USING (g) JOIN s b USING (g) WHERE a.id < b.id AND greatest(a.tc, b.tc) <= 2.5 * least(a.tc, b.tc)),
x AS (SELECT c.i, c.j, count(*) AS inter FROM c JOIN s a ON a.id = c.i JOIN s b ON b.id = c.j AND a.g = b.g GROUP BY c.i, c.j),
p AS (SELECT i, j, inter, a.n AS n1, b.n AS n2, CAST(inter AS DOUBLE) / (a.n + b.n - inter) AS sim FROM x JOIN n a ON a.id = i JOIN n b ON b.id = j
      WHERE 2.0 * least(a.tc, b.tc) >= %s * (a.tc + b.tc) AND CAST(inter AS DOUBLE) / (a.n + b.n - inter) >= %s)"""


def _pairs(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    units = _units(spark, sf_dir)
    return similarity.jaccard_pairs(units, threshold, cap=similarity.postings_cap).select("i", "j", "inter", F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"), "sim")


@query("WITH " + _P % (0.7, 0.7) + " SELECT i, j, inter, n1, n2, sim FROM p")
def shingle_jaccard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("WITH " + _S + " SELECT id, count(*) AS n_shingles, sha256(string_agg(g, chr(30) ORDER BY g)) AS digest FROM s GROUP BY id")
def shingle_sets(spark, sf_dir):
    s = C.shingles("tokens")
    return _units(spark, sf_dir).select("id", F.size(s).cast("bigint").alias("n_shingles"), F.sha2(F.array_join(F.array_sort(s), "\u001e"), 256).alias("digest"))


@query("WITH " + _U + " SELECT id, token, count(*) AS c FROM (SELECT id, unnest(t) AS token FROM u) GROUP BY id, token")
def token_vectors(spark, sf_dir):
    return similarity.token_counts(_units(spark, sf_dir)).select("id", F.col("key").alias("token"), "c")


@query("WITH " + _U + " SELECT substr(sha256(array_to_string(t, ' ')), 1, 16) AS hash, count(*) AS members, min(id) AS first_id FROM u GROUP BY 1 HAVING count(*) > 1")
def structural_hash_groups(spark, sf_dir):
    h = _units(spark, sf_dir).groupBy(C.structural_hash("tokens").alias("hash"))
    return h.agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id")).where("members > 1")


_M = _U + """, k AS (SELECT id, len(t) AS tc, unnest(t) AS g, t FROM u), m AS (SELECT id, tc, g, count(*) AS c FROM k GROUP BY id, tc, g),
df AS (SELECT g FROM m GROUP BY g HAVING count(*) >= 2),
c AS (SELECT DISTINCT a.id AS i, b.id AS j, a.tc AS t1, b.tc AS t2 FROM m a JOIN df USING (g) JOIN m b USING (g) WHERE a.id < b.id AND greatest(a.tc, b.tc) <= 2.5 * least(a.tc, b.tc) AND 2.0 * least(a.tc, b.tc) >= 0.7 * (a.tc + b.tc)),
low AS (SELECT i, j, t1, t2, sum(least(a.c, b.c)) AS low FROM c JOIN m a ON a.id = i JOIN m b ON b.id = j AND a.g = b.g GROUP BY i, j, t1, t2)"""


@query("WITH " + _M + " SELECT i, j, CAST(low AS DOUBLE) / CAST(t1 + t2 - low AS DOUBLE) AS sim FROM low WHERE CAST(low AS DOUBLE) / CAST(t1 + t2 - low AS DOUBLE) >= 0.7")
def multiset_jaccard_pairs(spark, sf_dir):
    units = _units(spark, sf_dir)
    return similarity.multiset_pairs(units, 0.7)


@query(
    "WITH " + _S + f""", d AS (SELECT g, count(*) AS df FROM s GROUP BY g), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM u),
w AS (SELECT g, df, greatest(0.0, ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM d, t), tot AS (SELECT id, sum(w) AS total FROM s JOIN w USING (g) GROUP BY id),
c AS (SELECT DISTINCT a.id AS i, b.id AS j FROM s a JOIN w ON w.g = a.g AND w.df BETWEEN 2 AND {_CAP} JOIN s b ON b.g = a.g WHERE a.id < b.id AND greatest(a.tc, b.tc) <= 2.5 * least(a.tc, b.tc) AND 2.0 * least(a.tc, b.tc) >= 0.7 * (a.tc + b.tc)),
x AS (SELECT i, j, sum(w) AS common FROM c JOIN s a ON a.id = i JOIN s b ON b.id = j AND a.g = b.g JOIN w ON w.g = a.g GROUP BY i, j)
SELECT i, j, round(common / (a.total + b.total - common), 6) AS sim FROM x JOIN tot a ON a.id = i JOIN tot b ON b.id = j WHERE common / (a.total + b.total - common) >= 0.7"""
)
def tfidf_jaccard_pairs(spark, sf_dir):
    units = _units(spark, sf_dir)
    return similarity.tfidf_pairs(units, 0.7, cap=similarity.postings_cap).withColumn("sim", F.round("sim", 6))


@query(
    "WITH " + _M + """, idf AS (SELECT g, greatest(0.0, ln((1.0 + (SELECT count(*) FROM u)) / (1.0 + count(*))) + 1.0) AS w FROM m GROUP BY g),
tot AS (SELECT id, sum(c * w) AS total FROM m JOIN idf USING (g) GROUP BY id),
x AS (SELECT c.i, c.j, sum(least(a.c, b.c) * w) AS common FROM c JOIN m a ON a.id = c.i JOIN m b ON b.id = c.j AND a.g = b.g JOIN idf ON idf.g = a.g GROUP BY c.i, c.j)
SELECT i, j, round(common / (a.total + b.total - common), 6) AS sim FROM x JOIN tot a ON a.id = i JOIN tot b ON b.id = j WHERE common / (a.total + b.total - common) >= 0.7"""
)
def tfidf_multiset_pairs(spark, sf_dir):
    units = _units(spark, sf_dir)
    return similarity.tfidf_multiset_pairs(units, 0.7).withColumn("sim", F.round("sim", 6))


@query()
def lcs_pairs(spark, sf_dir):
    units = _units(spark, sf_dir)
    return similarity.alignment_pairs(units, 0.7, cap=similarity.postings_cap)


@query("WITH " + _S + " SELECT g AS shingle, count(*) AS df FROM s GROUP BY g HAVING count(*) > greatest(2, ceil((SELECT count(*) FROM u) * 0.01))")
def df_stop_shingles(spark, sf_dir):
    units = _units(spark, sf_dir)
    return calibration.calibrate(similarity.unit_shingles(units), units.count(), 0.01).where("is_stop").select("shingle", "df")


@query("WITH " + _S + ", d AS (SELECT g, count(*) AS df FROM s GROUP BY g) SELECT count(*) AS raw, CAST(sum(CASE WHEN df >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS retained, round(1.0::DOUBLE - sum(CASE WHEN df >= 2 THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS removed_share FROM d")
def calibration_reduction(spark, sf_dir):
    return calibration.reduction(similarity.document_frequency(similarity.unit_shingles(_units(spark, sf_dir))), 2)


@query("WITH " + _P % (0.7, 0.7) + " SELECT i, j, sim FROM p WHERE i IN (SELECT doc_id FROM labels) OR j IN (SELECT doc_id FROM labels)")
def candidate_diff_restricted(spark, sf_dir):
    changed = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    units = _units(spark, sf_dir)
    return similarity.jaccard_pairs(units, 0.7, cap=similarity.postings_cap, changed=changed).select("i", "j", "sim")


@query("WITH " + _P % (0.7, 0.7) + " SELECT i, j, sim FROM p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 0 AND l.doc_id = i)")
def exempt_pairs_antijoin(spark, sf_dir):
    found = _pairs(spark, sf_dir).select(F.col("i").alias("a"), F.col("j").alias("b"), "sim")
    low = _table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    exempt = found.join(low, found["a"] == low["doc_id"], "left_semi").select("a", "b")
    return similarity.drop_exempt(found, exempt).select(F.col("a").alias("i"), F.col("b").alias("j"), "sim")


def _edges(spark, sf_dir):
    return _pairs(spark, sf_dir, 0.5).select(F.col("i").alias("k1"), F.col("j").alias("k2"), "sim")


_F = "WITH RECURSIVE " + _P % (0.5, 0.5) + ", e AS (SELECT i AS a, j AS b FROM p UNION SELECT j, i FROM p), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), f AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)"


@query(_F + " SELECT node, component FROM f")
def families_single(spark, sf_dir):
    return families.linked_families(_edges(spark, sf_dir), "single")


@query(
    _F + """, q AS (SELECT f.component, f.node, (coalesce((SELECT sum(sim) FROM p WHERE p.i = f.node OR p.j = f.node), 0) + 1.0) / count(*) OVER (PARTITION BY component) AS mean, count(*) OVER (PARTITION BY component) AS member_count FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY round(mean, 9) DESC, node) AS r FROM q)
SELECT k.component, member_count, node AS medoid, round(mean, 6) AS coherence, (SELECT round(avg(sim), 6) FROM p JOIN f ON f.node = p.i WHERE f.component = k.component) AS avg_similarity FROM k WHERE r = 1"""
)
def family_table(spark, sf_dir):
    edges = families.unique_edges(_edges(spark, sf_dir)).withColumn("sim", F.round("sim", 12))
    out = families.family_table(edges, families.linked_families(edges))
    return out.select("component", "member_count", "medoid", F.round("coherence", 6).alias("coherence"), F.round("avg_similarity", 6).alias("avg_similarity"))


for _linkage in ("complete", "quasi_complete", "average", "medoid"):

    def _linked(spark, sf_dir, linkage=_linkage):
        return families.linked_families(_edges(spark, sf_dir), linkage, floor=0.6)

    _QUERIES[f"families_{_linkage}"] = _linked


@query("SELECT source, count(*) AS sloc, count(DISTINCT line) AS distinct_lines FROM (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY source")
def dry_stats_by_source(spark, sf_dir):
    lines = _table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    kept = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("sloc"), F.count_distinct("line").alias("distinct_lines"))


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("file"), F.lit(1).alias("start"), F.lit(7).alias("end"))


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey AS id, unnest(range(CAST(l_linenumber AS BIGINT), least(7, l_linenumber + 1) + 1)) AS line FROM lineitem WHERE l_returnflag = 'R')
SELECT id, count(*) AS changed, round(count(*)::DOUBLE / 7, 4) AS share FROM l GROUP BY id HAVING round(count(*)::DOUBLE / 7, 4) >= 0.5"""
)
def diff_overlap_policy(spark, sf_dir):
    ranges = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + 1).alias("hi"))
    return pairs.touched(pairs.changed_lines(_orders(spark, sf_dir), ranges), "major").select("id", "changed", "share")


@query("SELECT o_orderkey AS id, round(count(DISTINCT CASE WHEN l_linenumber BETWEEN 1 AND 7 THEN l_linenumber END)::DOUBLE / 7, 9) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def coverage_ratio(spark, sf_dir):
    covered = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return pairs.coverage_ratio(_orders(spark, sf_dir), covered).select("id", F.round("coverage", 9).alias("coverage"))


def _order_pairs(spark, sf_dir):
    """Consecutive orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.lead("o_orderkey").over(w).alias("j")).where("j is not null")


_OP = "op AS (SELECT i, j FROM (SELECT o_orderkey AS i, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS j FROM orders) WHERE j IS NOT NULL)"


@query("WITH " + _OP + " SELECT i, j, round(abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) / 86400.0::DOUBLE, 6) AS days FROM op JOIN orders a ON a.o_orderkey = i JOIN orders b ON b.o_orderkey = j WHERE abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) / 86400.0 >= 90")
def temporal_divergence(spark, sf_dir):
    edits = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return pairs.diverged(_order_pairs(spark, sf_dir), edits).select("i", "j", F.round("days", 6).alias("days"))


@query("WITH " + _OP + ", c AS (SELECT o_orderkey AS id, count(DISTINCT l_linenumber)::DOUBLE / 7 AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN 1 AND 7 GROUP BY 1) SELECT i, j FROM op JOIN c a ON a.id = i JOIN c b ON b.id = j WHERE abs(a.c - b.c) >= 0.4")
def asymmetric_coverage(spark, sf_dir):
    covered = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return pairs.asymmetric(_order_pairs(spark, sf_dir), pairs.coverage_ratio(_orders(spark, sf_dir), covered)).select("i", "j")


@query("WITH " + _P % (0.7, 0.7) + " SELECT i, j, round(sim * (a.tc + b.tc) / 2.0, 1) AS priority FROM p JOIN n a ON a.id = i JOIN n b ON b.id = j ORDER BY priority DESC, i, j LIMIT 50")
def priority_topk(spark, sf_dir):
    size = _units(spark, sf_dir).select("id", F.size("tokens").alias("n"))
    found = _pairs(spark, sf_dir).select("i", "j", "sim").join(size.toDF("i", "l1"), "i").join(size.toDF("j", "l2"), "j")
    return found.select("i", "j", C.priority("sim", "l1", "l2", F.lit(1), F.lit(1)).alias("priority")).orderBy(F.desc("priority"), "i", "j").limit(50)


@query(r"WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages) SELECT page_id, p AS path, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS namespace, CASE WHEN starts_with(p, split_part(p, '/', 1) || '/') THEN substr(p, length(split_part(p, '/', 1)) + 2) ELSE '.' END AS below FROM u")
def url_paths(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", C.normalized_path(F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))
    return p.select("page_id", "path", C.namespace("path").alias("namespace"), C.relative_to("path", F.split_part("path", F.lit("/"), F.lit(1))).alias("below"))


@query(
    """WITH c AS (SELECT c_custkey AS ord, c_mktsegment || c_nationkey AS k1, c_mktsegment AS k2 FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS ord, c_mktsegment || c_nationkey AS k1, c_mktsegment AS k2 FROM customer WHERE c_custkey % 3 = 0),
c1 AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY ord) AS n FROM c), b1 AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY ord) AS n FROM b),
c2 AS (SELECT *, row_number() OVER (PARTITION BY k2 ORDER BY ord) AS m FROM c1 WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.k1 = c1.k1 AND b1.n = c1.n)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY k2 ORDER BY ord) AS m FROM b1 WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE b1.k1 = c1.k1 AND b1.n = c1.n))
SELECT ord, k1, k2 FROM c2 WHERE NOT EXISTS (SELECT 1 FROM b2 WHERE b2.k2 = c2.k2 AND b2.m = c2.m)"""
)
def baseline_suppress(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("k1"), F.col("c_mktsegment").alias("k2"))
    return pairs.suppress_known(rows.where("ord % 3 <> 0"), rows.where("ord % 3 = 0"), ["k1", "k2"]).select("ord", "k1", "k2")


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def baseline_prune(spark, sf_dir):
    base = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return pairs.prune_baseline(base, _table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")), "nation")


@query("WITH " + _P % (0.7, 0.7) + " SELECT i, j, least(a.source || ':' || i, b.source || ':' || j) || ' <===> ' || greatest(a.source || ':' || i, b.source || ':' || j) AS fingerprint FROM p JOIN documents a ON a.doc_id = i JOIN documents b ON b.doc_id = j")
def fingerprint_pairs(spark, sf_dir):
    name = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("name"))
    return _pairs(spark, sf_dir).join(name.toDF("i", "a"), "i").join(name.toDF("j", "b"), "j").select("i", "j", C.sorted_pair("a", "b").alias("fingerprint"))


@query("SELECT conv_id, turn, md5(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), '|')) AS digest FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3")
def sliding_windows(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, 2)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.collect_list("text").over(w).alias("texts"))
    return rows.where(F.size("texts") == 3).select("conv_id", "turn", F.md5(F.array_join("texts", "|").cast("binary")).alias("digest"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_linenumber + CAST(l_quantity AS INTEGER) % 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) % 3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lineitem) WHERE reach > l_linenumber")
def interval_collisions(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("end"))
    return pairs.collisions(rows, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT s_nationkey AS k, 'inter' AS op FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT n_nationkey, 'left' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT * FROM (SELECT DISTINCT k, 'union' FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey FROM nation))")
def set_operations(spark, sf_dir):
    s, c, n = (_table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey")))
    return s.intersect(c).withColumn("op", F.lit("inter")).unionByName(n.subtract(s).withColumn("op", F.lit("left"))).unionByName(s.union(n).distinct().withColumn("op", F.lit("union")))


@query("WITH " + _P % (0.7, 0.7) + " SELECT CASE WHEN sim >= 0.95 THEN 'error' ELSE 'warning' END AS level, count(*) AS results FROM p GROUP BY 1")
def sarif_levels(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("doc_id").cast("string").alias("name"), F.lit(1).alias("start"), F.size(F.split("text", "\n")).alias("end"))
    found = _pairs(spark, sf_dir).join(docs.toDF("i", "file1", "name1", "start1", "end1"), "i").join(docs.toDF("j", "file2", "name2", "start2", "end2"), "j")
    return reports.sarif_rows(found).where(F.col("result").isNotNull()).groupBy("level").agg(F.count(F.lit(1)).alias("results"))


def _rendered(spark, sf_dir):
    """Each part as a small Python file; the shape depends on p_size % 2, the names on the key."""
    loop = "def f_{k}(rows_{k}):\n    total_{k} = 0\n    for r_{k} in rows_{k}:\n        if r_{k} > 1 and r_{k} < 9:\n            total_{k} = total_{k} + r_{k}\n        else:\n            total_{k} = total_{k} - 1\n    return total_{k}\n"
    call = "def g_{k}(a_{k}, b_{k}):\n    x_{k} = max(a_{k}, b_{k})\n    while x_{k} > 0:\n        x_{k} = x_{k} - len(str(x_{k}))\n    y_{k} = [x_{k}, a_{k}]\n    y_{k}.append(b_{k})\n    y_{k}.sort()\n    return y_{k}\n"
    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_size") % 2 == 0, F.replace(F.lit(loop), F.lit("{k}"), key)).otherwise(F.replace(F.lit(call), F.lit("{k}"), key))
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit(".py")).alias("file"), text.alias("content"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'f' ELSE 'g' END AS shape, count(*) AS units, CAST(CASE WHEN p_size % 2 = 0 THEN 4 ELSE 2 END AS BIGINT) AS complexity FROM part GROUP BY p_size % 2 ORDER BY 1")
def ast_units(spark, sf_dir):
    units = code.harvest(_rendered(spark, sf_dir), blind=True).where("kind = 'function'")
    grouped = units.groupBy("structural_hash").agg(F.max(F.substring("name", 1, 1)).alias("shape"), F.count(F.lit(1)).alias("units"), F.max("complexity").cast("bigint").alias("complexity"))
    return grouped.select("shape", "units", "complexity")


@query("SELECT 'function' AS kind, count(*) AS n FROM part UNION ALL SELECT 'sliding_window', CAST(sum(CASE WHEN p_size % 2 = 0 THEN 0 ELSE 2 END) AS BIGINT) FROM part")
def ast_kinds(spark, sf_dir):
    units = code.harvest(_rendered(spark, sf_dir), min_lines=6, window=5, blind=True)
    return units.where("kind in ('function', 'sliding_window')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _nation_modules(spark, sf_dir):
    """Each nation as a Python module that imports two others."""
    k = F.col("n_nationkey")
    text = F.format_string("import m.n_%d\nfrom m import n_%d\n\nif TYPE_CHECKING:\n    import m.n_0\n", (k * 3 + 1) % 25, (k * 7 + 2) % 25)
    return _table(spark, sf_dir, "nation").select(F.format_string("src/m/n_%d.py", k).alias("file"), text.alias("content"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey * 7 + 2) % 25 FROM nation) WHERE a <> b),
r AS (SELECT a, b, 1 AS hops FROM e UNION SELECT r.a, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.b WHERE r.hops < 25)
SELECT 'm.n_' || a AS src, 'm.n_' || b AS dst, min(hops) AS hops FROM r GROUP BY a, b"""
)
def module_reachability(spark, sf_dir):
    files = _nation_modules(spark, sf_dir)
    known = files.select(F.regexp_replace(F.regexp_replace("file", r"^src/|\.py$", ""), "/", ".").alias("module"))
    return modules.reachable(modules.resolved_edges(code.import_rows(files), known))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS a1, p_partkey % 5 AS b1, p_size % 3 AS a2, p_size % 5 AS b2 FROM part),
f AS (SELECT k, CASE WHEN k % 7 = 0 THEN '' WHEN a1 <> a2 THEN 'src' WHEN b1 <> b2 THEN 'src/m' || a1 ELSE 'src/m' || a1 || '/n' || b1 END AS folder FROM p)
SELECT k, folder, CASE WHEN folder = '' THEN 'helpers.py' ELSE folder || '/helpers.py' END AS module FROM f"""
)
def shared_modules(spark, sf_dir):
    """Each part as two files in folders named by its key and its size; every seventh second file lies outside the root."""
    k, size = F.col("p_partkey"), F.col("p_size")
    second = F.when(k % 7 == 0, F.format_string("../m%d/q.py", k)).otherwise(F.format_string("src/m%d/n%d/q.py", size % 3, size % 5))
    files = _table(spark, sf_dir, "part").select(k.alias("k"), F.format_string("src/m%d/n%d/p.py", k % 3, k % 5).alias("file1"), second.alias("file2"))
    return files.select("k", modules.common_folder("file1", "file2").alias("folder"), modules.shared_module("file1", "file2", "lib/helpers.py").alias("module"))


@query("SELECT o_orderkey AS file, string_agg('|' || coalesce(q, CAST(i AS VARCHAR)), '' ORDER BY i) AS content FROM (SELECT o_orderkey, unnest(range(1, 8)) AS i FROM orders) LEFT JOIN (SELECT l_orderkey, l_linenumber, min(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS q FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey AND l_linenumber = i GROUP BY o_orderkey")
def applied_edits(spark, sf_dir):
    files = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.lit("|1|2|3|4|5|6|7").alias("content"))
    n = F.col("l_linenumber")
    plan = _table(spark, sf_dir, "lineitem").where("l_linenumber between 1 and 7").groupBy(F.col("l_orderkey").alias("file"), "l_linenumber").agg(F.min(F.col("l_quantity").cast("int").cast("string")).alias("new"))
    return edits.apply_edits(files, plan.select("file", (2 * n - 1).alias("start"), (2 * n).alias("end"), "new")).select("file", "content")


@query(r"""WITH l AS (SELECT doc_id AS file, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$') AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT file, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS line FROM l)
SELECT file, CAST(line AS INTEGER) AS line, CAST(length(x) AS BIGINT) AS length, CAST(coalesce(sum(length(x)) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM u""")
def line_offsets(spark, sf_dir):
    return edits.line_offsets(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content")))


@query(
    """SELECT l_orderkey AS blame, substr(sha1(CAST(l_suppkey AS VARCHAR)), 1, 8) AS commit, 'Supplier ' || l_suppkey AS author, CAST(epoch(l_shipdate) AS BIGINT) AS ts, 'ships ' || l_suppkey AS summary
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY epoch(l_shipdate) DESC, l_linenumber, l_suppkey) = 1"""
)
def blame_latest(spark, sf_dir):
    """Each line item as the blame of one line: its supplier is the commit, its ship date the author's time."""
    who = F.col("l_suppkey").cast("string")
    ts = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("string")
    text = F.array(F.concat(F.sha1(who), F.lit(" 1 1 1")), F.concat(F.lit("author Supplier "), who), F.concat(F.lit("author-time "), ts), F.concat(F.lit("summary ships "), who), F.lit("\tx"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")) * 5
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("blame"), rank.alias("at"), F.posexplode(text).alias("k", "line"))
    return changes.latest_commit(lines.select("blame", (F.col("at") + F.col("k")).alias("ln"), "line"))


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, least('p' || l_partkey || '/a.py:f', 's' || l_suppkey || '/b.py:g') || ' <===> ' || greatest('p' || l_partkey || '/a.py:f', 's' || l_suppkey || '/b.py:g') AS fingerprint,
least('p' || l_partkey || '#' || l_suppkey, 's' || l_suppkey || '#' || l_partkey) || ' <===> ' || greatest('p' || l_partkey || '#' || l_suppkey, 's' || l_suppkey || '#' || l_partkey) AS namespace_hash,
least(CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) || ' <===> ' || greatest(CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS pure FROM l"""
)
def clone_fingerprints(spark, sf_dir):
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("p"), part, F.lit("/a.py")).alias("file1"), F.lit("f").alias("name1"), supp.alias("hash1"),
        F.concat(F.lit("s"), supp, F.lit("/b.py")).alias("file2"), F.lit("g").alias("name2"), part.alias("hash2"),
    )
    return baseline.fingerprints(rows).select("l_orderkey", "l_linenumber", "fingerprint", "namespace_hash", "pure")


@query("WITH " + _P % (0.7, 0.7) + " SELECT unnest(['::warning file=' || i || ',line=1,endLine=' || n1 || '::Duplicate of ' || j || ' in ' || j, '::warning file=' || j || ',line=1,endLine=' || n2 || '::Duplicate of ' || i || ' in ' || i]) AS line FROM p")
def annotation_lines(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    rows = _pairs(spark, sf_dir).select("sim", text("i").alias("file1"), text("i").alias("name1"), F.lit(1).alias("start1"), F.col("n1").alias("end1"), text("j").alias("file2"), text("j").alias("name2"), F.lit(1).alias("start2"), F.col("n2").alias("end2"))
    return reports.annotations(rows)


@query(r"SELECT source AS file, CAST(sum(CASE WHEN regexp_matches(x, '^\s*(#|$)') THEN 0 ELSE 1 END) AS BIGINT) AS sloc FROM (SELECT source, regexp_replace(unnest(regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$')), '[\r\n]+$', '') AS x FROM documents) GROUP BY source")
def code_lines_by_source(spark, sf_dir):
    lines = scan.code_lines(_table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("text").alias("content")))
    return lines.groupBy("file").agg(F.sum(F.col("is_code").cast("bigint")).alias("sloc"))


@query("SELECT 'p' || a.p_partkey || '.py' AS file1, 'p' || b.p_partkey || '.py' AS file2, 1.0::DOUBLE AS sim FROM part a JOIN part b ON a.p_partkey % 2 = 0 AND b.p_partkey = a.p_partkey + 1")
def source_scan(spark, sf_dir):
    """Whole scan by call traces: each part as a file with one function, whose calls name half its key, so that neighbours agree."""
    key, half = F.col("p_partkey").cast("string"), (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string")
    body = "def run_{k}(v):\n    a = open_{h}(v)\n    b = read_{h}(a)\n    if b:\n        c = sort_{h}(b)\n    else:\n        c = list_{h}(a)\n    d = pack_{h}(c)\n    return done_{h}(d)\n"
    text = F.replace(F.replace(F.lit(body), F.lit("{k}"), key), F.lit("{h}"), half)
    files = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit(".py")).alias("file"), text.alias("content"))
    return scan.scan(files, 0.9, metric="calls", functions_only=True).select("file1", "file2", "sim")


@query(
    """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'app/m_' || p_partkey || '.py' WHEN 1 THEN './m_' || p_partkey || '.py' WHEN 2 THEN '/r/app/x/../m_' || p_partkey || '.py' WHEN 3 THEN '../lib/m_' || p_partkey || '.py' ELSE '/else/m_' || p_partkey || '.py' END AS raw FROM part)
SELECT k, raw, CASE WHEN k % 5 < 3 THEN 'm_' || k || '.py' END AS target, CASE WHEN k % 5 < 3 THEN 'app/m_' || k || '.py' WHEN k % 5 = 3 THEN 'lib/m_' || k || '.py' END AS repo,
CASE WHEN k % 5 < 3 THEN 'm_' || k || '.py' WHEN k % 5 = 3 THEN 'lib/m_' || k || '.py' ELSE raw END AS display FROM p"""
)
def path_coordinates(spark, sf_dir):
    k = F.col("p_partkey")
    text = lambda form: F.format_string(form, k)
    raw = F.when(k % 5 == 0, text("app/m_%d.py")).when(k % 5 == 1, text("./m_%d.py")).when(k % 5 == 2, text("/r/app/x/../m_%d.py")).when(k % 5 == 3, text("../lib/m_%d.py")).otherwise(text("/else/m_%d.py"))
    return _table(spark, sf_dir, "part").select(k.alias("k"), paths.coordinates(raw, "/r/app/", "/r").alias("c")).select("k", "c.*")


def _nation_files(spark, sf_dir, table, column):
    return _table(spark, sf_dir, table).select(F.format_string("app/n_%d.py", F.col(column)).alias("file"))


@query(
    """WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier),
d AS (SELECT 'union' AS how, n FROM (SELECT n FROM c UNION SELECT n FROM s) UNION ALL SELECT 'intersection', n FROM (SELECT n FROM c INTERSECT SELECT n FROM s) UNION ALL SELECT 'difference', n FROM (SELECT n FROM c EXCEPT SELECT n FROM s)
UNION ALL SELECT 'symmetric_difference', n FROM ((SELECT n FROM c EXCEPT SELECT n FROM s) UNION (SELECT n FROM s EXCEPT SELECT n FROM c)))
SELECT how, 'repo' AS basis, 'app/n_' || n || '.py' AS key FROM d UNION ALL SELECT how, 'target', 'n_' || n || '.py' FROM d"""
)
def diff_key_sets(spark, sf_dir):
    rich = _table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.format_string("app/n_%d.py", F.col("c_nationkey")).alias("file"))
    a, b = paths.diff_keys(rich, "/r/app", "/r"), paths.diff_keys(_nation_files(spark, sf_dir, "supplier", "s_nationkey"), "/r/app", "/r")
    out = None
    for how in ("union", "intersection", "difference", "symmetric_difference"):
        part = paths.combined_keys(a, b, how).select(F.lit(how).alias("how"), "basis", "key")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT c_custkey AS id, 'n_' || c_nationkey || '.py' AS file FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def units_in_diff(spark, sf_dir):
    keys = paths.diff_keys(_nation_files(spark, sf_dir, "supplier", "s_nationkey").where("false").unionByName(_table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.format_string("app/n_%d.py", F.col("s_nationkey")).alias("file"))), "/r/app", "/r")
    units = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string("n_%d.py", F.col("c_nationkey")).alias("file"))
    return paths.in_diff(units, keys, "/r/app", "/r")


@query(
    """SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'old/a' ELSE 'new/a' END || c_custkey || '.py' AS file1, CASE WHEN c_custkey % 3 = 0 THEN 'old/b' ELSE 'new/b' END || c_custkey || '.py' AS file2,
CASE WHEN c_custkey % 3 = 0 THEN 'dirty' ELSE 'retained' END AS state FROM customer WHERE c_custkey % 3 <> 0 OR c_nationkey < 5"""
)
def baseline_rewrite(spark, sf_dir):
    """Records of customers: two in three are found again under another folder (by their hashes and names), the rest is dirty or gone."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), "c_nationkey", F.col("c_custkey").cast("string").alias("k"))
    ends = lambda folder: [F.concat(F.lit(f"{folder}/a"), "k", F.lit(".py")).alias("file1"), F.lit("f").alias("name1"), F.concat(F.lit("x"), "k").alias("hash1"), F.concat(F.lit(f"{folder}/b"), "k", F.lit(".py")).alias("file2"), F.lit("g").alias("name2"), F.concat(F.lit("y"), "k").alias("hash2")]
    known = lifecycle.BaselineFile(c.select("ord", *ends("old")), target="/r/app", basis="target_relative")
    clones = c.where("ord % 3 <> 0").select("ord", *ends("app/new"))
    dirty = c.where("c_nationkey < 5 and ord % 3 = 0").select(F.concat(F.lit("app/old/a"), "k", F.lit(".py")).alias("file"))
    kept, _ = lifecycle.prune(known, clones, dirty, repo="/r")
    return kept.select("ord", "file1", "file2", "state")


@query(
    """SELECT c_custkey AS k, CASE WHEN c_nationkey >= 5 THEN CAST(c_nationkey AS BIGINT) END AS number, c_acctbal > 0 AND c_acctbal <= 5000 AS has_share, CASE WHEN c_custkey % 2 = 0 THEN md5(c_name) END AS digest,
lower(c_mktsegment) IN ('true', '1', 'yes', 'building') AND c_mktsegment <> 'BUILDING' AS flag, least(1000000000, CAST(c_custkey AS BIGINT) * 1000000) AS units FROM customer"""
)
def sanitised_settings(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    digest = F.when(F.col("c_custkey") % 2 == 0, F.upper(F.md5(F.col("c_name").cast("binary")))).otherwise(F.lit("no hash"))
    return c.select(
        F.col("c_custkey").alias("k"), lifecycle.safe_int_column("c_nationkey", 5).alias("number"), lifecycle.safe_frequency_column(F.col("c_acctbal") / 5000).isNotNull().alias("has_share"),
        lifecycle.safe_hash_column(digest, (32,)).alias("digest"), lifecycle.safe_bool_column("c_mktsegment").alias("flag"), lifecycle.safe_units_column(F.col("c_custkey").cast("bigint") * 1000000).alias("units"),
    )


_K = """idx AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS g, l_orderkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)),
d AS (SELECT g, count(*) AS df, {changed} AS c FROM idx GROUP BY g), n AS (SELECT count(*) AS n, {total} AS changed FROM orders), f AS (SELECT g, df, c, p_size AS saved FROM d JOIN part ON CAST(p_partkey AS VARCHAR) = g WHERE df >= 2 AND c > 0)"""


@query("WITH " + _K.format(changed="count(*)", total="count(*)") + ", ok AS (SELECT g FROM f WHERE greatest(df, saved) <= 30) SELECT DISTINCT a.id AS i, b.id AS j FROM idx a JOIN ok USING (g) JOIN idx b USING (g) WHERE a.id < b.id")
def calibrated_candidates(spark, sf_dir):
    """Orders that share a part: parts of size 1 are stop shingles, sizes are the calibrated frequencies."""
    index, stop, saved, total, _ = _order_index(spark, sf_dir)
    return candidates.candidate_pairs(index, total, 30, stop, saved, total)


@query(
    "WITH " + _K.format(changed="sum(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END)", total="sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END)")
    + """, ok AS (SELECT g FROM f, n WHERE greatest(df, saved - greatest(n + 5 - (n - changed) - c, 0)) <= 30)
SELECT DISTINCT least(a.id, b.id) AS i, greatest(a.id, b.id) AS j FROM idx a JOIN ok USING (g) JOIN idx b USING (g) WHERE a.id <> b.id AND a.id % 4 = 0"""
)
def calibrated_diff_candidates(spark, sf_dir):
    index, stop, saved, total, changed = _order_index(spark, sf_dir)
    return candidates.candidate_pairs(index, total, 30, stop, saved, total + 5, changed)


def _order_index(spark, sf_dir):
    index = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("shingle"), F.col("l_orderkey").alias("id"))
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("shingle"), F.col("p_size").alias("df"))
    orders = _table(spark, sf_dir, "orders")
    return index, part.where("df = 1").select("shingle"), part, orders.count(), orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
