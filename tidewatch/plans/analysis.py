"""Vectors: centroids, gates, duplicates, matching, zero-shot labels and quality measures.

The supplied vectors are nearly random, so thresholds are set where they select something; tests use planted groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.vector import centroids
from tidewatch.operators import classify, clustering, dedup, nearest, quantised, registry
from tidewatch.session import shared_folder

from .bindings import VECTORS_SQL, table, vectors
from .registry import query

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _sums(extra: str = "") -> str:
    """Sums of vectors by cluster, as lists."""
    return f"""cells AS (SELECT cluster_id, article_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM vectors_ {extra}),
 pos AS (SELECT cluster_id, pos, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM cells GROUP BY 1, 2),
 sums AS (SELECT cluster_id, max(n) AS n, list(s ORDER BY pos) AS s, sum(q) AS q, sum(s * s) AS t FROM pos GROUP BY 1)"""


@query(f"WITH {VECTORS_SQL}, {_sums()} SELECT p.cluster_id, p.pos::INTEGER - 1 AS pos, round(p.s / sqrt(s.t), 9) AS x FROM pos p JOIN sums s USING (cluster_id)")
def cluster_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit mean vectors."""
    rows = centroids(vectors(spark, sf_dir), "cluster_id", "embedding")
    return rows.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 9))


@query(f"WITH {VECTORS_SQL}, {_sums()} SELECT cluster_id, n, round((t - q) / (n * (n - 1)), 9) AS cohesion FROM sums")
def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pairwise similarity by the closed form."""
    return centroids(vectors(spark, sf_dir), "cluster_id", "embedding").select("cluster_id", "n", F.round("cohesion", 9).alias("cohesion"))


@query(f"WITH {VECTORS_SQL}, {_sums()} SELECT cluster_id, n FROM sums WHERE n >= 3 AND (t - q) / (n * (n - 1)) >= 0.0")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of enough members that are alike enough."""
    return clustering.gated(vectors(spark, sf_dir), "cluster_id", "embedding", 3, 0.0).select("cluster_id", "n")


_PAIRS = f"""pairs AS (SELECT a.cluster_id AS cluster, a.article_id::VARCHAR AS a, b.article_id::VARCHAR AS b, round({_DOT.format('a.embedding', 'b.embedding')}, 9) AS similarity
 FROM vectors_ a JOIN vectors_ b ON a.cluster_id = b.cluster_id AND a.article_id::VARCHAR < b.article_id::VARCHAR AND abs(date_diff('microsecond', a.published_at, b.published_at)) <= {{hours}} * 3600000000)"""


@query(f"WITH {VECTORS_SQL}, {_PAIRS.format(hours=240)} SELECT cluster, a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.3")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of a cluster within some hours."""
    rows = dedup.similar_pairs(vectors(spark, sf_dir), 0.3, 240)
    return rows.select(F.col("cluster").cast("int").alias("cluster"), "a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {VECTORS_SQL}, items AS (SELECT cluster_id, list({{'id': article_id::VARCHAR, 'at': epoch_us(published_at), 'v': embedding}} ORDER BY published_at, article_id::VARCHAR) AS l FROM vectors_ GROUP BY 1),
 kept AS (SELECT cluster_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k.at - x.at) <= 864000000000 AND round({_DOT.format('k.v', 'x.v')}, 9) >= 0.3)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0]) AS k FROM items)
 SELECT cluster_id::INTEGER AS cluster, unnest(list_transform(k, lambda x: x.id)) AS id FROM kept""")
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: canonical articles of the greedy, time-ordered rule."""
    rows = dedup.greedy_duplicates(vectors(spark, sf_dir), 0.3, 240)
    return rows.where("duplicate_of is null").select(F.col("cluster").cast("int").alias("cluster"), "id")


@query(f"""WITH RECURSIVE {VECTORS_SQL}, {_PAIRS.format(hours=240)}, e AS (SELECT a, b FROM pairs WHERE similarity >= 0.3 UNION ALL SELECT b, a FROM pairs WHERE similarity >= 0.3),
 r(id, other) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
 t AS (SELECT r.id, arg_min(r.other, {{'at': v.published_at, 'id': r.other}}) AS canonical_id FROM r JOIN vectors_ v ON v.article_id::VARCHAR = r.other GROUP BY 1) SELECT id, canonical_id FROM t""")
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive duplicates; the earliest of a component stands for it."""
    return dedup.transitive_duplicates(vectors(spark, sf_dir), 0.3, 240)


@query(f"""WITH {VECTORS_SQL}, {_sums()}, c AS (SELECT cluster_id, list_transform(s, lambda x: x / sqrt(t)) AS v FROM sums), e AS (SELECT 'e' || article_id AS event_id, embedding AS v FROM vectors_ WHERE event_type <> 'error'),
 m AS (SELECT c.cluster_id, e.event_id, round({_DOT.format('c.v', 'e.v')}, 9) AS similarity FROM c, e)
 SELECT cluster_id, event_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, event_id) AS k FROM m WHERE similarity >= 0.3) WHERE k = 1""")
def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest live event of each cluster's centroid; events of errors are closed."""
    v = vectors(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "closed").otherwise("enriched")
    events = v.select(F.concat(F.lit("e"), F.col("article_id").cast("string")).alias("event_id"), F.col("embedding").alias("centroid"), status.alias("status"))
    found = registry.best_match(centroids(v, "cluster_id", "embedding"), events, 0.3)
    return found.select("cluster_id", "event_id", F.round("similarity", 6).alias("similarity"))


_AXES = {"action_forms": range(0, 8), "thematic_fields": range(8, 16), "channel": range(16, 19), "intensity": range(19, 22)}


def _labels(v: DataFrame) -> DataFrame:
    axis = F.coalesce(*[F.when(F.col("article_id").isin(list(r)), F.lit(a)) for a, r in _AXES.items()])
    return v.where("article_id < 22").select(axis.alias("axis"), F.col("article_id").alias("ord"), F.concat(F.lit("L"), F.col("article_id").cast("string")).alias("label"), F.col("embedding").alias("label_vector"))


_ZERO = f"""l AS (SELECT article_id AS ord, 'L' || article_id AS label, embedding AS lv, CASE WHEN article_id < 8 THEN 'action_forms' WHEN article_id < 16 THEN 'thematic_fields' WHEN article_id < 19 THEN 'channel' ELSE 'intensity' END AS axis FROM vectors_ WHERE article_id < 22),
 s AS (SELECT v.article_id AS id, axis, ord, label, {_DOT.format('v.embedding', 'lv')} / (sqrt({_DOT.format('v.embedding', 'v.embedding')}) * sqrt({_DOT.format('lv', 'lv')}) + 1e-9) AS sim FROM vectors_ v, l),
 k AS (SELECT *, row_number() OVER (PARTITION BY id, axis ORDER BY sim DESC, ord) AS k FROM s),
 z AS (SELECT id, axis, string_agg(label, '|' ORDER BY k) AS labels, max(sim) AS confidence FROM k WHERE k = 1 OR (axis IN ('action_forms', 'thematic_fields') AND k <= 3 AND sim >= 0.12) GROUP BY 1, 2)"""


def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return classify.zero_shot(v.select(F.col("article_id").alias("id"), "embedding"), _labels(v), "id", "embedding", least=0.12)


@query(f"WITH {VECTORS_SQL}, {_ZERO} SELECT id, axis, labels, round(confidence, 6) AS confidence FROM z")
def zero_shot_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on four axes."""
    return _zero(spark, sf_dir).select("id", "axis", F.array_join("labels", "|").alias("labels"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {VECTORS_SQL}, {_ZERO} SELECT id, round(min(confidence), 6) AS min_confidence, min(confidence) < 0.05 AS low FROM z GROUP BY 1")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sure axis decides whether a model is asked."""
    return classify.confidence(_zero(spark, sf_dir), "id", 0.05).select("id", F.round("min_confidence", 6).alias("min_confidence"), "low")


@query(f"""WITH {VECTORS_SQL}, {_sums()}, d AS (SELECT v.article_id, v.cluster_id, s.cluster_id AS other, s.n, {_DOT.format('v.embedding', 's.s')} AS dot, {_DOT.format('v.embedding', 'v.embedding')} AS own FROM vectors_ v, sums s),
 w AS (SELECT article_id, cluster_id, max(CASE WHEN other = cluster_id THEN 1 - (dot - own) / (n - 1) END) AS a, min(CASE WHEN other <> cluster_id THEN 1 - dot / n END) AS b FROM d GROUP BY 1, 2)
 SELECT article_id, cluster_id, round((b - a) / greatest(a, b), 6) AS silhouette FROM w""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine silhouette of each member."""
    rows = clustering.silhouette(vectors(spark, sf_dir), "cluster_id", "embedding", "article_id")
    return rows.select("article_id", "cluster_id", F.round("silhouette", 6).alias("silhouette"))


@query(f"""WITH {VECTORS_SQL}, {_sums()}, m AS (SELECT cluster_id, list_transform(s, lambda x: x / n) AS mean FROM sums),
 d AS (SELECT m.cluster_id, any_value(mean) AS mean, avg(list_distance(v.embedding, m.mean)) AS s FROM vectors_ v JOIN m USING (cluster_id) GROUP BY 1)
 SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.cluster_id, max((a.s + b.s) / list_distance(a.mean, b.mean)) AS r FROM d a JOIN d b ON a.cluster_id <> b.cluster_id GROUP BY 1)""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18."""
    return clustering.davies_bouldin(vectors(spark, sf_dir), "cluster_id", "embedding").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"""WITH {VECTORS_SQL}, {_sums()}, g AS (SELECT list(s ORDER BY pos) AS grand, max(n) AS total FROM (SELECT pos, sum(s) / sum(n) AS s, sum(n) AS n FROM pos GROUP BY 1)),
 b AS (SELECT n, total, q - t / n AS within, n * pow(list_distance(list_transform(s, lambda x: x / n), grand), 2) AS between_ FROM sums, g)
 SELECT round((sum(between_) / (count(*) - 1)) / (sum(within) / (max(total) - count(*))), 6) AS calinski_harabasz FROM b""")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19."""
    return clustering.calinski_harabasz(vectors(spark, sf_dir), "cluster_id", "embedding").select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"""WITH {VECTORS_SQL}, {_sums()}, c AS (SELECT (t - q) / (n * (n - 1)) AS c FROM sums)
 SELECT 'records' AS metric, (SELECT count(*) FROM vectors_)::DOUBLE AS value UNION ALL SELECT 'clusters', count(*) FROM c UNION ALL SELECT 'mean_cohesion', round(avg(c), 6) FROM c
 UNION ALL SELECT 'median_cohesion', round(median(c), 6) FROM c UNION ALL SELECT 'min_cohesion', round(min(c), 6) FROM c""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures that runs are compared by; here those that no other query covers."""
    rows = clustering.baseline(vectors(spark, sf_dir), "cluster_id", "embedding", "article_id")
    wanted = ["records", "clusters", "mean_cohesion", "median_cohesion", "min_cohesion"]
    return rows.where(F.col("metric").isin(wanted)).select("metric", F.round("value", 6).alias("value"))


@query(f"""WITH {VECTORS_SQL.replace('vectors_ AS', 'raw_ AS')}, vectors_ AS (SELECT * FROM raw_ WHERE article_id % 9 <> 0), {_sums()}, c AS (SELECT n, (t - q) / (n * (n - 1)) AS c FROM sums),
 d AS (SELECT v.article_id, v.cluster_id, s.cluster_id AS other, s.n, {_DOT.format('v.embedding', 's.s')} AS dot, {_DOT.format('v.embedding', 'v.embedding')} AS own FROM vectors_ v, sums s),
 w AS (SELECT article_id, cluster_id, max(CASE WHEN other = cluster_id THEN 1 - (dot - own) / (n - 1) END) AS a, min(CASE WHEN other <> cluster_id THEN 1 - dot / n END) AS b FROM d GROUP BY 1, 2),
 f AS (SELECT cluster_id, (b - a) / greatest(a, b) AS s FROM w), m AS (SELECT cluster_id, list_transform(s, lambda x: x / n) AS mean FROM sums),
 e AS (SELECT m.cluster_id, any_value(mean) AS mean, avg(list_distance(v.embedding, m.mean)) AS s FROM vectors_ v JOIN m USING (cluster_id) GROUP BY 1),
 r AS (SELECT a.cluster_id, max((a.s + b.s) / list_distance(a.mean, b.mean)) AS r FROM e a JOIN e b ON a.cluster_id <> b.cluster_id GROUP BY 1),
 g AS (SELECT list(s ORDER BY pos) AS grand, max(n) AS total FROM (SELECT pos, sum(s) / sum(n) AS s, sum(n) AS n FROM pos GROUP BY 1)),
 h AS (SELECT n, total, q - t / n AS within, n * pow(list_distance(list_transform(s, lambda x: x / n), grand), 2) AS between_ FROM sums, g)
 SELECT metric, round("value"::DOUBLE, 6) AS "value" FROM (VALUES ('records', (SELECT count(*)::DOUBLE FROM raw_)), ('clustered', (SELECT count(*) FROM vectors_)), ('noise', (SELECT count(*) FROM raw_ WHERE article_id % 9 = 0)),
  ('noise_share', (SELECT avg(CASE WHEN article_id % 9 = 0 THEN 1.0::DOUBLE ELSE 0 END) FROM raw_)), ('dimensions', (SELECT max(len(embedding)) FROM raw_)),
  ('negative_clusters', (SELECT count(*) FROM (SELECT cluster_id FROM f GROUP BY 1 HAVING avg(s) < 0))), ('silhouette', (SELECT avg(s) FROM f)), ('clusters', (SELECT count(*) FROM c)),
  ('median_size', (SELECT median(n) FROM c)), ('largest_size', (SELECT max(n) FROM c)), ('mean_cohesion', (SELECT avg(c) FROM c)), ('median_cohesion', (SELECT median(c) FROM c)), ('min_cohesion', (SELECT min(c) FROM c)),
  ('davies_bouldin', (SELECT avg(r) FROM r)), ('calinski_harabasz', (SELECT (sum(between_) / (count(*) - 1)) / (sum(within) / (max(total) - count(*))) FROM h))) t(metric, "value")""")
def quality_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the comparison table, with a ninth of the rows as noise."""
    rows = vectors(spark, sf_dir).withColumn("cluster_id", F.when(F.col("article_id") % 9 == 0, -1).otherwise(F.col("cluster_id")))
    return clustering.baseline(rows, "cluster_id", "embedding", "article_id").select("metric", F.round("value", 6).alias("value"))


_NEAR = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
 n AS (SELECT q.vec_id AS query, v.vec_id, list_dot_product(q.v, v.v) AS s FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"""


def _near(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index = nearest.build(rows, "vec_id", "embedding")
    found = nearest.search(index, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 11, len(index.centres) if exact else None)
    return found.where("query <> vec_id")


@query(f"WITH {_NEAR} SELECT query, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS k FROM n) WHERE k <= 10")
def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every fiftieth, with all cells looked at."""
    return _near(spark, sf_dir, True).select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


def _stored(spark: SparkSession, sf_dir: str) -> quantised.Stored:
    """An index of two thirds of the rows, to which the rest are added; some are added a second time and some removed and added again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = quantised.create(rows.where("vec_id % 3 <> 0"), "vec_id", "embedding", f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}", buckets=4)
    index.add(rows.where("vec_id % 3 = 0 OR vec_id % 7 = 0"), "vec_id", "embedding")
    index.remove(rows.where("vec_id % 11 = 0").select("vec_id"))
    index.add(rows.where("vec_id % 11 = 0"), "vec_id", "embedding")
    return quantised.load(spark, index.path)


@query(f"WITH {_NEAR} SELECT query, vec_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS k FROM n) WHERE k <= 10")
def nearest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every fiftieth by a stored index that was added to, with all cells looked at and all rows kept."""
    index, rows = _stored(spark, sf_dir), table(spark, sf_dir, "embeddings")
    found = index.search(rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 11, len(index.model.centres), 1 << 30).where("query <> vec_id")
    return found.select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


@query()
def nearest_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the ten nearest rows by codes and re-ranking as fitted, and the share of all similarities that are computed for it."""
    index, rows = _stored(spark, sf_dir), table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    found = index.search(asked, "vec_id", "embedding", 11).where("query <> vec_id")
    told = nearest.recall(found, _near(spark, sf_dir, True), "vec_id")
    pairs = asked.agg(F.count("*").alias("q")).join(rows.agg(F.count("*").alias("n")))  # one row each
    return told.join(index.candidates(asked, "vec_id", "embedding").agg(F.count("*").alias("c"))).join(pairs).select("recall", (F.col("c") / F.col("q") / F.col("n")).alias("share"))


@query("SELECT true AS enough")
def nearest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds at least 0.9 of the ten nearest rows of every fiftieth, with as many cells as it has fitted."""
    return nearest.recall(_near(spark, sf_dir, False), _near(spark, sf_dir, True), "vec_id").select((F.col("recall") >= 0.9).alias("enough"))


@query(f"""WITH {VECTORS_SQL}, {_sums()}, d AS (SELECT v.article_id, v.cluster_id, s.cluster_id AS other, s.n, {_DOT.format('v.embedding', 's.s')} AS dot, {_DOT.format('v.embedding', 'v.embedding')} AS own FROM vectors_ v, sums s),
 w AS (SELECT article_id, cluster_id, max(CASE WHEN other = cluster_id THEN 1 - (dot - own) / (n - 1) END) AS a, min(CASE WHEN other <> cluster_id THEN 1 - dot / n END) AS b FROM d GROUP BY 1, 2),
 x AS (SELECT cluster_id, avg((b - a) / greatest(a, b)) AS s FROM w GROUP BY 1)
 SELECT x.cluster_id, sums.n, round(x.s, 6) AS silhouette FROM x JOIN sums USING (cluster_id) ORDER BY round(x.s, 9), cluster_id LIMIT 5""")
def worst_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of the lowest silhouette."""
    rows = clustering.worst_clusters(vectors(spark, sf_dir), "cluster_id", "embedding", "article_id", 5)
    return rows.select("cluster_id", "n", F.round("silhouette", 6).alias("silhouette"))


@query()
def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: density clusters of all vectors; no SQL, tested on planted groups."""
    return clustering.hdbscan(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", "cluster_id")


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of documents by the stand-in model; no SQL, tested for unit length."""
    return classify.embed(table(spark, sf_dir, "documents"), "doc_id", "text", classify.HashingModel())


_BEST = f"""l AS (SELECT article_id AS ord, 'L' || article_id AS label, embedding AS lv, CASE WHEN article_id < 8 THEN 'action_forms' WHEN article_id < 16 THEN 'thematic_fields' WHEN article_id < 19 THEN 'channel' ELSE 'intensity' END AS axis FROM vectors_ WHERE article_id < 22),
 s AS (SELECT v.id, axis, ord, label, {_DOT.format('v.v', 'lv')} / (sqrt({_DOT.format('v.v', 'v.v')}) * sqrt({_DOT.format('lv', 'lv')}) + 1e-9) AS sim FROM v, l),
 b AS (SELECT id, label, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, axis, ord) AS k FROM s) WHERE k = 1)"""
_BUCKET = "CASE WHEN sim > 0.55 THEN 'high' WHEN sim > 0.40 THEN 'medium' ELSE 'low' END"


@query(f"WITH {VECTORS_SQL}, v AS (SELECT article_id AS id, embedding AS v FROM vectors_), {_BEST} SELECT id, label, round(sim, 6) AS confidence, {_BUCKET} AS bucket FROM b")
def best_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest label and how sure it is."""
    v = vectors(spark, sf_dir)
    rows = classify.best_label(v.select(F.col("article_id").alias("id"), "embedding"), _labels(v), "id", "embedding")
    return rows.select("id", "label", F.round("confidence", 6).alias("confidence"), "bucket")


@query(f"WITH {VECTORS_SQL}, {_sums()}, v AS (SELECT cluster_id AS id, list_transform(s, lambda x: x / sqrt(t)) AS v FROM sums), {_BEST} SELECT id, label, round(sim, 6) AS confidence FROM b WHERE sim >= 0.25")
def cluster_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose centroid is near enough to any label."""
    v = vectors(spark, sf_dir)
    rows = classify.best_label(centroids(v, "cluster_id", "embedding").select(F.col("cluster_id").alias("id"), "centroid"), _labels(v), "id", "centroid", 0.25)
    return rows.select("id", "label", F.round("confidence", 6).alias("confidence"))
