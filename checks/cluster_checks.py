"""Queries over embeddings: C11, D27, F7, I1, I2."""

from pyspark.sql import functions as F

from checks.registry import check
from skillgauge.operators import clustering, tree
from skillgauge.session import cut_lineage


def vectors(t):
    return t.embeddings().select(F.col("vec_id").alias("instance_id"), "embedding", "label")


def label_centroids(t):
    """A two-level tree over the labels: two branches, then five labels each."""
    rows = vectors(t).withColumn("branch", (F.col("label") % 2).cast("int"))
    empty = F.array().cast("array<int>")
    top = clustering.centroids_of(rows.withColumn("cluster", F.col("branch")), ["cluster"]).select(
        F.lit("t").alias("tree_id"), empty.alias("path"), "cluster", "centroid"
    )
    low = clustering.centroids_of(rows.withColumn("cluster", F.floor(F.col("label") / 2).cast("int")), ["branch", "cluster"]).select(
        F.lit("t").alias("tree_id"), F.array("branch").alias("path"), "cluster", "centroid"
    )
    return top.unionByName(low)


UNITS = """
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
m AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY vec_id), u AS (SELECT v.vec_id, label, d, x / norm AS x FROM v JOIN m USING (vec_id)),
"""
SILHOUETTE = UNITS + """g AS (SELECT {group} AS g, label AS real, vec_id, d, x FROM (SELECT *, 1 AS one FROM u)),
s AS (SELECT g, d, sum(x) AS x, count(*) AS n FROM g GROUP BY ALL), w AS (SELECT a.vec_id, a.g AS own, s.g AS other, max(s.n) AS n, max(s.n) - sum(a.x * s.x) AS total FROM g a JOIN s USING (d) GROUP BY ALL),
q AS (SELECT vec_id, min(total / (n - 1)) FILTER (own = other AND n > 1) AS a, min(total / n) FILTER (own <> other) AS b FROM w GROUP BY vec_id),
z AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n FROM q)"""


@check("d27_cosine_silhouette", SILHOUETTE.format(group="label") + ' SELECT round(silhouette, 6) AS silhouette, n AS "rows" FROM z')
def _(t):
    return clustering.cosine_silhouette(vectors(t)).withColumn("silhouette", F.round("silhouette", 6))


def silhouettes(t):
    """Vectors labelled by the largest of their first k values, for several k, scored in one job."""
    counts = F.explode(F.array(*[F.lit(k) for k in (2, 3, 5, 10)]))
    first = F.slice("embedding", F.lit(1), F.col("k"))
    labelled = vectors(t).withColumn("k", counts).withColumn("label", F.array_position(first, F.array_max(first)))
    return clustering.cosine_silhouette(labelled, ("k",))


@check("f7_best_cluster_count", UNITS + """b AS (SELECT k, vec_id, list_position(embedding[1:k], list_max(embedding[1:k])) AS g FROM embeddings, (VALUES (2), (3), (5), (10)) ks(k)),
g AS (SELECT k, g, vec_id, d, x FROM u JOIN b USING (vec_id)),
s AS (SELECT k, g, d, sum(x) AS x, count(*) AS n FROM g GROUP BY ALL), w AS (SELECT a.k, a.vec_id, a.g AS own, s.g AS other, max(s.n) AS n, max(s.n) - sum(a.x * s.x) AS total FROM g a JOIN s USING (k, d) GROUP BY ALL),
q AS (SELECT k, vec_id, min(total / (n - 1)) FILTER (own = other AND n > 1) AS a, min(total / n) FILTER (own <> other) AS b FROM w GROUP BY ALL),
z AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM q GROUP BY k)
SELECT k, round(silhouette, 6) AS silhouette FROM z WHERE silhouette > 0 ORDER BY silhouette DESC, k LIMIT 1""")
def _(t):
    return clustering.best_cluster_count(silhouettes(t)).withColumn("silhouette", F.round("silhouette", 6))


NEAREST = """
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
top AS (SELECT label % 2 AS c, d, avg(x) AS x FROM v GROUP BY ALL), low AS (SELECT label % 2 AS b, label // 2 AS c, d, avg(x) AS x FROM v GROUP BY ALL),
one AS (SELECT vec_id, arg_min(c, (dist, c)) AS b FROM (SELECT vec_id, c, sum((v.x - t.x) * (v.x - t.x)) AS dist FROM v JOIN top t USING (d) GROUP BY ALL) GROUP BY vec_id),
two AS (SELECT vec_id, b, arg_min(c, (dist, c)) AS c FROM (SELECT v.vec_id, one.b, l.c, sum((v.x - l.x) * (v.x - l.x)) AS dist FROM v JOIN one USING (vec_id) JOIN low l ON l.b = one.b AND l.d = v.d GROUP BY ALL) GROUP BY ALL)"""


@check("c11_nearest_centroid", NEAREST + " SELECT vec_id AS instance_id, CAST(b AS INT) AS cluster FROM one")
def _(t):
    rows = vectors(t).withColumns({"tree_id": F.lit("t"), "path": F.array().cast("array<int>")})
    return clustering.nearest_clusters(rows, label_centroids(t)).select("instance_id", "cluster")


@check("i2_located_paths", NEAREST + " SELECT vec_id AS instance_id, concat(b, '/', c) AS path FROM two")
def _(t):
    located = clustering.locate(vectors(t), label_centroids(t), "t")
    return located.select("instance_id", tree.path_text(F.col("path")).alias("path"))


@check("i1_recursive_clustering")
def _(t):
    leaves, _ = clustering.build_tree(vectors(t))
    return leaves.select("instance_id", tree.path_text(F.col("path")).alias("path"))


@check("i1_tree_facts", """SELECT count(*) AS instances, count(DISTINCT vec_id) AS placed, 0::BIGINT AS far_from_own, 0::BIGINT AS odd_paths, 0::BIGINT AS off_mean FROM embeddings""")
def _(t):
    """What holds for any such tree: every instance has one place, lies in the nearest of its siblings' clusters at
    every depth, under nodes with two children or more whose centroids are the means of their rows."""
    leaves, centroids = clustering.build_tree(vectors(t))
    leaves, centroids = cut_lineage(leaves), cut_lineage(centroids)
    found = clustering.locate(vectors(t), centroids, "tree").withColumnRenamed("path", "nearest")
    joined = leaves.join(found, "instance_id", "left")
    depths = leaves.join(vectors(t), "instance_id").select("*", F.posexplode("path").alias("depth", "cluster"))
    means = clustering.centroids_of(depths.withColumn("path", F.slice("path", F.lit(1), F.col("depth"))), [*tree.NODE, "cluster"]).withColumnRenamed("centroid", "mean")
    compared = centroids.join(means, [*tree.NODE, "cluster"], "full")
    off = F.coalesce(clustering.squared_distance(F.col("mean"), F.col("centroid")), F.lit(9.0)) > 1e-3
    few = centroids.groupBy(*tree.NODE).agg(F.count("*").alias("n")).filter("n < 2")
    placed = joined.agg(F.count("*").alias("instances"), F.count_distinct("instance_id").alias("placed"), F.count_if(~F.col("path").eqNullSafe(F.col("nearest"))).alias("far_from_own"))
    return placed.crossJoin(F.broadcast(few.agg(F.count("*").alias("odd_paths")))).crossJoin(F.broadcast(compared.agg(F.count_if(off).alias("off_mean"))))
