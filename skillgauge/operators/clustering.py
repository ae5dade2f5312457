"""Recursive clustering of embeddings into a capability tree."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from skillgauge.functions.text import seeded_hash
from skillgauge.operators import kmeans
from skillgauge.operators.tree import NODE
from skillgauge.session import BROADCAST_BYTES, broadcast_if_small, cut_lineage

# Most children of a node, seed of every fit.
MAX_CHILDREN = 10
SEED = 42
# Vectors of one block, and of the largest node that one task splits to the end.
BLOCK_BYTES = 1 << 20
TASK_BYTES = 4 << 20
# Centroids of the nodes that are split at the same time: the driver moves them, every task has them all.
FIT_BYTES = 16 << 20
# Levels of a tree that rows go down in one plan.
PLAN_LEVELS = 8


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _unit(vector: Column) -> Column:
    norm = F.sqrt(_dot(vector, vector))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def cosine_silhouette(vectors: DataFrame, keys: tuple[str, ...] = (), label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean cosine silhouette of a labelling, for each value of `keys`.

    The mean cosine distance from a row to a cluster follows from the sum of the cluster's unit
    vectors, so no pairs are formed: one vector sum per cluster, then one pass over the rows. The sums
    of a group are one per cluster, few by construction, and meet a row as one value. A zero vector
    is at distance one from everything.
    """
    keys = list(keys)
    units = vectors.select(*keys, F.col(label).alias("_label"), _unit(F.col(vector).cast("array<double>")).alias("_unit"))
    sums = cut_lineage(_vector_sums(units, [*keys, "_label"], "_unit"))
    gathered = F.collect_list(F.struct(F.col("_label").alias("label"), F.col("_count").alias("n"), F.col("_sum").alias("total")))
    if keys:
        per_key = sums.groupBy(*keys).agg(gathered.alias("_clusters"))
        width = 8 * F.aggregate("_clusters", F.lit(0), lambda n, c: n + F.size(c["total"]))
        measured = units.join(broadcast_if_small(per_key, width), keys)
    else:
        measured = units.withColumn("_clusters", sums.agg(gathered).scalar())
    unit = F.col("_unit")
    own_distance = F.when(_dot(unit, unit) > 0, 0.0).otherwise(1.0)
    inner = F.array_min(
        F.transform(
            F.filter("_clusters", lambda c: c["label"] == F.col("_label")),
            lambda c: F.try_divide(c["n"] - _dot(unit, c["total"]) - own_distance, (c["n"] - 1).cast("double")),
        )
    )
    outer = F.array_min(
        F.transform(
            F.filter("_clusters", lambda c: c["label"] != F.col("_label")), lambda c: (c["n"] - _dot(unit, c["total"])) / c["n"]
        )
    )
    # A cluster of one, or one cluster alone, scores zero.
    measured = measured.select(*keys, inner.alias("_a"), outer.alias("_b"))
    score = F.when(
        F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b"))
    )
    return measured.groupBy(*keys).agg(
        F.avg(F.coalesce(score, F.lit(0.0))).alias("silhouette"), F.count("*").alias("rows")
    )


def _vector_sums(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Elementwise sum and number of vectors per key. Each task adds up its own part of a key first, so
    a key that most rows share is no hot spot."""
    summary = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.groupBy(*keys).agg(summary.alias("_summary")).select(
        *keys, vector_to_array("_summary.sum").alias("_sum"), F.col("_summary.count").alias("_count")
    )


def centroids_of(labelled: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean vector per key."""
    sums = _vector_sums(labelled, keys, vector)
    return sums.select(*keys, F.transform("_sum", lambda x: x / F.col("_count")).alias("centroid"))


def nearest_clusters(located: DataFrame, centroids: DataFrame, vector: str = "embedding", how: str = "inner") -> DataFrame:
    """C11: the nearest centroid of each row's node, the smaller cluster on ties. `how` says whether rows of nodes without
    centroids are kept.

    A node's centroids, at most `MAX_CHILDREN`, travel as one row and are compared inside the row, so
    rows are neither multiplied nor grouped.
    """
    per_node = centroids.groupBy(*NODE).agg(F.collect_list(F.struct("cluster", "centroid")).alias("_centroids"))
    width = 8 * F.size("_centroids") * F.size(F.col("_centroids")[0]["centroid"])
    joined = located.join(broadcast_if_small(per_node, width), NODE, how)
    nearest = F.array_min(
        F.transform(
            "_centroids", lambda c: F.struct(squared_distance(F.col(vector), c["centroid"]).alias("d"), c["cluster"].alias("cluster"))
        )
    )
    return joined.withColumn("cluster", nearest["cluster"]).drop("_centroids")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d
    )


def locate(vectors: DataFrame, centroids: DataFrame, tree_id: str, vector: str = "embedding") -> DataFrame:
    """The path of each vector down the tree, one level per round, until no row moves.

    While all centroids of the tree fit a broadcast, the levels are narrow passes over the vectors, `PLAN_LEVELS` of them
    in a plan; otherwise each level shuffles them and is written out. A row whose node has no centroids stays there.
    """
    centroids = cut_lineage(centroids)
    depths, size = centroids.agg(F.max(F.size("path")), F.sum(8 * F.size("centroid"))).first()
    narrow = (size or 0) <= BROADCAST_BYTES
    current = vectors.withColumns({"tree_id": F.lit(tree_id), "path": F.array().cast("array<int>")})
    for depth in range(0 if depths is None else depths + 1):
        moved = nearest_clusters(current, centroids.filter(F.size("path") == depth), vector, "left")
        further = F.when(F.col("cluster").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("cluster").cast("int")))
        current = moved.withColumn("path", further).drop("cluster")
        current = current if narrow and (depth + 1) % PLAN_LEVELS else cut_lineage(current)
    return current.select("tree_id", "instance_id", "path")


def best_cluster_count(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """the count with the best silhouette, the first on ties; none unless it is above zero."""
    best = F.max_by("k", F.struct("silhouette", -F.col("k")))
    return scores.groupBy(*keys).agg(best.alias("k"), F.max("silhouette").alias("silhouette")).filter("silhouette > 0")


_BLOCK = "tree_id string, path array<int>, n int, ids binary, vectors binary, draws binary"
Node = tuple[str, tuple[int, ...]]
# The centroids of each count.
Fits = dict[Node, dict[int, np.ndarray]]


class _Block:
    """Some rows of one node: ids, vectors and the draws that choose starts."""

    def __init__(self, row: dict) -> None:
        n = row["n"]
        self.node: Node = row["tree_id"], tuple(row["path"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float32).reshape(n, -1)
        self.draws = np.frombuffer(row["draws"], np.float64).reshape(n, -1)


class _Packed:
    """Collects rows of nodes and gives them out as blocks of bounded size."""

    def __init__(self, block_bytes: int) -> None:
        self.block_bytes = block_bytes
        self.held: dict[Node, list[tuple[np.ndarray, ...]]] = {}
        self.bytes: dict[Node, int] = {}

    def add(self, node: Node, ids: np.ndarray, x: np.ndarray, draws: np.ndarray) -> Iterator[dict]:
        for a in range(0, len(ids), step := max(1, self.block_bytes // max(4 * x.shape[1], 1))):
            part = ids[a : a + step], x[a : a + step], draws[a : a + step]
            self.held.setdefault(node, []).append(part)
            self.bytes[node] = self.bytes.get(node, 0) + part[1].nbytes
            if self.bytes[node] >= self.block_bytes:
                yield self.block(node)
        # Many small nodes are not held longer than eight blocks' worth.
        if sum(self.bytes.values()) > 8 * self.block_bytes:
            yield from self.rest()

    def block(self, node: Node) -> dict:
        del self.bytes[node]
        ids, x, draws = (np.concatenate(parts) for parts in zip(*self.held.pop(node)))
        return {"tree_id": node[0], "path": list(node[1]), "n": len(ids), "ids": ids.tobytes(), "vectors": x.astype(np.float32).tobytes(), "draws": draws.tobytes()}

    def rest(self) -> Iterator[dict]:
        for node in list(self.held):
            yield self.block(node)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _block_pass(blocks: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], ddl: str) -> DataFrame:
    """Rows that `work` makes of the blocks of a task."""
    schema = _arrow_schema(ddl)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for row in work(row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
            made.append(row)
            if len(made) >= 64:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        yield pa.RecordBatch.from_pylist(made, schema)

    return blocks.mapInArrow(scan, ddl)


def _blocks_of(rows: DataFrame, tree_id: str, block_bytes: int) -> DataFrame:
    """instance_id, embedding, draws -> blocks of the root."""
    schema = _arrow_schema(_BLOCK)

    def matrix(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().to_numpy().reshape(n, -1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _Packed(block_bytes)
        for batch in batches:
            if batch.num_rows:
                ids, x, draws = batch.column(0).to_numpy(), *(matrix(batch.column(k), batch.num_rows) for k in (1, 2))
                for row in packed.add((tree_id, ()), ids, x, draws):
                    yield pa.RecordBatch.from_pylist([row], schema)
        yield pa.RecordBatch.from_pylist(list(packed.rest()), schema)

    return rows.mapInArrow(scan, _BLOCK)


@contextlib.contextmanager
def _shared(blocks: DataFrame, value: object) -> Iterator[Broadcast]:
    """`value` in every task, for the passes made meanwhile."""
    held = blocks.sparkSession.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()


def _node(row: dict) -> Node:
    return row["tree_id"], tuple(row["path"])


def _moments(blocks: DataFrame) -> dict[Node, dict]:
    """Per node the size, the first start and the tolerance of its fits."""

    def work(found: Iterator[dict]) -> Iterator[dict]:
        for block in map(_Block, found):
            x, at = block.x.astype(float), kmeans.first_in(block.draws[:, 0], block.ids)
            yield {"tree_id": block.node[0], "path": list(block.node[1]), "n": len(x), "total": x.sum(0), "squares": (x * x).sum(0), "share": block.draws[at, 0], "id": block.ids[at], "centroid": x[at]}

    each = _block_pass(blocks, work, "tree_id string, path array<int>, n bigint, total array<double>, squares array<double>, share double, id bigint, centroid array<double>")
    mean = lambda column: F.transform(column, lambda x: x / F.col("size"))
    variance = F.zip_with(mean(F.col("squares")), mean(F.col("total")), lambda s, m: F.greatest(s - m * m, F.lit(0.0)))
    summed = each.groupBy(*NODE).agg(
        F.sum("n").alias("size"), _added("total"), _added("squares"), F.min_by("centroid", F.struct("share", "id")).alias("centroid")
    )
    spread = F.aggregate(variance, F.lit(0.0), lambda total, x: total + x) / F.size("total")
    found = summed.select(*NODE, "size", "centroid", F.round(kmeans.TOLERANCE * spread, 12).alias("tolerance"))
    return {_node(row): row for row in found.toArrow().to_pylist()}


def _added(column: str) -> Column:
    return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(column))["sum"]).alias(column)


def _further_start(blocks: DataFrame, found: dict[Node, np.ndarray], number: int) -> dict[Node, list[float]]:
    """One more start per node, drawn in proportion to the distance to the nearest so far."""
    with _shared(blocks, found) as held:

        def work(rows: Iterator[dict]) -> Iterator[dict]:
            for block in map(_Block, rows):
                x = block.x.astype(float)
                arrival = kmeans.race(block.draws[:, number], kmeans.distances(x, held.value[block.node]).min(1))
                at = kmeans.first_in(arrival, block.ids)
                if np.isfinite(arrival[at]):
                    yield {"tree_id": block.node[0], "path": list(block.node[1]), "arrival": arrival[at], "id": block.ids[at], "centroid": x[at]}

        drawn = _block_pass(blocks, work, "tree_id string, path array<int>, arrival double, id bigint, centroid array<double>")
        first = drawn.groupBy(*NODE).agg(F.min_by("centroid", F.struct("arrival", "id")).alias("centroid"))
        return {_node(row): row["centroid"] for row in first.toArrow().to_pylist()}


def _starts(blocks: DataFrame, moments: dict[Node, dict], max_children: int) -> dict[Node, np.ndarray]:
    """First centroids of every node: count k takes the first k of them, so one round per start serves all."""
    found = {node: np.array([row["centroid"]]) for node, row in moments.items()}
    for number in range(1, max_children):
        drawn = _further_start(blocks, found, number)
        if not drawn:
            break
        found |= {node: np.vstack([found[node], start]) for node, start in drawn.items()}
    return found


def _cluster_sums(blocks: DataFrame, fits: Fits, unit: bool = False) -> dict[tuple[Node, int], tuple[np.ndarray, np.ndarray]]:
    """Rows and vector sum, of the (unit) vectors, of each cluster, per node and count; a task adds up its blocks first."""
    with _shared(blocks, fits) as shared:

        def work(rows: Iterator[dict]) -> Iterator[dict]:
            held: dict[tuple, list[np.ndarray]] = {}
            for row in rows:
                if _node(row) not in shared.value:
                    continue
                block = _Block(row)
                x = block.x.astype(float)
                for k, centres in shared.value[block.node].items():
                    added = kmeans.cluster_sums(kmeans.units(x) if unit else x, kmeans.nearest(x, centres), len(centres))
                    held[block.node, k] = [a + b for a, b in zip(held[block.node, k], added)] if (block.node, k) in held else list(added)
            for (node, k), (counts, sums) in held.items():
                for cluster in np.flatnonzero(counts):
                    yield {"tree_id": node[0], "path": list(node[1]), "k": k, "cluster": int(cluster), "n": counts[cluster], "total": sums[cluster]}

        each = _block_pass(blocks, work, "tree_id string, path array<int>, k int, cluster int, n bigint, total array<double>")
        summed = each.groupBy(*NODE, "k", "cluster").agg(F.sum("n").alias("n"), _added("total")).toArrow()
    found = {(node, k): (np.zeros(len(centres), int), np.zeros(centres.shape)) for node, counts in fits.items() for k, centres in counts.items()}
    totals = summed.column("total").combine_chunks().flatten().to_numpy().reshape(summed.num_rows, -1) if summed.num_rows else ()
    for row, total in zip(summed.drop_columns("total").to_pylist(), totals):
        counts, sums = found[_node(row), row["k"]]
        counts[row["cluster"]], sums[row["cluster"]] = row["n"], total
    return found


def fit_nodes(blocks: DataFrame, max_children: int = MAX_CHILDREN, steps: int | None = None) -> Fits:
    """k-means of all nodes for all their counts at once, until every fit has settled.

    A step is one pass over the blocks; only sums per cluster leave the tasks, and the driver moves the centroids.
    Settled fits leave the later steps; one that is open after `steps` steps, if given, is an error.
    """
    moments = _moments(blocks)
    first = _starts(blocks, moments, max_children)
    fits = {
        (node, k): kmeans.Fit(first[node][:k], row["tolerance"]) for node, row in moments.items() for k in range(2, min(row["size"] - 1, max_children) + 1)
    }
    while still := {key: fit for key, fit in fits.items() if not fit.settled}:
        if any(fit.steps == steps for fit in still.values()):
            raise RuntimeError(f"{len(still)} k-means fits have not settled after {steps} steps")
        sums = _cluster_sums(blocks, _by_node(still))
        for key, fit in still.items():
            fit.step(*sums[key])
    return _by_node(fits)


def _by_node(fits: dict[tuple[Node, int], kmeans.Fit]) -> Fits:
    found: Fits = {}
    for (node, k), fit in fits.items():
        found.setdefault(node, {})[k] = fit.centroids
    return found


def _chosen_counts(blocks: DataFrame, fits: Fits) -> tuple[Fits, dict[Node, np.ndarray]]:
    """F7 per node: the fit of its best count and that fit's clusters with rows, absent for nodes that are not split."""
    sums = _cluster_sums(blocks, fits, unit=True)
    whole = {node for (node, _), (counts, _) in sums.items() if np.count_nonzero(counts) < 2}
    with _shared(blocks, (fits, sums)) as shared:

        def work(rows: Iterator[dict]) -> Iterator[dict]:
            fits, sums = shared.value
            for row in rows:
                if _node(row) not in fits:
                    continue
                block = _Block(row)
                x = block.x.astype(float)
                unit = kmeans.units(x)
                for k, centres in fits[block.node].items():
                    n, total = sums[block.node, k]
                    scores = kmeans.cosine_scores(unit, kmeans.nearest(x, centres), n.astype(float), total)
                    yield {"tree_id": block.node[0], "path": list(block.node[1]), "k": k, "score": scores.sum(), "n": len(x)}

        each = _block_pass(blocks, work, "tree_id string, path array<int>, k int, score double, n bigint")
        scores = each.groupBy(*NODE, "k").agg(F.round(F.sum("score") / F.sum("n"), kmeans.DIGITS).alias("silhouette"))
        best = {_node(row): row["k"] for row in best_cluster_count(scores, tuple(NODE)).toArrow().to_pylist()}
    best = {node: k for node, k in best.items() if node not in whole}
    return {node: {k: fits[node][k]} for node, k in best.items()}, {node: np.flatnonzero(sums[node, k][0]) for node, k in best.items()}


def _children(blocks: DataFrame, chosen: Broadcast, block_bytes: int) -> DataFrame:
    """The rows of split nodes as blocks of their children."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        packed = _Packed(block_bytes)
        for row in rows:
            if _node(row) not in chosen.value:
                continue
            block = _Block(row)
            [centres] = chosen.value[block.node].values()
            labels = kmeans.nearest(block.x.astype(float), centres)
            for cluster in np.unique(labels).tolist():
                at = labels == cluster
                yield from packed.add((block.node[0], (*block.node[1], cluster)), block.ids[at], block.x[at], block.draws[at])
        yield from packed.rest()

    return _block_pass(blocks, work, _BLOCK)


_PART = "tree_id string, path array<int>, instance_id bigint, cluster int, centroid array<double>"


def _subtrees(blocks: DataFrame, max_children: int, steps: int | None) -> DataFrame:
    """Leaf rows and centroids below nodes that fit a task, each node split to its end where its blocks meet."""
    schema = _arrow_schema(_PART)

    def grow(table: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = [_Block(row) for row in table.to_pylist()]
        ids, x, draws = (np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "x", "draws"))
        order = np.argsort(ids, kind="stable")
        tree = parts[0].node[0]
        for path, leaf, clusters, centroids in kmeans.subtree(x[order].astype(float), ids[order], draws[order], list(parts[0].node[1]), max_children, steps):
            if leaf is not None:
                rows = [{"tree_id": tree, "path": path, "instance_id": int(i)} for i in leaf]
            else:
                rows = [{"tree_id": tree, "path": path, "cluster": c, "centroid": v} for c, v in zip(clusters, centroids)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(grow(table), schema)

    return blocks.groupBy(*NODE).applyInArrow(whole, _PART)


def build_tree(
    vectors: DataFrame,
    tree_id: str = "tree",
    max_children: int = MAX_CHILDREN,
    seed: int = SEED,
    steps: int | None = None,
    task_bytes: int = TASK_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Cluster recursively; returns the leaf table and the centroids of every clustered node.

    `vectors` has `instance_id` and `embedding`, all of one length. A node is split by k-means with k-means++ starts,
    until it settles, for every allowed count; the count with the best cosine silhouette wins. A node stops when it
    has two rows or fewer, when a fit gives a single label, or when no count has a positive silhouette; its rows then hang
    under it as one group.

    Rows travel in blocks. The nodes of a depth with more than `task_bytes` of vectors are split together, over as
    many tasks as there are blocks, and their centroids, at most `FIT_BYTES` at a time, meet in the driver at each step;
    a smaller node is split to its end in one task. Both take the same steps and give the same tree.
    """
    share = lambda i: (F.conv(F.substring(seeded_hash(seed + i, F.col("instance_id").cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    rows = vectors.select(
        F.col("instance_id").cast("bigint").alias("instance_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.array(*[share(i) for i in range(max_children)]).alias("draws"),
    )
    spark = vectors.sparkSession
    blocks = cut_lineage(_blocks_of(rows, tree_id, block_bytes))
    # A table in one file comes in one task: its blocks are dealt out, since every step goes over them.
    if blocks.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        blocks = cut_lineage(blocks.repartition(cores))
    parts: list[DataFrame] = [spark.createDataFrame([], _PART)]
    while not blocks.isEmpty():
        sizes = cut_lineage(blocks.groupBy(*NODE).agg((F.sum(F.length("vectors")) <= task_bytes).alias("small"), (F.sum("n") <= 2).alias("ends")))
        known = blocks.join(broadcast_if_small(sizes, 200), NODE)
        parts.append(cut_lineage(_subtrees(known.filter("small OR ends").select(*blocks.columns), max_children, steps)))
        large = cut_lineage(known.filter("NOT small AND NOT ends").select(*blocks.columns))
        below = [blocks.limit(0)]
        for some in _waves(large, max_children):
            chosen, filled = _chosen_counts(some, fit_nodes(some, max_children, steps))
            with _shared(some, chosen) as held:
                parts.append(cut_lineage(_leaf_rows(some, held)))
                below.append(cut_lineage(_children(some, held, block_bytes)))
            split = [(*node, None, int(c), centres[c].tolist()) for node, [centres] in ((node, fit.values()) for node, fit in chosen.items()) for c in filled[node]]
            parts.append(spark.createDataFrame(split, _PART))
        blocks = functools.reduce(DataFrame.unionByName, below)
    every = functools.reduce(DataFrame.unionByName, parts)
    leaves = every.filter("instance_id IS NOT NULL").select("tree_id", "instance_id", "path")
    return leaves, every.filter("centroid IS NOT NULL").select(*NODE, "cluster", "centroid")


def _waves(blocks: DataFrame, max_children: int) -> Iterator[DataFrame]:
    """The blocks of as many nodes at a time as have centroids of at most `FIT_BYTES` in all."""
    width = F.max(2 * F.length("vectors") / F.col("n")).alias("width")
    nodes = blocks.groupBy(*NODE).agg(width).toArrow().to_pylist()
    most = max(1, int(FIT_BYTES // max([1, *(row["width"] * sum(range(2, max_children + 1)) for row in nodes)])))
    if len(nodes) <= most:
        yield from [blocks] if nodes else []
        return
    for a in range(0, len(nodes), most):
        some = blocks.sparkSession.createDataFrame([_node(row) for row in nodes[a : a + most]], "tree_id string, path array<int>")
        yield cut_lineage(blocks.join(F.broadcast(some), NODE, "left_semi").select(*blocks.columns))


def _leaf_rows(blocks: DataFrame, chosen: Broadcast) -> DataFrame:
    """The rows of nodes that stay whole."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for block in map(_Block, (row for row in rows if _node(row) not in chosen.value)):
            for i in block.ids.tolist():
                yield {"tree_id": block.node[0], "path": list(block.node[1]), "instance_id": i}

    return _block_pass(blocks, work, _PART)
