"""Density clustering, quality gates and internal measures of cluster quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.vector import centroids, norm, scaled, vector_sums

from .blocks import dealt, facing, matrix, met
from .dedup import checkpointed

#: Smallest cluster and neighbours for core distances, of the two presets; gates on members and cohesion.
MIN_CLUSTER_SIZE, MIN_SAMPLES = 3, 2
LEGACY = (2, 1)
MIN_ARTICLES, MIN_COHESION = 3, 0.78
#: Points of a block, of which two meet in a task; ranges of blocks whose trees are merged at a time.
BLOCK, FAN = 8_192, 8


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0))


def nearest(x: np.ndarray, y: np.ndarray | None, k: int) -> np.ndarray:
    """The k smallest distances of each row of x to rows of y, or to the other rows of x; infinite where there are fewer."""
    other = x if y is None else y
    out = np.full((len(x), k), np.inf)
    for i in range(0, len(x), 1024):
        d = _distances(x[i : i + 1024], other)
        if y is None:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        d = np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d
        out[i : i + 1024, : d.shape[1]] = d
    return out


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, weight) of a minimum spanning tree under mutual reachability: the largest of a pair's distance and both core
    distances, which are those to the min_samples-th neighbour. Prim's algorithm, with one row of distances in memory."""
    n = len(x)
    squares = (x * x).sum(axis=1)
    best, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at, out = 0, []
    left[0] = False
    for _ in range(n - 1):
        row = np.sqrt(np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0))
        reach = np.maximum(np.maximum(row, core), core[at])
        closer = left & (reach < best)
        best[closer], parent[closer] = reach[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        out.append((parent[at], at, best[at]))
        left[at] = False
    a, b, w = zip(*out, strict=True) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w, float)


def lightest_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges a minimum spanning forest keeps: lightest first, in the given order on ties, those that join two trees."""
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    kept = []
    for e in np.argsort(w, kind="stable").tolist():
        u, v = find(int(a[e])), find(int(b[e]))
        if u != v:
            top[u] = v
            kept.append(e)
    return np.array(kept, np.int64)


def hdbscan_labels(x: np.ndarray, min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int = MIN_SAMPLES, single: bool = False) -> np.ndarray:
    """Labels of a few points by hierarchical density clustering, as tree_labels gives them."""
    x = np.asarray(x, np.float64)
    if len(x) < 2:
        return np.full(len(x), -1, np.int64)
    core = nearest(x, None, min(min_samples, len(x) - 1)).max(axis=1)
    return tree_labels(len(x), *spanning_tree(x, core), min_cluster_size, single)


def tree_labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, min_cluster_size: int = MIN_CLUSTER_SIZE, single: bool = False) -> np.ndarray:
    """Labels of n points from their minimum spanning tree; -1 is noise. Clusters are chosen by excess of mass, and numbered by first member.

    single: whether the whole set may be one cluster.
    """
    labels = np.full(n, -1, np.int64)
    if n < max(2, min_cluster_size):
        return labels
    order = np.argsort(w, kind="stable")
    # The dendrogram: nodes n.. are merges, in order of weight.
    top, kids, size, height = list(range(2 * n - 1)), {}, [1] * n + [0] * (n - 1), {}

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for node, e in enumerate(order.tolist(), n):
        u, v = find(int(a[e])), find(int(b[e]))
        top[u] = top[v] = node
        kids[node], size[node], height[node] = (u, v), size[u] + size[v], w[e]
    root = 2 * n - 2

    def leaves(node: int) -> list[int]:
        stack, found = [node], []
        while stack:
            i = stack.pop()
            stack.extend(kids[i]) if i >= n else found.append(i)
        return found

    # Condensed: a split counts only if both sides are large enough; else the small side falls out of the cluster.
    density = lambda d: 1 / d if d > 0 else np.inf
    born, stability, below, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    stack, count = [(root, 0)], 1
    while stack:
        node, cluster = stack.pop()
        u, v = kids[node]
        at = density(height[node])
        gain = lambda points: points * (min(at, 1e12) - born[cluster])  # noqa: E731, B023
        if size[u] >= min_cluster_size and size[v] >= min_cluster_size:
            stability[cluster] += gain(size[node])
            for child in (u, v):
                born[count], stability[count], below[count], members[count] = min(at, 1e12), 0.0, [], []
                below[cluster].append(count)
                stack.append((child, count)) if child >= n else members[count].append(child)
                count += 1
            continue
        for child in (u, v):
            if size[child] >= min_cluster_size:
                stack.append((child, cluster))
            else:
                stability[cluster] += gain(size[child])
                members[cluster].extend(leaves(child))
    chosen: set[int] = set()
    best = dict(stability)
    for cluster in range(count - 1, -1, -1):
        under = sum(best[c] for c in below[cluster])
        if below[cluster] and under > stability[cluster] or cluster == 0 and not single:
            best[cluster] = under
        else:
            chosen.add(cluster)
    groups, stack = [], [0]
    while stack:
        cluster = stack.pop()
        if cluster not in chosen:
            stack.extend(below[cluster])
            continue
        own, inner = [], [cluster]
        while inner:
            c = inner.pop()
            own += members[c]
            inner += below[c]
        groups.append(sorted(own))
    for label, own in enumerate(sorted(groups)):
        labels[own] = label
    return labels


def hdbscan(df: DataFrame, key: str = "article_id", vector: str = "embedding", group: str | None = None, min_cluster_size: int = MIN_CLUSTER_SIZE,
            min_samples: int = MIN_SAMPLES, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """(group, key, cluster_id) of the rows with a vector, by group (one for all by default). most: points of a group beyond which
    the work is refused, where a caller sets it.

    Exact, and quadratic as the method is, but in tasks of two blocks each, which read them from the shared folder, where each lies once: blocks meet for the core distances, then for spanning
    trees under mutual reachability. The trees of all pairs hold the tree of the whole; they are merged by ever larger ranges of
    blocks, so that vectors of at most two blocks and edges in proportion to a range's points are in a task. Only the last steps,
    a group's tree and its labels, are one task a group, over one edge a point.
    """
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"  # matrices are of doubles
    rows = df.where(F.col(vector).isNotNull()).select((F.col(group) if group else F.lit(0)).alias("grp"), F.col(key).alias("id"), F.col(vector).cast(kind).alias("v"))
    kinds = dict(rows.dtypes)
    point, edge = f"grp {kinds['grp']}, id {kinds['id']}", f"grp {kinds['grp']}, i int, j int, a {kinds['id']}, b {kinds['id']}, w double"
    if most is not None:
        largest = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
        if largest > most:
            raise ValueError(f"{largest} points in a group; at most {most}")
    placed, blocks, _ = dealt(rows, "grp", "id", block)

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        return pa.table({"grp": t["grp"], "id": t["id"], "cluster_id": pa.array(hdbscan_labels(matrix(t["v"]), min_cluster_size, min_samples), pa.int32())})

    if blocks <= 1:  # no group has more than a block: the same steps without meetings
        return rows.groupBy("grp").applyInArrow(whole, f"{point}, cluster_id int").withColumnRenamed("id", key)

    def near(t: pa.Table) -> pa.Table:
        x, own = matrix(t["v"]), t["__b"].to_numpy() == t["__i"][0].as_py()
        if own.all():
            d, at = (nearest(x, None, min_samples) if t["__i"][0] == t["__j"][0] else np.full((len(x), min_samples), np.inf)), np.arange(len(x))
        else:
            d, at = np.concatenate([nearest(x[own], x[~own], min_samples), nearest(x[~own], x[own], min_samples)]), np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
        some = np.isfinite(d)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], some.sum(axis=1).cumsum()]), pa.int32()), pa.array(d[some]))
        return pa.table({"grp": t["grp"].take(pa.array(at)), "id": t["id"].take(pa.array(at)), "near": lists})

    def tree(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")  # of equal edges the choice is free, but reruns are to agree
        a, b, w = spanning_tree(matrix(t["v"]), t["core"].to_numpy())
        n = len(a)
        return pa.table({"grp": t["grp"].slice(0, n), "i": t["__i"].slice(0, n), "j": t["__j"].slice(0, n), "a": t["id"].take(pa.array(a)), "b": t["id"].take(pa.array(b)), "w": w})

    def merged(t: pa.Table) -> pa.Table:
        t = t.sort_by(lightest)
        nodes, a, b = _numbered(t)
        return t.take(pa.array(lightest_forest(len(nodes), a, b, t["w"].to_numpy())))

    def labelled(t: pa.Table) -> pa.Table:
        t = t.sort_by(lightest)
        nodes, a, b = _numbered(t)
        labels = tree_labels(len(nodes), a, b, t["w"].to_numpy(), min_cluster_size)
        return pa.table({"grp": pa.repeat(t["grp"][0], len(nodes)), "id": nodes, "cluster_id": pa.array(labels, pa.int32())})

    lightest = [(c, "ascending") for c in ("w", "a", "b")]
    spread = placed.where("__n > 1")
    close = met(spread, near, f"{point}, near array<double>", "id", "v")
    close = close.groupBy("grp", "id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("d"))
    cores = close.select(F.col("grp").alias("__g"), F.col("id").alias("__k"), F.get("d", F.least(F.lit(min_samples), F.size("d")) - 1).alias("core"))
    known = spread.join(cores, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("id") == F.col("__k"))).where("core is not null").drop("__g", "__k")
    edges = met(known, tree, edge, "id", "v", "core", apart=True)
    while blocks > 1:
        blocks = -(-blocks // FAN)
        wider = edges.select("grp", F.floor(F.col("i") / FAN).cast("int").alias("i"), F.floor(F.col("j") / FAN).cast("int").alias("j"), "a", "b", "w")
        edges = wider.groupBy("grp", "i", "j").applyInArrow(merged, edge)
    labels = edges.groupBy("grp").applyInArrow(labelled, f"{point}, cluster_id int")
    labels = labels.union(placed.where("__n = 1").select("grp", "id", "v").groupBy("grp").applyInArrow(whole, f"{point}, cluster_id int"))
    labels = labels.select(F.col("grp").alias("__g"), F.col("id").alias("__k"), F.col("cluster_id").alias("__l"))
    out = rows.select("grp", "id").join(labels, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("id") == F.col("__k")), "left")
    return out.select("grp", F.col("id").alias(key), F.coalesce("__l", F.lit(-1)).alias("cluster_id"))


def _numbered(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The sorted ends of edges, and both ends as places among them."""
    nodes = pc.unique(pa.chunked_array([*t["a"].chunks, *t["b"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    return nodes, *[pc.index_in(t[c], nodes).to_numpy().astype(np.int64) for c in ("a", "b")]


def candidates(articles: DataFrame, as_of, days: int = 14) -> DataFrame:
    """What is clustered: embedded, no duplicate, not in an event, taken in within some days."""
    start = as_of - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(0))
    return articles.where(F.col("embedding").isNotNull() & ~F.col("is_duplicate") & F.col("event_id").isNull() & (F.col("ingested_at") >= start))


def unembedded(articles: DataFrame) -> DataFrame:
    """What is still to be embedded: no vector yet, and no duplicate."""
    return articles.where(F.col("embedding").isNull() & ~F.coalesce("is_duplicate", F.lit(False)))


def gated(df: DataFrame, cluster: str, vector: str, least: int = MIN_ARTICLES, cohesion: float = MIN_COHESION) -> DataFrame:
    """(cluster, n, centroid, cohesion) of clusters with enough members that are alike enough; noise is none."""
    rows = centroids(df.where(F.col(cluster) != -1), cluster, vector)
    return rows.where((F.col("n") >= least) & (F.col("cohesion") >= cohesion))


def silhouette(df: DataFrame, cluster: str, vector: str, key: str) -> DataFrame:
    """(key, cluster, silhouette) by cosine distance for unit vectors: a member's mean distance to a cluster is one less its dot
    with the cluster's mean, so each is compared with the clusters' sums and not with all members. A singleton has 0, and so has a
    row without a cluster or vector. Blocks of rows meet blocks of clusters; a row leaves each with one result."""
    sums = checkpointed(vector_sums(df.where(F.col(cluster).isNotNull()), cluster, vector).select(F.col(cluster).alias("c"), "n", F.col("sum").alias("v")))
    rows = df.select(F.col(key).alias("k"), F.col(cluster).alias("own"), F.col(vector).alias("v"))
    kinds = dict(rows.dtypes)

    def away(t: pa.Table, s: pa.Table) -> pa.Table:
        if not len(t) or not len(s):
            return t.select(["k", "own"]).append_column("a", pa.nulls(len(t), pa.float64())).append_column("b", pa.nulls(len(t), pa.float64()))
        x, y, n = matrix(t["v"]), matrix(s["v"]), s["n"].to_numpy().astype(float)
        own = pc.fill_null(pc.index_in(t["own"], s["c"].combine_chunks(), skip_nulls=True), -1).to_numpy().astype(np.int64)
        a, b = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for i in range(0, len(x), 1024):
            part, at = x[i : i + 1024], own[i : i + 1024]
            dots, mine = part @ y.T, np.flatnonzero(at >= 0)
            inside = mine[n[at[mine]] > 1]
            a[i + inside] = 1 - (dots[inside, at[inside]] - (part[inside] ** 2).sum(axis=1)) / (n[at[inside]] - 1)
            others = 1 - dots / n
            others[mine, at[mine]] = np.inf
            b[i : i + len(part)] = others.min(axis=1)
        b[np.isinf(b)] = np.nan
        return t.select(["k", "own"]).append_column("a", pa.array(a, from_pandas=True)).append_column("b", pa.array(b, from_pandas=True))

    some = facing(rows.where("v is not null"), sums, "k", "c", away, f"k {kinds['k']}, own {kinds['own']}, a double, b double")
    bare = rows.where("v is null").select("k", "own", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    both = some.union(bare).groupBy("k", "own").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return both.select(F.col("k").alias(key), F.col("own").alias(cluster), value.alias("silhouette"))


def _means(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    return vector_sums(df, cluster, vector).select(F.col(cluster).alias("c"), "n", "squares", scaled(F.col("sum"), 1 / F.col("n")).alias("mean"))


def _apart(a, b):
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y))


def davies_bouldin(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of two clusters' spreads to their distance (euclidean). Blocks of
    clusters meet; a cluster leaves each meeting with its worst ratio."""
    means = _means(df, cluster, vector).select("c", "mean")
    spread = df.select(F.col(cluster).alias("c"), vector).join(means, "c").groupBy("c").agg(F.avg(_apart(F.col(vector), F.col("mean"))).alias("s"))
    one = checkpointed(means.join(spread, "c"))  # a row a cluster, read three times
    kind = dict(one.dtypes)["c"]

    def worst(t: pa.Table, u: pa.Table) -> pa.Table:
        if not len(t) or not len(u):
            return pa.table({"c": t["c"].slice(0, 0), "r": pa.array([], pa.float64())})
        x, y, s, z = matrix(t["mean"]), matrix(u["mean"]), t["s"].to_numpy(), u["s"].to_numpy()
        same = pc.fill_null(pc.index_in(t["c"], u["c"].combine_chunks()), -1).to_numpy().astype(np.int64)
        r = np.empty(len(x))
        for i in range(len(x)):
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (s[i] + z) / np.sqrt(((y - x[i]) ** 2).sum(axis=1))
            if same[i] >= 0:
                ratio[same[i]] = np.nan
            r[i] = np.fmax.reduce(ratio)
        return pa.table({"c": t["c"], "r": pa.array(r, from_pandas=True)})

    met = facing(one, one, "c", "c", worst, f"c {kind}, r double", (BLOCK, BLOCK))
    return met.groupBy("c").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """One row: dispersion between clusters over that within, each by its degrees of freedom."""
    means = _means(df, cluster, vector)
    whole = vector_sums(df.withColumn("__all", F.lit(1)), "__all", vector).select(F.col("n").alias("total"), scaled(F.col("sum"), 1 / F.col("n")).alias("grand"))
    rows = means.join(F.broadcast(whole))  # one row
    rows = rows.select("n", "total", (F.col("n") * F.pow(_apart(F.col("mean"), F.col("grand")), 2)).alias("between"), (F.col("squares") - F.col("n") * F.pow(norm(F.col("mean")), 2)).alias("within"))
    out = rows.agg(F.sum("between").alias("b"), F.sum("within").alias("w"), F.count("*").alias("k"), F.max("total").alias("n"))
    return out.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def worst_clusters(df: DataFrame, cluster: str, vector: str, key: str, n: int = 10) -> DataFrame:
    """The n clusters of the lowest mean silhouette, with size and cohesion."""
    scores = silhouette(df, cluster, vector, key).groupBy(cluster).agg(F.avg("silhouette").alias("silhouette"))
    rows = scores.join(centroids(df, cluster, vector).select(cluster, "n", "cohesion"), cluster)
    return rows.orderBy(F.round("silhouette", 9), cluster).limit(n)


def baseline(df: DataFrame, cluster: str, vector: str, key: str) -> DataFrame:
    """(metric, value): the measures that runs are compared by; noise is in cluster -1. Shares are of 1."""
    clustered = df.where(F.col(cluster) != -1)
    fit = silhouette(clustered, cluster, vector, key).groupBy(cluster).agg(F.sum("silhouette").alias("s"), F.count("*").alias("n"))
    number = lambda x, name: x.cast("double").alias(name)
    parts = [
        df.agg(
            number(F.count("*"), "records"), number(F.count_if(F.col(cluster) != -1), "clustered"), number(F.count_if(F.col(cluster) == -1), "noise"),
            F.avg((F.col(cluster) == -1).cast("double")).alias("noise_share"), number(F.max(F.size(vector)), "dimensions"),
        ),
        fit.agg(number(F.count_if(F.col("s") < 0), "negative_clusters"), (F.sum("s") / F.sum("n")).alias("silhouette")),
        centroids(clustered, cluster, vector).agg(
            number(F.count("*"), "clusters"), number(F.median("n"), "median_size"), number(F.max("n"), "largest_size"),
            F.avg("cohesion").alias("mean_cohesion"), F.median("cohesion").alias("median_cohesion"), F.min("cohesion").alias("min_cohesion"),
        ),
        davies_bouldin(clustered, cluster, vector), calinski_harabasz(clustered, cluster, vector),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.join(part)  # one row each
    return row.unpivot([], row.columns, "metric", "value")
