"""Density clusters against a version of their own: all distances, components by threshold, and the best choice of clusters by trying."""

import numpy as np
import pytest

from tidewatch.operators import clustering


def brute(x: np.ndarray, least: int, k: int) -> list[frozenset[int]]:
    """Clusters of points, by definition. A set of points falls apart where its longest needed edge is taken out; parts that are too small are
    noise from there on; a cluster is worth the points it holds times the density that they last, and the disjoint choice of clusters that is worth most wins.
    No tree is built: the parts of a set are found anew from all of its distances."""
    n = len(x)
    d = np.array([[np.linalg.norm(a - b) for b in x] for a in x])
    core = np.array([sorted(np.delete(d[i], i))[min(k, n - 1) - 1] for i in range(n)])
    reach = np.maximum(d, np.maximum.outer(core, core))

    def parts(own: list[int], limit: float) -> list[list[int]]:
        left, out = set(own), []
        while left:
            part, edge = [], [left.pop()]
            while edge:
                i = edge.pop()
                part.append(i)
                near = {j for j in left if reach[i, j] < limit}
                left -= near
                edge += near
            out.append(sorted(part))
        return out

    def falls(own: list[int]) -> tuple[float, list[list[int]]]:
        """The largest distance at which the set is no longer whole, and its parts below it."""
        for limit in sorted({reach[i, j] for i in own for j in own if i < j}, reverse=True):
            if len(found := parts(own, limit)) > 1:
                return limit, found
        raise AssertionError

    def best(own: list[int], born: float, top: bool = False) -> tuple[float, list[frozenset[int]]]:
        now, worth = own, 0.0
        while True:
            limit, found = falls(now)
            big = [p for p in found if len(p) >= least]
            stays = big[0] if len(big) == 1 else []
            worth += (len(now) - len(stays)) * (1 / limit - born)
            if not stays:
                break
            now = stays
        under = [best(p, 1 / limit) for p in big]
        total = sum(w for w, _ in under)
        if big and total > worth or top:
            return total, [c for _, own in under for c in own]
        return worth, [frozenset(own)]

    return best(list(range(n)), 0.0, True)[1] if n >= max(2, least) else []


def clusters(labels) -> set[frozenset[int]]:
    return {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist()) - {-1}}


@pytest.mark.parametrize("seed", range(25))
def test_by_definition_without_ties(seed):
    """One neighbour for the core distance: reachability is distance, and no two of random points are equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(rng.integers(1, 6), 3)) * rng.choice([1, 4, 10])
    x = np.concatenate([c + rng.normal(size=(rng.integers(3, 15), 3)) * rng.uniform(0.2, 2) for c in centres])
    for least in (2, 3, 5):
        got = clustering.hdbscan_labels(x, least, 1)
        assert clusters(got) == set(brute(x, least, 1)), (seed, least)


@pytest.mark.parametrize("seed", range(10))
def test_planted_groups_with_more_neighbours(seed):
    rng = np.random.default_rng(100 + seed)
    x = np.concatenate([rng.normal(size=4) * 30 + rng.normal(size=(rng.integers(6, 14), 4)) * 0.3 for _ in range(4)])
    for k in (2, 3):
        got, want = clusters(clustering.hdbscan_labels(x, 5, k)), set(brute(x, 5, k))
        assert got == want, (seed, k)


def test_blocks_by_definition(spark):
    """The work over blocks and tasks gives the same clusters, by group."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(3):
        x = np.concatenate([rng.normal(size=3) * 12 + rng.normal(size=(12, 3)) for _ in range(g + 1)])
        rows += [(g, 1000 * g + i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>")
    found = clustering.hdbscan(df, "id", "v", "g", 3, 1, block=8).collect()
    for g in range(3):
        x = np.array([v for h, _, v in rows if h == g])
        labels = np.array([c for _, c in sorted((r.id, r.cluster_id) for r in found if r.grp == g)])
        assert clusters(labels) == set(brute(x, 3, 1))
