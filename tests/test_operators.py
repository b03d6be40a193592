import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, moments
from tidewatch.functions.vector import centroids, cosine
from tidewatch.operators import classify, clustering, dedup, enrichment, lifecycle, lookups, nearest, registry, serve

NOW = datetime(2024, 6, 1)


def unit(v):
    return v / np.linalg.norm(v)


def group(seed, n, noise=0.005, size=64):
    base = unit(np.random.default_rng(seed).normal(size=size))
    rng = np.random.default_rng(seed + 1000)
    return [unit(base + rng.normal(size=size) * noise) for _ in range(n)]


def test_planted_clusters(spark):
    vectors = [*group(0, 6), *group(99, 6), *[9 * unit(np.random.default_rng(s).normal(size=64)) for s in range(500, 504)]]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "article_id long, embedding array<double>")
    found = {r.article_id: r.cluster_id for r in clustering.hdbscan(rows).collect()}
    assert len({found[i] for i in range(6)}) == 1 and len({found[i] for i in range(6, 12)}) == 1 and found[0] != found[6] and found[0] == 0
    assert all(found[i] == -1 for i in range(12, 16))
    assert set(clustering.hdbscan_labels(np.zeros((2, 3)))) == {-1}
    with pytest.raises(Exception, match="points in a group"):
        clustering.hdbscan(rows, most=3).collect()


def test_density_clusters_over_blocks(spark):
    """However points are dealt to blocks, the labels are those of all points at once."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.4, size=(40, 5)) for c in rng.normal(0, 3, size=(6, 5))] + [rng.normal(0, 6, size=(30, 5))])
    x[7] = x[3]
    rows = [(g, i, v.tolist()) for g, part in (("a", x), ("b", x[:2]), ("c", x[:1]), (None, x[40:110])) for i, v in enumerate(part)]
    df = spark.createDataFrame([*rows, ("a", 999, None)], "g string, article_id int, embedding array<double>")
    for block in (25, 64, 8192):
        found = {(r.grp, r.article_id): r.cluster_id for r in clustering.hdbscan(df, group="g", block=block).collect()}
        assert len(found) == len(rows)
        for g, part in (("a", x), ("b", x[:2]), ("c", x[:1]), (None, x[40:110])):
            assert [found[g, i] for i in range(len(part))] == clustering.hdbscan_labels(part).tolist(), (g, block)
    assert max(found.values()) > 2
    assert clustering.hdbscan(df.where("false")).collect() == []


def test_gates(spark):
    loose = [unit(np.random.default_rng(s).normal(size=64)) for s in range(6)]
    rows = [(c, v.tolist()) for c, vs in ((1, group(1, 5)), (2, loose), (3, group(3, 2)), (-1, group(4, 4))) for v in vs]
    df = spark.createDataFrame(rows, "c int, v array<double>")
    assert [r.c for r in clustering.gated(df, "c", "v").collect()] == [1]
    by = {r.c: r.cohesion for r in centroids(df, "c", "v").collect()}
    pairs = [float(a @ b) for i, a in enumerate(loose) for b in loose[:i]]
    assert by[1] > 0.95 and by[2] < 0.3 and math.isclose(by[2], np.mean(pairs), abs_tol=1e-12)
    one = centroids(spark.createDataFrame([(1, [0.0, 0.0])], "c int, v array<double>"), "c", "v").first()
    assert one.cohesion == 1 and one.centroid == [0, 0]


def articles(spark, rows):
    return spark.createDataFrame([(c, i, v.tolist(), t) for c, i, v, t in rows], "cluster_id int, article_id string, embedding array<double>, published_at timestamp")


def test_greedy_and_transitive(spark):
    a = unit(np.array([1.0, 0.0, 0.0]))
    b = unit(np.array([1.0, 0.33, 0.0]))
    c = unit(np.array([1.0, 0.75, 0.0]))  # near b, not near a
    h = lambda x: NOW + timedelta(hours=x)
    rows = [(1, "a", a, h(0)), (1, "b", b, h(1)), (1, "c", c, h(2)), (2, "a2", a, h(0)), (2, "in", a, h(72)), (2, "out", a, h(72) + timedelta(seconds=1)), (3, "n", a, None), (3, "m", a, h(500))]
    df = articles(spark, rows)
    greedy = {r.id: r.duplicate_of for r in dedup.greedy_duplicates(df, 0.94, 72).collect()}
    assert greedy == {"a": None, "b": "a", "c": None, "a2": None, "in": "a2", "out": None, "n": None, "m": "n"}
    whole = {r.id: r.canonical_id for r in dedup.transitive_duplicates(df, 0.90, 72).collect()}
    assert whole == {"a": "a", "b": "a", "c": "a", "a2": "a2", "in": "a2", "out": "a2", "n": "n", "m": "n"}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in dedup.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert dedup.components(edges.where("a = 7 and b = 7")).count() == 0


def test_registry(spark):
    x, y, z = (unit(np.eye(3)[i]) for i in range(3))
    near = unit(x + 0.1 * y)
    events = spark.createDataFrame(
        [("e1", x.tolist(), "archived", 4, NOW - timedelta(days=5), NOW - timedelta(days=5)), ("e2", y.tolist(), "closed", 2, NOW, NOW), ("e3", None, "detected", 0, NOW, NOW)],
        "event_id string, centroid array<double>, status string, article_count int, first_seen timestamp, last_seen timestamp",
    )
    clusters = spark.createDataFrame([(1, near.tolist(), 3, "a"), (2, y.tolist(), 5, "b"), (3, unit(y + 0.05 * z).tolist(), 2, "c")], "cluster_id int, centroid array<double>, n int, first_id string")
    assert [(r.cluster_id, r.event_id) for r in registry.best_match(clusters, events).collect()] == [(1, "e1")]
    got = registry.assign(clusters, events)
    assert got[0]["event_id"] == "e1" and got[1]["is_new"] and got[2]["event_id"] == got[1]["event_id"] and not got[2]["is_new"]
    rows = [(g["cluster_id"], g["event_id"]) for g in got]
    assigned = spark.createDataFrame(rows, "cluster_id int, event_id string").join(clusters, "cluster_id")
    after = {r.event_id: r for r in registry.apply(events, assigned, F.lit(NOW)).collect()}
    assert (after["e1"].status, after["e1"].article_count, after["e1"].last_seen) == ("enriched", 7, NOW)
    new = after[got[1]["event_id"]]
    assert (new.status, new.article_count) == ("detected", 7) and after["e2"].status == "closed" and after["e2"].article_count == 2
    assert np.allclose(new.centroid, unit(y + 0.05 * z))
    assert registry.same_size(events, 3).count() == 2


def test_zero_shot(spark):
    eye = np.eye(22)
    axes = [(a, k, label) for a, own in classify.AXES.items() for k, label in enumerate(own)]
    labels = spark.createDataFrame([(a, k, label, eye[i].tolist()) for i, (a, k, label) in enumerate(axes)], "axis string, ord int, label string, label_vector array<double>")
    many = sum(eye[i] for i in range(4))
    rows = [(1, unit(many).tolist()), (2, None), (3, eye[9].tolist()), (4, np.zeros(22).tolist())]
    found = {(r.id, r.axis): r for r in classify.zero_shot(spark.createDataFrame(rows, "id int, v array<double>"), labels, "id", "v").collect()}
    assert found[1, "action_forms"].labels == classify.ACTION_FORMS[:3]
    assert found[2, "channel"].labels == classify.CHANNELS[:1] and found[2, "channel"].confidence == 0
    assert found[3, "thematic_fields"].labels == [classify.THEMATIC_FIELDS[1]] and found[4, "intensity"].labels == classify.INTENSITIES[:1]
    low = {r.id: r.low for r in classify.confidence(spark.createDataFrame(list(found.values())), "id").collect()}
    assert all(low.values())


def test_fallback(spark):
    found = spark.createDataFrame([(1, "channel", ["a"], 0.2), (2, "channel", ["a"], 0.9), (3, "channel", ["a"], 0.1)], "id int, axis string, labels array<string>, confidence double")
    titles = spark.createDataFrame([(1, ["good"]), (3, ["bad"])], "id int, titles array<string>")

    def model(own):
        if own == ["bad"]:
            raise RuntimeError
        return {"channel": ["b"]}

    got = {r.id: (r.labels, r.confidence) for r in classify.with_fallback(found, titles, "id", model).collect()}
    assert got == {1: (["b"], 0.2), 2: (["a"], 0.9), 3: (["a"], 0.1)}


def test_geocode_and_prompt(spark):
    place = "array<struct<name:string,lat:double,lon:double>>"
    rows = spark.createDataFrame([(1, [("A", 1.0, 2.0), ("B", 3.0, 4.0)], [("C", 0.0, 0.0)]), (2, [], [("C", 0.0, 0.0)]), (3, None, None)], f"id int, model {place}, gazetteer {place}")
    got = {r.id: [(x.name, x.is_primary) for x in r.locations or []] for r in classify.geocode_tiers(rows, ["model", "gazetteer"]).collect()}
    assert got == {1: [("A", True), ("B", False)], 2: [("C", True)], 3: []}
    text = spark.range(1).select(classify.prompt(F.array(*[F.lit(f"t{i}") for i in range(9)]), F.array(F.lit("b" * 500))).alias("p")).first().p
    assert text.count("- t") == 8 and text.endswith("b" * 400) and not text.endswith("b" * 401)


def test_embed_is_unit_and_lazy(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in classify.embed(rows, "id", "text", classify.HashingModel()).collect()}
    assert math.isclose(np.linalg.norm(got[1]), 1, abs_tol=1e-6) and not any(got[2])

    def never(texts):
        raise AssertionError

    assert classify.embed(rows.where("false"), "id", "text", never).count() == 0


def test_quality_measures(spark):
    rng = np.random.default_rng(0)
    v = [unit(rng.normal(size=5) + 3 * np.eye(5)[i % 3]) for i in range(30)]
    df = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)] + [(99, 7, unit(np.ones(5)).tolist())], "id int, c int, v array<double>")
    x, c = np.array([*v, unit(np.ones(5))]), np.array([*[i % 3 for i in range(30)], 7])
    d = 1 - x @ x.T
    wanted = []
    for i in range(31):
        own = c == c[i]
        a = d[i][own].sum() / max(1, own.sum() - 1)
        b = min(d[i][c == k].mean() for k in set(c) - {c[i]})
        wanted.append(0 if own.sum() == 1 else (b - a) / max(a, b))
    got = {r.id: r.silhouette for r in clustering.silhouette(df, "c", "v", "id").collect()}
    assert np.allclose([got[i] for i in [*range(30), 99]], wanted, atol=1e-12)
    names = {r.metric for r in clustering.baseline(df, "c", "v", "id").collect()}
    assert {"records", "noise_share", "clusters", "silhouette", "davies_bouldin", "calinski_harabasz"} <= names
    assert clustering.worst_clusters(df, "c", "v", "id", 2).count() == 2


def test_null_order_and_pages(spark):
    rows = [("a", "enriched", None, None), ("b", "enriched", NOW, NOW), ("c", "enriched", NOW, NOW + timedelta(days=1)), ("d", "closed", NOW, NOW)]
    events = spark.createDataFrame(rows, "event_id string, status string, first_seen timestamp, last_seen timestamp").withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0)})
    assert [r.event_id for r in serve.list_events(events).collect()] == ["c", "b", "a"]
    assert [r.event_id for r in serve.list_events(events, limit=1, offset=1).collect()] == ["b"]
    assert serve.list_events(events, bbox="1,2,3").count() == 3 and serve.list_events(events, bbox="2,1,2,1").count() == 3 and serve.list_events(events, bbox="3,1,4,2").count() == 0
    with pytest.raises(ValueError):
        serve.list_events(events, bbox="a,b,c,d")
    with pytest.raises(ValueError):
        serve.list_events(events, date_from="never")
    with pytest.raises(ValueError):
        serve.list_events(events, limit=0)
    assert serve.admin_events(events, status="no such").count() == 4
    arts = spark.createDataFrame([("a", str(i), None if i == 3 else NOW + timedelta(hours=i)) for i in range(6)], "event_id string, article_id string, published_at timestamp")
    assert [r.article_id for r in serve.top_articles(arts, 3).orderBy("rank").collect()] == ["3", "5", "4"]


def test_validation(spark):
    rows = spark.createDataFrame([("x", ["a", "z"]), ("y", ["a"]), (None, [])], "channel string, forms array<string>")
    got = [r.errors for r in serve.validate(rows, {"channel": ["y"]}, {"forms": ["a"]}).collect()]
    assert got == [["Invalid channel.", "Invalid forms."], [], ["Invalid channel."]]


def test_lifecycle_thresholds(spark):
    cases = {
        "fresh": ("enriched", NOW - timedelta(hours=72), "enriched"), "idle": ("enriched", NOW - timedelta(hours=72, seconds=1), "archived"),
        "long": ("enriched", NOW - timedelta(days=10, seconds=1), "closed"), "old": ("archived", NOW - timedelta(days=10), "archived"),
        "gone": ("archived", NOW - timedelta(days=11), "closed"), "wait": ("pending_review", NOW - timedelta(days=30), "pending_review"), "none": ("enriched", None, "enriched"),
    }
    events = spark.createDataFrame([(k, s, t) for k, (s, t, _) in cases.items()], "event_id string, status string, last_seen timestamp")
    bodies = spark.createDataFrame([(k, "text") for k in cases], "event_id string, body_text string")
    after, pruned = lifecycle.sweep(events, bodies, F.lit(NOW))
    assert {r.event_id: r.status for r in after.collect()} == {k: w for k, (_, _, w) in cases.items()}
    assert {r.event_id for r in pruned.collect() if r.body_text is None} == {"idle", "long", "old", "gone"}


def test_polygon(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]
    points = [(3.0, 3.0, True), (1.5, 1.5, False), (1.5, 1.04, True), (5.0, 5.0, False), (4.03, 2.0, True), (4.06, 2.0, False), (None, 1.0, False)]
    rows = spark.createDataFrame([(lat, lon, w, square) for lat, lon, w in points], "lat double, lon double, wanted boolean, rings array<array<struct<x:double,y:double>>>")
    got = rows.select("wanted", geo.within(F.col("lat"), F.col("lon"), geo.edges(F.col("rings"))).alias("got")).collect()
    assert all(r.got == r.wanted for r in got)


def test_relative_and_hours(spark):
    cases = [(timedelta(days=-400), (-1, "year")), (timedelta(hours=-36), (-1, "day")), (timedelta(minutes=90), (2, "hour")), (timedelta(seconds=-20), (0, "minute"))]
    for delta, wanted in cases:
        r = spark.range(1).select(moments.relative(F.lit(NOW + delta), F.lit(NOW)).alias("r")).first().r
        assert (r.amount, r.unit) == wanted
    hours = spark.range(1).select(moments.hours_between(F.lit(NOW), F.lit(NOW + timedelta(hours=72, minutes=59))).alias("h")).first().h
    assert 72.9 < hours < 73


def test_cosine_guard(spark):
    got = spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("a"), cosine(F.array(F.lit(2.0)), F.array(F.lit(-3.0))).alias("b")).first()
    assert got.a == 0 and math.isclose(got.b, -1, abs_tol=1e-6)


def test_keyword_hits(spark):
    rows = spark.createDataFrame([(1, "ΔΙΑΔΗΛΩΣΗ και απεργία")], "id int, text string")
    assert {r.keyword for r in lookups.keyword_hits(rows, "id", "text", ["διαδήλωση", "απεργία", "μπλόκο"]).collect()} == {"διαδήλωση", "απεργία"}


def test_blocks_change_no_result(spark):
    """Pairs of a cluster that is dealt to many blocks, and the nearest over facing blocks, against plain loops."""
    rng = np.random.default_rng(5)
    vs = [unit(v) for v in rng.normal(size=(90, 4))]
    at = [None if i % 9 == 0 else NOW + timedelta(hours=int(rng.integers(0, 200))) for i in range(90)]
    c = [None if i % 10 == 0 else 1 if i % 4 else 2 for i in range(90)]
    df = articles(spark, [(c[i], f"{i:02}", vs[i], at[i]) for i in range(90)])
    close = lambda i, j: at[i] is None or at[j] is None or abs(at[i] - at[j]) <= timedelta(hours=48)
    want = {(c[i], f"{i:02}", f"{j:02}") for i in range(90) for j in range(i + 1, 90) if c[i] == c[j] and close(i, j) and round(float(vs[i] @ vs[j]), 9) >= 0.5}
    for block in (8, 4096):
        found = [(r.cluster, r.a, r.b) for r in dedup.similar_pairs(df, 0.5, 48, block=block).collect()]
        assert len(found) == len(want) and set(found) == want
    events = spark.createDataFrame([(f"e{i:02}", v.tolist(), "enriched") for i, v in enumerate(vs[10:])] + [("short", [1.0], "enriched"), ("none", None, "enriched")], "event_id string, centroid array<double>, status string")
    clusters = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs[:10])] + [(50, [0.0, 0.0]), (51, None)], "cluster_id int, centroid array<double>")
    best = {i: min((-round(float(v @ w), 9), f"e{j:02}") for j, w in enumerate(vs[10:])) for i, v in enumerate(vs[:10])}
    for few in (0, registry.FEW):
        assert {r.cluster_id: r.event_id for r in registry.best_match(clusters, events, -1, few=few).collect() if r.cluster_id < 50} == {i: e for i, (_, e) in best.items()}
        assert registry.best_match(clusters.where("false"), events, -1, few=few).collect() == [] and registry.best_match(clusters, events.where("false"), -1, few=few).collect() == []


def test_names_in_plan_or_broadcast(spark):
    """Names beyond the plan's literals, and none at all, give what few names give."""
    few = [(0, "patras", 38.2, 21.7), (1, "pat", 1.0, 2.0), (2, "athens", 37.9, 23.7)]
    names = spark.createDataFrame(few, "ord int, name string, lat double, lon double")
    more = names.union(spark.range(lookups.LITERALS).selectExpr("cast(id + 3 as int)", "concat('nowhere', id)", "0D", "0D"))
    df = spark.createDataFrame([(1, "In ATHENS and Patras"), (2, "a pat"), (3, "none"), (4, None)], "id int, text string")
    want = {1: "Patras", 2: "Pat", 3: None, 4: None}
    for table in (names, more):
        assert {r.id: r.place for r in lookups.first_in_text(df, "text", table).collect()} == want
    assert {r.id: r.place for r in lookups.first_in_text(df, "text", names.where("false")).collect()} == dict.fromkeys(want)
    with pytest.raises(ValueError, match="names"):
        lookups.first_in_text(df, "text", more, lookups.LITERALS)


def test_measures_of_clusters_against_loops(spark):
    rng = np.random.default_rng(8)
    vs = [unit(v) for v in rng.normal(size=(40, 3))]
    own = [i % 4 for i in range(39)] + [9]
    df = spark.createDataFrame([(i, c, v.tolist()) for i, (c, v) in enumerate(zip(own, vs, strict=True))] + [(77, None, vs[0].tolist()), (78, 1, None)], "id int, c int, v array<double>")
    got = {r.id: r.silhouette for r in clustering.silhouette(df, "c", "v", "id").collect()}
    groups = {c: [v for v, o in zip(vs, own, strict=True) if o == c] for c in set(own)}
    for i, (c, v) in enumerate(zip(own, vs, strict=True)):
        b = min(np.mean([1 - v @ w for w in g]) for o, g in groups.items() if o != c)
        a = sum(1 - v @ w for w in groups[c] if w is not v) / max(len(groups[c]) - 1, 1)
        assert math.isclose(got[i], (b - a) / max(a, b) if len(groups[c]) > 1 else 0, abs_tol=1e-9)
    assert got[77] == 0 and got[78] == 0
    mean = {c: np.mean(g, axis=0) for c, g in groups.items()}
    far = {c: np.mean([np.linalg.norm(v - mean[c]) for v in g]) for c, g in groups.items()}
    want = np.mean([max((far[c] + far[d]) / np.linalg.norm(mean[c] - mean[d]) for d in groups if d != c) for c in groups])
    assert math.isclose(clustering.davies_bouldin(df.where("c is not null and v is not null"), "c", "v").first()[0], want, rel_tol=1e-9)


def test_nearest_over_blocks_with_ties_and_nulls(spark):
    vectors = [v.tolist() for g in range(12) for v in group(g, 40, 0.05)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 64), (1002, vectors[0]), (1003, vectors[0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    index = nearest.build(df, "id", "v", k=5)
    asked = df.where("id % 50 = 0")
    x = np.array([v for _, v in rows if v is not None])
    ids = [i for i, v in rows if v is not None]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = set()
    for i, v in rows:
        if i % 50 == 0 and v is not None:
            s = np.round(x @ x[ids.index(i)], 9)
            want |= {(i, j) for _, j in sorted(zip(-s, ids, strict=True))[:5]}
    found = {(r["query"], r["id"]) for r in nearest.search(index, asked, "id", "v", 5, len(index.centres), (64, 2)).collect()}
    assert found == want
    some = nearest.search(index, asked, "id", "v", 5)
    assert index.probes < len(index.centres) / 2 and nearest.recall(some, nearest.search(index, asked, "id", "v", 5, len(index.centres)), "id").first().recall >= 0.9
    none = df.where("false")
    assert nearest.search(nearest.build(none, "id", "v"), none, "id", "v").count() == 0
    assert nearest.search(nearest.build(none, "id", "v"), asked, "id", "v").count() == 0


def test_latest_and_empty_titles(spark):
    day = lambda n: NOW - timedelta(days=n)
    rows = [("e", "a", "old", "b", day(3), False), ("e", "b", None, None, None, False), ("e", "c", "new", "b", day(1), False), ("e", "d", "copy", "b", day(0), True), (None, "f", "free", "b", day(0), False)]
    rows += [("hot", f"h{i:03}", str(i), "", day(i), False) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id string, article_id string, title string, body_text string, published_at timestamp, is_duplicate boolean")
    got = {r.event_id: (r.titles, r.n) for r in enrichment.latest(df).collect()}
    assert got == {"e": (["", "new", "old"], 3), "hot": ([str(i) for i in range(10)], 10)}
    names = spark.createDataFrame([], "ord int, name string, lat double, lon double")

    def down(*said):
        raise OSError

    down_services = enrichment.Services(down, down, down, down, down)
    for services in (enrichment.Services(), down_services):
        assert [(r.locations, r.tier) for r in enrichment.located(enrichment.latest(df), "event_id", "titles", names, services).collect()] == [([], None)] * 2
        assert [(r.summary_el, r.summary_en) for r in enrichment.summarised(enrichment.latest(df), "event_id", "titles", "bodies", services).collect()] == [(None, None)] * 2


def test_a_failing_phase_leaves_the_tables(spark):
    from tidewatch.plans import enrichments

    def down(texts):
        raise OSError("down")

    whole, one_hot = [], enrichments._one_hot
    enrichments._one_hot = down
    try:
        tables, whole = enrichments._cycles(spark, "/root/testdata/sf0.001")
    finally:
        enrichments._one_hot = one_hot
    assert "error" in whole[0]["analyse"] and whole[0]["ingest"]["inserted"] > 0 and whole[0]["archive"] == {"archived": 1, "pruned": 0, "closed": 1}
    assert tables.articles.count() == whole[0]["ingest"]["inserted"] + whole[1]["ingest"]["inserted"] and tables.events.count() == 2


def test_labels_need_no_shuffle_and_ties_go_to_the_first(spark):
    labels = spark.createDataFrame([("action_forms", 1, "b", [1.0, 0.0]), ("action_forms", 0, "a", [1.0, 0.0]), ("channel", 0, "c", [0.0, 1.0]), ("channel", 1, "d", [-1.0, 0.0])], "axis string, ord int, label string, label_vector array<float>")
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0]), (5, [-1.0, 3.0])], "id int, v array<float>")
    found = classify.zero_shot(rows, labels, "id", "v")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.axis): (r.labels, round(r.confidence, 6)) for r in found.collect()}
    assert got[1, "action_forms"] == (["a", "b"], 1.0) and got[1, "channel"] == (["c"], 0.0)
    for i in (2, 3, 4):
        assert got[i, "action_forms"] == (["a"], 0.0) and got[i, "channel"] == (["c"], 0.0)
    assert got[5, "action_forms"] == (["a"], round(-1 / math.sqrt(10), 6)) and got[5, "channel"][0] == ["c"]
    best = {r.id: (r.label, r.bucket) for r in classify.best_label(rows, labels, "id", "v").collect()}
    assert best == {1: ("a", "high"), 2: ("a", "low"), 3: ("a", "low"), 4: ("a", "low"), 5: ("c", "high")}
    assert classify.zero_shot(rows, labels.where("false"), "id", "v").count() == 0 and classify.best_label(rows, labels.where("false"), "id", "v").count() == 0
