"""Many names in one pass, and territories whose features overlap."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions import text as T
from tidewatch.operators import lookups
from tidewatch.sources import config


def test_automaton_finds_what_contains_finds(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abc é", k=n))
    names = [(i, word(rng.randint(2, 6))) for i in range(700)] + [(700, "zz"), (701, "zz"), (702, None)]
    texts = [(i, "".join(rng.choices("abcé xy", k=rng.randint(0, 60))).upper()) for i in range(80)] + [(90, None), (91, ""), (92, "has ZZ in it")]
    table = spark.createDataFrame([(i, w, float(i), 0.0) for i, w in names], "ord int, name string, lat double, lon double")
    df = spark.createDataFrame(texts, "id int, text string")
    want = {i: next((float(k) for k, w in names if w is not None and w in (t or "").lower()), None) for i, t in texts}
    assert want[92] == 700.0 or want[92] < 700 and sum(v is None for v in want.values()) > 3
    assert {r.id: r.lat for r in lookups.first_in_text(df, "text", table).collect()} == want
    monkeypatch.setattr(lookups, "SHARD", 200)
    assert {r.id: r.lat for r in lookups.first_in_text(df, "text", table).collect()} == want
    keys = [w for _, w in names if w]
    got = {}
    for r in lookups.keyword_hits(df, "id", "text", keys).collect():
        got.setdefault(r.id, []).append(r.keyword)
    bare = lambda t: t.lower().replace("é", "e")
    assert got == {i: [w for k, w in enumerate(keys) if bare(w) in bare(t) and bare(w) not in [bare(x) for x in keys[:k]]] for i, t in texts if t and any(bare(w) in bare(t) for w in keys)}
    for folded in (True, False):
        many = df.select("id", T.contains_any(F.col("text"), keys, folded).alias("hit"))
        low = bare if folded else str.lower
        assert {r.id: r.hit for r in many.collect()} == {i: bool(t and t.strip()) and any(w.strip() and low(w) in low(t) for w in keys) for i, t in texts}


def square(x, y, h):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]


def test_features_that_overlap_or_share_a_border(spark):
    features = [[[square(0, 0, 1)]], [[square(0.5, 0, 1), square(0.5, 0, 0.3)]], [[square(3, 0, 1)], [square(5, 0, 1)]], [[square(-8, 3, 0.01)]]]
    rng = np.random.default_rng(1)
    points = [(float(y), float(x)) for x, y in zip(rng.uniform(-9, 7, 3000), rng.uniform(-2, 4, 3000), strict=True)] + [(0.0, 0.2), (0.0, 1.2), (0.0, 4.0), (3.0, -8.03), (None, 0.0), (0.0, float("nan"))]

    def there(lat, lon, b):
        def polygon(rings):
            def off(ring):
                (x0, y0), (x1, y1) = ring[0], ring[2]
                dx, dy = max(x0 - lon, lon - x1, 0), max(y0 - lat, lat - y1, 0)
                return (dx * dx + dy * dy) ** 0.5, min(lon - x0, x1 - lon, lat - y0, y1 - lat)

            outside, _ = off(rings[0])
            return outside < b and not any(off(hole)[1] >= b for hole in rings[1:])

        return any(polygon(p) for f in features for p in f)

    df = spark.createDataFrame(points, "lat double, lon double")
    for cells in (1, 16, 64):
        one = geo.Territory(features, 5.0, cells)
        for lat, lon, got in df.select("lat", "lon", one.contains(F.col("lat"), F.col("lon")).alias("got")).collect():
            assert got == (lat is not None and lon == lon and there(lat, lon, 5 / 111)), (lat, lon, cells)
    assert {"i", "o", "b"} <= set(geo.Territory(features).grid)
    assert geo.Territory([]).contains(F.lit(1.0), F.lit(1.0)) is not None


def test_shapes_from_files(spark, tmp_path):
    one = '{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}'
    two = '{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0, 5], [1, 0, 5], [1, 1, 5], [0, 0, 5]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}'
    (tmp_path / "whole.json").write_text('{"type": "FeatureCollection", "features": [' + one + "," + two + "]}")
    (tmp_path / "lines.json").write_text(one + "\n" + two + "\n")
    whole, lines = (config.features(spark, str(tmp_path / f"{n}.json")) for n in ("whole", "lines"))
    assert whole == lines and [len(f) for f in whole] == [1, 2] and len(geo.Territory(whole).polygons) == 3
