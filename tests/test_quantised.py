"""The stored index: exact with everything kept, few similarities on planted groups, rows added, moved and removed without a rebuild."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import nearest, quantised


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def nearest_by_loop(rows, asked, k):
    ids = [i for i, v in rows if v is not None]
    x = unit(np.array([v for _, v in rows if v is not None], np.float32).astype(float))
    at = dict(zip(ids, x, strict=True))
    return {(q, j) for q in asked for _, j in sorted(zip(-np.round(x @ at[q], 9), ids, strict=True))[:k]}


def pairs(df):
    return {(r["query"], r["id"]) for r in df.collect()}


def test_index_is_added_to(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(20, 30)))
    rows = [(i, unit(centres[i % 20] + rng.normal(size=30) * 0.06).astype(np.float32).tolist()) for i in range(1200)] + [(2000, None), (2001, [0.0] * 30)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    index = quantised.create(df.where("id % 2 = 0"), "id", "v", str(tmp_path / "i"), k=5, buckets=3)
    model = index.model
    index.add(df.where("id % 2 = 1"), "id", "v")
    index.remove(df.where("id % 10 = 3").select("id"))
    index.add(df.where("id = 7").withColumn("v", F.lit(None).cast("array<float>")), "id", "v")  # without a vector: left as it is
    moved = spark.createDataFrame([(5, rows[8][1])], "id int, v array<float>")
    index.add(moved, "id", "v")
    again = quantised.load(spark, str(tmp_path / "i"))
    assert np.array_equal(again.model.books, model.books) and (again.model.probes, again.model.keep) == (model.probes, model.keep)
    now = [(i, rows[8][1] if i == 5 else v) for i, v in rows if i % 10 != 3]
    assert again.rows.read("cell").count() == len(now) - 1
    ids = [i for i in range(0, 1200, 40)] + [2001]
    asked = df.where(F.col("id").isin(ids))
    want = nearest_by_loop(now, ids, 5)
    every = len(model.centres)
    assert pairs(again.search(asked, "id", "v", 5, every, 5000, (300, 4))) == want
    found, seen = pairs(again.search(asked, "id", "v", 5)), again.candidates(asked, "id", "v").count()
    good = [p for p in want if p[0] != 2001]  # a zero vector is equally far from all
    assert len([p for p in good if p in found]) >= 0.95 * len(good) and seen < 0.1 * len(ids) * len(now)
    index.rows.compact(0.0)
    assert pairs(again.search(asked, "id", "v", 5)) == found
    assert again.search(asked.where("false"), "id", "v", 5).count() == 0
    with pytest.raises(ValueError, match="fitted"):
        quantised.create(df.where("false"), "id", "v", str(tmp_path / "none"))


def test_codes_say_nearly_what_vectors_say():
    x = unit(np.random.default_rng(1).normal(size=(3000, 64)))
    model = quantised.fit(x[:2000])
    cell, codes = model.code(x)
    score = model.score(x[:50], codes) + (x[:50] @ model.centres.T)[:, cell]
    assert codes.shape == (3000, 16) and np.corrcoef(score.ravel(), (x[:50] @ x.T).ravel())[0, 1] > 0.9
    assert nearest.RECALL < quantised.LEAVES and model.keep < 400
