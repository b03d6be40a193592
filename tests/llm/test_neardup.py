"""The pipeline's near-duplicate stage against all pairs of exact similarities."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tidewatch.llm import neardup


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def survivors(texts):
    """Smallest id of each component of all pairs at 0.8 and above."""
    sets, root = {i: sets_of(t) for i, t in texts}, {i: i for i, _ in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in sets if top(i) == i}


def planted():
    rng = random.Random(5)
    texts = ["", None, " \n", "two words", "Two  WORDS", "four words are here"]
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 12, 25, 60, 200, 400]))]
        texts.append(" ".join(base))
        for changed in range(4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * changed // 60)):
                copy[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy if changed else base[: -max(1, len(base) // 8)]))
    line = " ".join(f"common{i}" for i in range(30))
    texts += [line + " " + " ".join(f"own{k}x{i}" for i in range(20)) for k in range(40)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 100, 8)]
    return list(enumerate(texts))


def test_stage_keeps_one_of_each_group_at_the_similarity(spark):
    texts = planted()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(survivors(texts))


def test_joined_texts_and_common_order_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST", 0)
    monkeypatch.setattr(neardup, "PART", 3)
    texts = planted()
    kept = neardup.one_of_each(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(survivors(texts))


def fingerprint(text):
    """By definition: a bit is set if it is in over half of the distinct shingles' hashes."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, key = neardup.shingles(data, np.array([0, len(data)]))
    hashes = neardup.mix(key).tolist()
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def test_trees_of_fingerprints_link_the_near_ones_without_any_band(spark, monkeypatch):
    texts = planted()
    sets = {i: sets_of(t) for i, t in texts if sets_of(t)}
    prints = {i: fingerprint(t) for i, t in texts if i in sets}
    far = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and far(i, j) <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = neardup.cut(neardup.described(docs, 5))
    of = dict(rows.where("n > 0").select("id", "doc_id").collect())
    met = {}
    for r in neardup.tree_buckets(rows.where("sketch is not null")).collect():
        met.setdefault(r.key, set()).add(frozenset(sets[of[r.id]]))
    want = {}
    for i, g in group.items():
        want.setdefault(g, set()).add(frozenset(sets[i]))
    assert sorted(map(sorted, ([sorted(x) for x in m] for m in met.values()))) == sorted(map(sorted, ([sorted(x) for x in m] for m in want.values() if len(m) > 1)))
    monkeypatch.setattr(neardup, "band_buckets", lambda sets: sets.select(F.lit(0).cast("long").alias("key"), "id").limit(0))
    kept = {r.doc_id for r in neardup.one_of_each(docs).collect()}
    near = {i for i in sets for j in sets if j < i and group[i] == group[j] and 0.8 <= similarity(sets[i], sets[j]) < 1}
    assert survivors(texts) < kept and len(near) > 10 and not near & kept
    assert all(any(j < i and group[i] == group[j] for j in sets) for i in sets if i not in kept)
