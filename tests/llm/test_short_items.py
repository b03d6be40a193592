"""Decontamination of short items against all placements, and recall of substituted items by length."""

import random

import pytest

from tidewatch.llm import decontaminate


def agreeing(words, item):
    """The most tokens of an item that agree on any diagonal."""
    return max(sum(0 <= d + j < len(words) and words[d + j] == t for j, t in enumerate(item)) for d in range(-len(item), len(words)))


def test_short_items_against_all_placements(spark):
    rng = random.Random(3)
    items = {n: [f"i{n}x{j}" for j in range(n)] for n in range(1, 16)}
    items[100] = ["same"] * 6
    texts = []
    for n, item in items.items():
        for changed in range(5):
            own = list(item)
            for at in rng.sample(range(len(own)), min(changed, len(own))):
                own[at] = f"z{rng.randrange(999)}"
            texts.append([f"f{rng.randrange(999)}" for _ in range(rng.randrange(9))] + own + [f"f{rng.randrange(999)}" for _ in range(rng.randrange(9))])
            texts.append(own[: max(1, len(own) * 4 // 5)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.overlaps(docs, bench).collect()}
    expected = {(i, n, m) for i, t in enumerate(texts) for n, item in items.items() if (m := agreeing(t, item)) >= 0.8 * len(item) - 1e-9}
    assert got == expected


@pytest.mark.parametrize("length", [5, 7, 9, 10, 13, 15, 16, 20, 30])
def test_recall_at_a_fifth_of_substitutions(spark, length):
    rng = random.Random(length)
    items, texts = [], []
    for k in range(200):
        item = [f"k{k}w{j}" for j in range(length)]
        own = list(item)
        for at in rng.sample(range(length), length // 5):
            own[at] = f"s{rng.randrange(9999)}"
        items.append((k, " ".join(item)))
        texts.append((k, " ".join([f"p{rng.randrange(9999)}" for _ in range(20)] + own + [f"p{rng.randrange(9999)}" for _ in range(20)])))
    found = decontaminate.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found.where("doc_id = item_id").count() >= (200 if length <= decontaminate.SHORT else 190)
