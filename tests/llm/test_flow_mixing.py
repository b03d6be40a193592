"""The mix on texts that several sources hold, and its stage on repeated rows and clashing names."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidewatch.llm import mixing


def shared_texts(seed):
    rng = random.Random(seed)
    texts = [f"t{k} " * rng.randint(1, 9) for k in range(30)]
    rows = []
    for source in ("a", "b", None):
        for k, text in enumerate(texts):
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                rows.append((len(rows), text, source))
    return rows


def least_cost(rows, quota):
    """By dynamic programming over texts: the least cost of filling all quotas, a use of a text costing 1, 3, 5 words, 7 beyond."""
    by = defaultdict(Counter)
    for _, text, source in rows:
        by[text][source] += len(text.split())
    order = sorted(quota, key=lambda s: (s is None, s or ""))
    best = {tuple(0 for _ in order): 0}
    for text, own in by.items():
        words = len(text.split())
        nxt = {}
        for state, cost in best.items():
            for a in range(0, 3 * own["a"] + 1):
                for b in range(0, 3 * own["b"] + 1):
                    new = (state[0] + a, state[1] + b)
                    if new[0] > quota["a"] or new[1] > quota["b"]:
                        break
                    used = a + b
                    price = sum((1, 3, 5, 7)[min(3, u // words)] for u in range(used))
                    if price + cost < nxt.get(new, 10**9):
                        nxt[new] = price + cost
        best = nxt
    return best.get((quota["a"], quota["b"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_costs_decide_which_source_a_shared_text_serves(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(["w"] * rng.randint(1, 2)) + f" x{k}" for k in range(6)]
    rows = [(i, texts[k], s) for i, (k, s) in enumerate((k, s) for k in range(6) for s in ("a", "b") if rng.random() < 0.7)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1, 3)).collect()
    quota = {r.source: round(r.target) for r in found}
    taken = Counter()
    used = Counter()
    for r in found:
        taken[r.source] += r.taken
        used[rows[r.doc_id][1]] += r.taken
    assert taken == Counter(quota)
    cost = sum(sum((1, 3, 5, 7)[min(3, u // len(t.split()))] for u in range(n)) for t, n in used.items())
    assert cost == least_cost(rows, quota)


@pytest.mark.parametrize("seed", [3, 4])
def test_targets_hold_where_sources_share_texts(spark, seed):
    rows = shared_texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in found) == [i for i, _, _ in rows]
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert any("," in r.pattern for r in found)
    assert {tuple(r) for r in found} == {tuple(r) for r in mixing.mix(docs.orderBy("text")).collect()}


def test_stage_on_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c d e f g h", "s", 5, "x", 7)] * 4 + [(2, "only one", "s", 6, "y", 8), (3, None, None, 1, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, target string, size int")
    whole = mixing.mix(docs).collect()
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    assert sorted(got.columns) == sorted(docs.columns)
    rows_out = got.collect()
    assert sorted((r.doc_id, r.taken, r.size) for r in rows_out) == sorted((r.doc_id, r.taken, r.size) for r in whole if r.taken)
    assert sum(r.taken for r in rows_out) == 34 and all(r.taken <= 3 * r.size for r in rows_out)


def test_one_pattern_of_words_is_used_evenly(spark):
    rows = [(i, f"t{i} x y", s) for i in range(40) for s in ("a", "b")]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    used = Counter()
    for r in found:
        used[r.sig] += r.taken
    assert max(used.values()) - min(used.values()) <= 3
