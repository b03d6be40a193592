"""Languages do not depend on what else is in a pass, nor on how grams are sliced."""

import numpy as np
import pyarrow as pa

from tidewatch.llm import langmix
from tidewatch.llm.shared import utf8


def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, table = langmix.learn(docs)
    return [r.text for r in docs.limit(60).collect()], names, table


def test_each_text_by_itself(spark, monkeypatch):
    texts, names, table = model(spark)
    texts += ["", "a", texts[0][:40] + " " + texts[1][:40], "x" * 3000, None]
    whole, best = langmix.infer(*utf8(pa.array(texts, pa.string())), table)
    monkeypatch.setattr(langmix, "SLICE", 64)
    for i, t in enumerate(texts):
        own, score = langmix.infer(*utf8(pa.array([t], pa.string())), table)
        assert np.allclose(own[0], whole[i], atol=1e-6) and np.allclose(score[0], best[i], rtol=1e-6)


def plain(text, table):
    """One text by the definition, with loops over words."""
    raw = text.lower().encode() if text.isascii() else bytes(langmix.LOWER[np.frombuffer(text.encode(), np.uint8)])
    g = langmix.grams(np.frombuffer(text.encode(), np.uint8))
    words, at = [], 0
    for w in raw.split():
        a = raw.index(w, at)
        at = a + len(w)
        first, last = min(max(a - 1, 0), len(g)), min(at - 1, len(raw) - 2)
        words.append(table[g[first : max(first, min(last, len(g)))]].astype(float).sum(axis=0))
    k = table.shape[1]
    if not words:
        return np.zeros(k)
    like = np.exp(np.maximum(np.array(words) - np.array(words).max(axis=1)[:, None], -60))

    def em(share, rounds):
        for _ in range(rounds):
            part = like * share
            share = (part / part.sum(axis=1)[:, None]).mean(axis=0)
        return share

    share = em(np.full(k, 1 / k), langmix.ROUNDS)
    order = sorted(range(k), key=lambda c: (-share[c], c))
    best, chosen = -np.inf, None
    for size in range(1, k + 1):
        trial = np.array([share[c] + 1e-9 if c in order[:size] else 0.0 for c in range(k)])
        trial = em(trial / trial.sum(), 2 if size > 1 else 0)
        score = np.log((like * trial).sum(axis=1)).sum() - (size - 1) / 2 * np.log(max(2, len(words)))
        if score <= best:
            break
        best, chosen = score, trial
    return chosen


def test_query_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, table = langmix.learn(docs.where(~langmix.held_out()))
    got = {r.doc_id: r for r in langmix.identify(docs).collect()}
    for r in docs.collect():
        share = plain(r.text, table)
        assert got[r.doc_id].lang_pred == names[int(share.argmax())] and abs(got[r.doc_id].score - share.max()) < 1e-5
