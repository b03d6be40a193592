"""The quality classifier: exchange in both directions, held-out accuracy, and a plain version in memory."""

import html
import random
import re

import numpy as np
import pytest

from tidewatch.llm import cotrain, queries
from tidewatch.llm.shared import utf8

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return read("documents"), read("labels")


def linked(docs, pages):
    """By document, the pages with a block that begins with its first words: plain strings, no hashes."""
    starts = {}
    for p in pages:
        seen = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", p.html or "")
        blocks = [html.unescape(re.sub(r"<[^>]+>", " ", x)).lower() for x in re.split(r"(?i)<(?:h[1-6]|p|div|article|section|main|body|td|li|pre|blockquote)\b[^>]*>", seen)]
        words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in blocks]
        for i in range(len(words)):
            first = tuple(w for x in words[i:] for w in x)[:12] if words[i] or i else tuple(w for x in words for w in x)[:12]
            if len(first) == 12:
                starts.setdefault(first, {})[p.page_id] = p
    out = []
    for r in docs:
        first = tuple(re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()))[:12]
        out.append(list(starts.get(first, {}).values()) if len(first) == 12 else [])
    return out


@pytest.fixture(scope="module")
def arrays(spark, tables):
    docs, _ = tables
    rows = docs.orderBy("doc_id").collect()
    import pyarrow as pa

    own = linked(rows, spark.read.parquet(f"{SF}/pages.parquet").collect())
    assert sum(map(bool, own)) > 200
    n = np.array([len(x) for x in own], float)
    sums = np.array([np.sum([np.float32(cotrain.page_features(p.url or "", p.html or "")) for p in x], axis=0) if x else np.zeros(cotrain.PAGE_SIZE) for x in own])

    text = cotrain.text_features(*utf8(pa.array([r.text or "" for r in rows])))
    meta = cotrain.meta_features([r.source for r in rows], [r.lang for r in rows], np.array([np.nan if r.n_chars is None else r.n_chars for r in rows], float))
    meta = np.hstack([meta, cotrain.page_view(n, sums)])
    return [r.doc_id for r in rows], [v.astype(np.float16).astype(np.float64) for v in (text, meta)]


def plain(ids, views, labels, held, order, rounds):
    """The definitions over arrays: no bins' sums over tasks, no broadcast, no scratch table."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    place = {d: i for i, d in enumerate(ids)}
    known = [place[d] for d in order if d in labels and d in place and d not in held]
    y = np.array([float(labels[ids[i]] > 0) for i in known])
    hold = np.arange(len(y)) % 4 == 3
    fit = lambda v, on, z=None: cotrain.fit(views[v][known][on] if z is None else z, y[on], ridge=1.0 if z is None else 0.1)
    w = [fit(0, ~hold), fit(1, ~hold)]
    free = np.array([i for i, d in enumerate(ids) if d not in held])
    given = []

    def scaled(v):
        own = w[v][0] + views[v] @ w[v][1:]
        s = fit(v, hold, own[known][hold][:, None])
        return s[0] + s[1] * own

    for _ in range(rounds):
        z = [scaled(v) for v in (0, 1)]
        new, counts = [], []
        for v in (0, 1):
            teacher = z[1 - v][free]
            at = np.clip((teacher + 20) * 100, 0, 3999).astype(int)
            total = np.cumsum(np.bincount(at, minlength=4000))
            low = next(i for i in range(4000) if total[i] >= 0.05 * total[-1])
            high = next((i for i in range(4000) if total[i] > 0.95 * total[-1]), 4000)
            low, high = min(low, high - 1), max(high, low + 1)
            rows = free[(at <= low) | (at >= high)]
            said = sig(z[1 - v][rows])
            sure = abs(2 * said - 1)
            x = np.hstack([np.ones((len(rows), 1)), views[v][rows]])
            own = np.hstack([np.ones((int((~hold).sum()), 1)), views[v][known][~hold]])
            p = sig(own @ w[v])
            ridge = np.array([1e-6] + [1.0] * (len(w[v]) - 1))
            told, base = np.clip(sig(z[1 - v][known][hold]), 1e-12, 1 - 1e-12), y[hold].mean()
            bits = lambda q: -(y[hold] * np.log(q) + (1 - y[hold]) * np.log(1 - q)).mean()
            most = 0.5 * max(0, 1 - bits(told) / bits(base)) * max(1, 1000 / len(own))
            curve = (own * (np.maximum(p * (1 - p), 1e-6) + most / 4)[:, None]).T @ own + np.diag(ridge)
            pull = x.T @ (sure * (sig(x @ w[v]) - said)) * most * len(own) / sure.sum()
            new.append(w[v] - np.linalg.solve(curve, own.T @ (p - y[~hold]) + ridge * w[v] + pull))
            counts.append(len(rows))
        w, given = new, [*given, counts]
    z = np.stack([scaled(0), scaled(1)], axis=1)
    both = fit(0, hold, z[known][hold])
    for v in (0, 1):
        if both[1 + v] < 0:
            both = np.insert(fit(0, hold, z[known][hold][:, [1 - v]]), 1 + v, 0.0)
    return sig(both[0] + z @ both[1:]), given


def test_query_against_arrays_in_memory(spark, tables, arrays):
    ids, views = arrays
    found = {r.doc_id: r for r in queries.op7_quality_classifier(spark, SF).collect()}
    held = {d for d, r in found.items() if r.held_out}
    labels = {r.doc_id: r.quality for r in tables[1].collect() if r.quality is not None}
    order = [r.doc_id for r in tables[1].selectExpr("doc_id").distinct().orderBy(cotrain.F.xxhash64(cotrain.F.lit(7), "doc_id"), "doc_id").collect()]
    expected, _ = plain(ids, views, labels, held, order, cotrain.ROUNDS)
    assert set(found) == set(ids)
    assert np.abs(np.array([found[d].score for d in ids]) - expected).max() < 1e-4


def test_both_views_receive_labels_in_every_round(tables):
    docs, labels = tables
    found = cotrain.views(docs)
    model = cotrain.train(found, labels)
    free = found.where("not held_out").count()
    assert len(model.given) == cotrain.ROUNDS
    assert all(0.05 * free <= n <= free for pair in model.given for n in pair)


def test_held_out_accuracy_with_and_without_exchange(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "pages"))
    right = {}
    for rounds in (0, cotrain.ROUNDS):
        rows = cotrain.classify(docs, labels, rounds, pages).join(labels, "doc_id").where("held_out and quality is not null")
        right[rounds] = rows.selectExpr("avg(int(kept = (quality = 1))) as right").first()["right"]
    print("held-out accuracy by rounds", right)
    assert right[cotrain.ROUNDS] >= 0.97 and right[cotrain.ROUNDS] >= right[0] - 0.01


def test_worth_of_the_page_view_on_linked_documents(spark):
    """On documents that pages hold, the metadata view explains held-out labels; on the others it can't know much."""
    docs, labels, pages = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels", "pages"))
    views = cotrain.views(docs, pages)
    model = cotrain.train(views, labels)
    assert model.worth[1] > 0.03 and (model.combine[1:] >= 0).all()
    linked = {r.doc_id for r in cotrain.features(docs).join(cotrain.linked_pages(pages), "first", "left_semi").select("doc_id").collect()}
    rows = cotrain.score(views, model).join(labels, "doc_id").where("held_out and quality is not null").collect()
    own = [r for r in rows if r.doc_id in linked]
    y, p = np.array([float(r.quality) for r in own]), np.array([r.meta_score for r in own])
    worth = 1 - cotrain.loss(p, y) / cotrain.loss(np.full(len(y), y.mean()), y)
    print("linked", len(linked), "held out", len(own), "worth of the metadata view there", worth, "on all", model.worth)
    assert len(linked) > 2000 and worth > 0.1


def test_exchange_helps_where_labels_are_few(spark):
    """Words lean one way or the other, titles say so but for some noise: with few labels the views teach each other."""
    rng = random.Random(8)
    good, bad = ([f"{c}{i:03}" for i in range(120)] for c in "gb")
    docs, pages, labels = [], [], []
    for i in range(1600):
        y = rng.random() < 0.5
        words = [rng.choice(good if (rng.random() < 0.58) == y else bad) for _ in range(60)]
        docs.append((i, " ".join(words)))
        noisy = y if rng.random() < 0.92 else not y
        pages.append((i, f"https://h{rng.randrange(9)}.example/{i}", f"<html><title>{'plain title' if noisy else '### $$$ ***'}</title><p>{' '.join(words)}</p></html>"))
        labels.append((i, int(y)))
    df, side = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(pages, "page_id long, url string, html string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    few = known.where("doc_id % 20 = 0")  # of these, three quarters are not held out
    views = cotrain.views(df, side)
    right, kept = {}, {}
    for rounds in (0, 12):
        rows = cotrain.score(views, cotrain.train(views, few, rounds=rounds)).join(known, "doc_id").where("held_out").collect()
        kept[rounds] = {r.doc_id: r.kept for r in rows}
        right[rounds] = sum(r.kept == (r.quality == 1) for r in rows) / len(rows)
    print("few labels", right, "changed", sum(kept[0][d] != kept[12][d] for d in kept[0]), "of", len(kept[0]))
    assert right[12] > right[0] and kept[0] != kept[12]


def test_links_of_edge_rows(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, words), (1, words), (2, None), (3, "few words"), (4, words.upper()), (None, "x " + words)], "doc_id long, text string")
    pages = spark.createDataFrame([(1, None, None), (2, "u", f"<p>{words}</p><p>{words}</p>"), (2, "u", f"<div>a</div><p><b>{words.replace('w3 ', '&#119;3 ')}"), (3, "", "<p>x<p>y")], "page_id long, url string, html string").selectExpr("*", "'clash' as first", "1 as n", "1 as sums")
    found = {r.doc_id: r.n for r in cotrain.features(docs).join(cotrain.linked_pages(pages), "first", "left").collect()}
    assert found == {1: 2, 2: None, 3: None, 4: 2, None: None}
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert cotrain.classify(docs, labels, pages=pages).count() == 6 and cotrain.classify(docs, labels, pages=pages.where("false")).count() == 6
