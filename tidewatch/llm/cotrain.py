"""Operator 7: a quality classifier by co-training of two views.

One view sees a document's words: shares and repetition of words and characters, and hashed words. The
other sees its metadata: source, language and stated length, and the pages that hold it: their address, markup, title and declared
language. A page holds a document if LINK words from the start of one of its blocks (tags taken out, entities decoded) are the document's first ones; of
several pages the mean counts, and how many they are; a document without a page has an indicator of its own. Both are logistic models, fitted first on a
bounded sample of labelled rows. Over several rounds each view scores all documents and hands those that it is most
confident of, a share at either end of its calibrated scores, to the other one as soft pseudo-labels, weighted by
confidence; the other view takes a step over its labelled rows and all that it was handed. Pseudo-labels together weigh as much as PSEUDO of
the labelled rows (of FEW rows at the least), however many they are, times what the view that gives them explains of held-back labels, so rounds do the same at
every size of the table and a weak view teaches little. The held-back part
of the labels calibrates both views and the weights that combine them. All documents are then scored.

Pages are joined by hashes of these words, summed by hash before they move, so that a block that many pages share is one row a task.
Features of all documents are computed once, as half-precision numbers in a scratch table; rounds read that, and only sums of
gradients and counts of scores by bin come to the driver.

Defined cases: a null or empty text has zero features and is scored like any other; metadata columns that
a table lacks count as null; texts of fewer than LINK words have no page, nor have any without a table of pages; null addresses and markup are empty; labels of unknown documents are ignored, and of several labels for a document
the largest counts; with labels of one class only, every document scores that class, and without labels 0.5; repeated rows score
alike; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langmix import held_out
from .shared import arrow_schema, as_batch, cut, mapped, passes, scratch_table, utf8
from .words import Words, covered, mix, repeated, window_hash

#: Labelled rows that the models are fitted on, at most.
LABELLED = 8_000
#: Rounds, the share of all documents that a view hands over at either end of its scores, and what pseudo-labels weigh together.
ROUNDS, HANDED, PSEUDO = 4, 0.05, 0.5
#: Labelled rows that pseudo-labels are weighed by at the least: with fewer labels the exchange counts for more.
FEW = 1_000
#: Bins of calibrated log-odds, and the log-odds that the outer ones begin at.
BINS, WIDEST = 4_000, 20.0
#: Hash buckets of words, and of source and language.
WORD_BUCKETS, META_BUCKETS = 256, 32
RIDGE, KEPT = 1.0, 0.5
#: Words that link a page with a document; hash buckets of hosts and of declared languages.
LINK, PAGE_BUCKETS = 12, 8
#: Linked beginnings of documents that are broadcast, at most.
BROADCAST = 100_000
_UNSEEN = re.compile(r"<(script|style)[^>]*>.*?</\1>|<!--.*?-->", re.S | re.I)
_BLOCK = re.compile(r"<(?:h[1-6]|p|div|article|section|main|body|td|li|pre|blockquote)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]+>")
_ADDRESS = re.compile(r"(?:(\w+)://)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", re.S)


def text_features(data: np.ndarray, off: np.ndarray, w: Words | None = None) -> np.ndarray:
    w = w or Words(data, off, lower=True)
    chars = np.maximum(w.per_doc(w.chars()), 1)[:, None]
    n = np.maximum(w.n, 1)[:, None]

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[off[1:]] - total[off[:-1]])[:, None] / chars

    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    digit, high, space = (data >= 48) & (data <= 57), data >= 128, data <= 32
    symbols = ~(lower | upper | digit | high | space)
    h = w.hashes()
    salted = mix(h + w.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    again = repeated(salted)
    starts = w.windows(3)
    grams = starts[repeated(mix(window_hash(h, starts, 3) + w.doc[starts].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))]
    lengths = w.chars()
    stats = [
        share(upper), share(digit), share(high), share(symbols), share(data == 124), share((data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42)),
        share((data == 46) | (data == 44)), share(data == 33), w.per_doc(again.astype(np.int64))[:, None] / n, w.per_doc(covered(grams, 3, len(w)).astype(np.int64))[:, None] / n,
        w.per_doc((lengths > 12).astype(np.int64))[:, None] / n, w.per_doc((lengths <= 2).astype(np.int64))[:, None] / n, np.log1p(w.n)[:, None] / 10, (w.n < 20)[:, None],
    ]
    hashed = np.bincount(w.doc * WORD_BUCKETS + (h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=w.docs * WORD_BUCKETS).reshape(w.docs, -1)
    return np.hstack([*stats, np.sqrt(hashed / n)]).astype(np.float32)


def meta_features(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    out = np.zeros((len(source), 2 * META_BUCKETS), np.float32)
    for d, (s, g) in enumerate(zip(source, lang, strict=True)):
        out[d, zlib.crc32(repr(s).encode()) % META_BUCKETS] = 1
        out[d, META_BUCKETS + zlib.crc32(repr(g).encode()) % META_BUCKETS] = 1
    stated = np.log1p(np.maximum(np.nan_to_num(n_chars.astype(np.float64)), 0))[:, None] / 10
    return np.hstack([stated, stated * stated, np.isnan(n_chars)[:, None], out]).astype(np.float32)


def page_features(url: str, markup: str) -> list[float]:
    """What an address and markup say about a page, apart from its text."""
    scheme, host, path, query, part = _ADDRESS.match(url).groups()
    title = re.search(r"<title[^>]*>(.*?)</title>", markup, re.S | re.I)
    title = html.unescape(title[1]) if title else ""
    stated = re.search(r"<html[^>]*\blang=[\"']?([\w-]+)", markup, re.I)
    size, long = max(len(markup), 1), max(len(title), 1)
    out = [
        np.log1p(len(markup)) / 10, 100 * len(re.findall(r"&#?\w+;", markup)) / size, 100 * markup.count("<") / size, markup.count("<script") / 10, markup.count("<a ") / 10, markup.count("<li") / 20,
        markup.count("<p") / 20, markup.count("<br") / 20, "<article" in markup, len(title) / 100, 10 * sum(c in "#*$%&|<>" for c in title) / long, 10 * sum("A" <= c <= "Z" for c in title) / long,
        path.count("/") / 5, bool(query), bool(part), scheme == "https",
    ]
    hot = [0.0] * (2 * PAGE_BUCKETS)
    hot[zlib.crc32(host.encode()) % PAGE_BUCKETS] = 1.0
    hot[PAGE_BUCKETS + zlib.crc32((stated[1].lower() if stated else "").encode()) % PAGE_BUCKETS] = 1.0
    return [float(x) for x in out] + hot


PAGE_SIZE = len(page_features("", ""))


def block_hashes(markup: str) -> np.ndarray:
    """Hashes of the LINK words from each start of a block on, each once."""
    pieces = [html.unescape(_TAG.sub(" ", x)) for x in _BLOCK.split(_UNSEEN.sub(" ", markup))]
    raw = [x.encode() + b" " for x in pieces]
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = Words(data, np.array([0, len(data)]), lower=True)
    first = np.unique(np.searchsorted(w.start, np.cumsum([0, *map(len, raw[:-1])])))
    return np.unique(window_hash(w.hashes(), first[first + LINK <= len(w)], LINK))


def linked_pages(pages: DataFrame) -> DataFrame:
    """(first, n, sums): of the pages with a block that begins with some words, by their hash: how many they are, and the sums of their features."""
    schema = f"first long, {', '.join(f'f{i} float' for i in range(PAGE_SIZE))}"
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keys, rows = [], []
                for url, markup in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = block_hashes(markup)
                    keys.append(own.view(np.int64))
                    rows.append(np.repeat(np.array([page_features(url, markup)], np.float32), len(own), axis=0))
                whole = np.concatenate(rows)
                yield as_batch([np.concatenate(keys), *(np.ascontiguousarray(whole[:, i]) for i in range(PAGE_SIZE))], arrow)

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = pages.select(blank("url"), blank("html")).mapInArrow(run, schema)
    return rows.groupBy("first").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(PAGE_SIZE)]).select("first", "n", F.array(*[f"f{i}" for i in range(PAGE_SIZE)]).alias("sums"))


def page_view(n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of documents with n pages: whether none, how many, and the mean of their features."""
    return np.hstack([(n == 0)[:, None], np.log1p(n)[:, None] / 5, sums / np.maximum(n, 1)[:, None]]).astype(np.float32)


def with_pages(found: DataFrame, pages: DataFrame | None) -> DataFrame:
    """features() with the page view in its metadata view."""
    if pages is None:
        rows = found.withColumns({"n": F.lit(None).cast("long"), "sums": F.lit(None).cast("array<double>")})
    else:
        firsts = found.select("first").where("first is not null").distinct()
        linked = cut(linked_pages(pages).join(firsts, "first", "left_semi"))
        rows = found.join(F.broadcast(linked) if linked.count() <= BROADCAST else linked, "first", "left")

    def kernel(batch: pa.RecordBatch):
        n = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        sums = np.zeros((len(n), PAGE_SIZE))
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = batch.column(5).take(pa.array(some)).flatten().to_numpy().reshape(-1, PAGE_SIZE)
        meta = np.hstack([_matrix(batch.column(3)), page_view(n, sums)]).astype(np.float16)
        yield [*batch.columns[:3], [r.tobytes() for r in meta]]

    return mapped(rows.select("doc_id", "held_out", "text_view", "meta_view", "n", "sums"), kernel, "doc_id long, held_out boolean, text_view binary, meta_view binary")


def _views(batch: pa.RecordBatch):
    """(first row, row after the last, text features, metadata features, hashes of first words) of text, source, lang, n_chars."""
    for i, j, data, off in passes(batch.column(0)):
        rows = batch.slice(i, j - i)
        n_chars = rows.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        w = Words(data, off, lower=True)
        some = w.n >= LINK
        first = np.zeros(w.docs, np.int64)
        first[some] = window_hash(w.hashes(), w.at[:-1][some], LINK).view(np.int64)
        yield i, j, text_features(data, off, w), meta_features(rows.column(1).to_pylist(), rows.column(2).to_pylist(), n_chars), pa.array(first, mask=~some)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression with a ridge, by Newton's method; the first weight is the intercept."""
    z = np.hstack([np.ones((len(x), 1)), x.astype(np.float64)])
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(z.shape[1])
    hold = np.full(len(w), ridge)
    hold[0] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(hold), z.T @ (weight * (p - y)) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return w[0] + x.astype(np.float64) @ w[1:]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


class Model:
    """Both views' weights, each one's calibration, and how the calibrated views combine.

    given: by round and view, how many documents it was handed, of all the documents that may be learned from.
    """

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        self.only = float(y[0]) if len(y) and (y == y[0]).all() else None if len(y) else 0.5
        self.given: list[list[int]] = []
        if self.only is not None:
            return
        hold = np.arange(len(y)) % 4 == 3  # rows come in hash order
        if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
            hold = np.zeros(len(y), bool)
        held = hold if hold.any() else ~hold
        self.views, self.y = [v[~hold].astype(np.float64) for v in views], y[~hold]
        self.held_views, self.held_y = [v[held].astype(np.float64) for v in views], y[held]
        self.weights = [fit(v, self.y) for v in self.views]
        self.calibrate()

    def calibrate(self) -> None:
        self.scale = [fit(logit(w, v)[:, None], self.held_y, ridge=0.1) for w, v in zip(self.weights, self.held_views, strict=True)]
        both = np.stack([self.calibrated(v, self.held_views[v]) for v in (0, 1)], axis=1)
        self.combine = fit(both, self.held_y, ridge=0.1)
        for view in (0, 1):
            if self.combine[1 + view] < 0:  # what a view says is never turned round: the other one decides alone
                self.combine = np.insert(fit(both[:, [1 - view]], self.held_y, ridge=0.1), 1 + view, 0.0)
        base = loss(np.full(len(self.held_y), self.held_y.mean()), self.held_y)
        self.worth = [max(0.0, 1 - loss(sigmoid(z), self.held_y) / base) if base else 0.0 for z in both.T]

    def calibrated(self, view: int, x: np.ndarray) -> np.ndarray:
        """A view's calibrated log-odds."""
        return self.scale[view][0] + self.scale[view][1] * logit(self.weights[view], x)

    def step(self, view: int, pull: np.ndarray, weight: float) -> None:
        """A step of a view over its labelled rows (Newton's) and the gradient and weight of what it was handed.

        Pseudo-labels are scaled to weigh PSEUDO of the labelled rows, or of FEW rows if there are fewer, times the other view's worth: the share of the loss of
        held-back labels that its scores explain. Their curvature is bounded by a quarter of the features' second moments, taken from the labelled rows.
        """
        z, w = np.hstack([np.ones((len(self.y), 1)), self.views[view]]), self.weights[view]
        p = sigmoid(z @ w)
        hold = np.full(len(w), RIDGE)
        hold[0] = 1e-6
        most = PSEUDO * self.worth[1 - view] * max(1.0, FEW / len(self.y)) if weight else 0.0
        share = most * len(self.y) / weight if weight else 0.0
        curve = (z * (np.maximum(p * (1 - p), 1e-6) + most / 4)[:, None]).T @ z + np.diag(hold)
        self.weights[view] = w - np.linalg.solve(curve, z.T @ (p - self.y) + hold * w + share * pull)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.only is not None:
            one = np.full(len(text), self.only)
            return one, one, one
        a, b = self.calibrated(0, text), self.calibrated(1, meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] + self.combine[1] * a + self.combine[2] * b)

    def slim(self) -> Model:
        """What workers need: no labelled rows."""
        out = object.__new__(Model)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k in ("only", "weights", "scale", "combine")}
        return out


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.clip((z + WIDEST) * (BINS / (2 * WIDEST)), 0, BINS - 1).astype(np.int64)


def ends(counts: np.ndarray, share: float = HANDED) -> tuple[int, int]:
    """The last bin of the low end and the first one of the high end: the fewest bins that hold a share of all, or the outermost."""
    total = np.cumsum(counts)
    low = int(np.searchsorted(total, share * total[-1]))
    high = int(np.searchsorted(total, (1 - share) * total[-1], side="right"))
    return min(low, high - 1), max(high, low + 1)


def handed(teacher: np.ndarray, low: int, high: int, student: np.ndarray, w: np.ndarray) -> tuple[int, float, np.ndarray]:
    """(documents, their weight, gradient) of what a teacher's calibrated log-odds hand to a student of weights w."""
    at = bin_of(teacher)
    some = (at <= low) | (at >= high)
    said = sigmoid(teacher[some])
    sure = np.abs(2 * said - 1)
    z = np.hstack([np.ones((int(some.sum()), 1)), student[some].astype(np.float64)])
    return int(some.sum()), float(sure.sum()), z.T @ (sure * (sigmoid(z @ w) - said))


def _columns(docs: DataFrame) -> list:
    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    return ["text", *[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]]


def features(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, held_out, both views (without pages) as half-precision numbers, and the hash of its first words."""

    def kernel(batch: pa.RecordBatch):
        for i, j, text, meta, first in _views(batch):
            part = batch.slice(i, j - i)
            yield [part.column(4), part.column(5), *[[r.tobytes() for r in v.astype(np.float16)] for v in (text, meta)], first]

    rows = docs.select(*_columns(docs), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))
    return mapped(rows, kernel, "doc_id long, held_out boolean, text_view binary, meta_view binary, first long")


def _matrix(column) -> np.ndarray:
    data, off = utf8(column)
    return data.view(np.float16).reshape(len(off) - 1, -1).astype(np.float32) if len(off) > 1 else np.zeros((0, 1), np.float32)


def train(found: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """A model from at most `labelled` documents with a label, and pseudo-labels of all documents, outside the held-out fold.

    found: features() of the documents.
    """
    order = F.xxhash64(F.lit(7), "doc_id")
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), target)
    known = known.groupBy("doc_id").agg(F.max(target).cast("double").alias("label"))
    known = known.join(found.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(labelled)
    rows = found.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text_view", "meta_view")).alias("v"), F.max("label").alias("label"))
    got = rows.orderBy(order, "doc_id").select("v.*", "label").toArrow()  # `labelled` rows at most
    y = (np.array(got["label"].to_pylist(), float) > 0).astype(float)
    model = Model([_matrix(got["text_view"]), _matrix(got["meta_view"])], y)
    if model.only is not None:
        return model
    pool = found.where("not held_out").select("text_view", "meta_view")
    for _ in range(rounds):
        shared = found.sparkSession.sparkContext.broadcast(model.slim())
        counts = [np.zeros(BINS, np.int64) for _ in (0, 1)]
        for view, at, n in _bins(pool, shared).collect():  # BINS rows a view at most
            counts[view][at] = n
        limits = [ends(c) for c in counts]
        size = [len(w) for w in model.weights]
        sums = [np.zeros(n + 2) for n in size]
        for view, at, x in _pulls(pool, shared, limits).collect():  # a row a weight
            sums[view][at] = x
        for view in (0, 1):
            model.step(view, sums[view][2:], sums[view][1])
        model.given.append([int(x[0]) for x in sums])
        model.calibrate()
    return model


def _bins(pool: DataFrame, shared) -> DataFrame:
    """(view, bin, n): how many documents' calibrated scores each bin has."""
    schema = "view int, bin int, n long"
    arrow = arrow_schema(schema)

    def run(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for view in (0, 1):
                total[view] += np.bincount(bin_of(shared.value.calibrated(view, _matrix(batch.column(view)))), minlength=BINS)
        view, at = np.nonzero(total)
        yield as_batch([view, at, total[view, at]], arrow)

    return pool.mapInArrow(run, schema).groupBy("view", "bin").agg(F.sum("n").alias("n"))


def _pulls(pool: DataFrame, shared, limits: list[tuple[int, int]]) -> DataFrame:
    """(view, i, x): of what the other view hands to each, the number, the weight, and then the gradient, summed over all documents."""
    schema = "view int, i int, x double"
    arrow = arrow_schema(schema)

    def run(batches):
        model = shared.value
        total = [np.zeros(len(w) + 2) for w in model.weights]
        for batch in batches:
            views = [_matrix(batch.column(v)) for v in (0, 1)]
            for view in (0, 1):
                n, weight, pull = handed(model.calibrated(1 - view, views[1 - view]), *limits[1 - view], views[view], model.weights[view])
                total[view] += np.concatenate([[n, weight], pull])
        for view in (0, 1):
            yield as_batch([np.full(len(total[view]), view), np.arange(len(total[view])), total[view]], arrow)

    return pool.mapInArrow(run, schema).groupBy("view", "i").agg(F.sum("x").alias("x"))


def score(found: DataFrame, model: Model) -> DataFrame:
    """Every row's doc_id, held_out, both views' probabilities, score and kept, of features()."""
    shared = found.sparkSession.sparkContext.broadcast(model.slim())

    def kernel(batch: pa.RecordBatch):
        a, b, both = shared.value.score(_matrix(batch.column(2)), _matrix(batch.column(3)))
        yield [batch.column(0), batch.column(1), a, b, both, both >= KEPT]

    return mapped(found, kernel, "doc_id long, held_out boolean, text_score double, meta_score double, score double, kept boolean")


def views(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Both views of all documents, as a scratch table."""
    spark = docs.sparkSession
    own, path = scratch_table(spark, "features"), scratch_table(spark, "views")
    features(docs).write.parquet(own)
    with_pages(spark.read.parquet(own), pages).write.parquet(path)
    return spark.read.parquet(path)


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, pages: DataFrame | None = None) -> DataFrame:
    found = views(docs, pages)
    return score(found, train(found, labels, rounds=rounds))
