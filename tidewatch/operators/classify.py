"""Zero-shot labels on several axes, with a fallback where confidence is low, and place lookup in tiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import confidence_bucket
from tidewatch.functions.vector import GUARD

#: The labels of the four axes, in order.
ACTION_FORMS = ["Διαδήλωση/Πορεία/Συγκέντρωση", "Απεργία/Στάση εργασίας", "Κατάληψη", "Αποκλεισμός/Μπλόκο", "Μποϊκοτάζ", "Διαδικτυακή εκστρατεία", "Whistleblowing", "Αποχή"]
THEMATIC_FIELDS = ["Εργασιακό", "Πολιτικό/Θεσμικό", "Οικονομικό", "Περιβαλλοντικό", "Δικαιώματα/Κοινωνικό", "Εκπαίδευση", "Αστυνομική Βία", "Άλλο"]
CHANNELS = ["Φυσικό (offline)", "Ψηφιακό (online)", "Υβριδικό"]
INTENSITIES = ["Ειρηνική", "Διαταρακτική (μη βίαιη, παρεμποδιστική)", "Βίαιη/Συγκρουσιακή"]
AXES = {"action_forms": ACTION_FORMS, "thematic_fields": THEMATIC_FIELDS, "channel": CHANNELS, "intensity": INTENSITIES}
#: The labels in English.
ENGLISH = {
    "Διαδήλωση/Πορεία/Συγκέντρωση": "Demonstration / March / Rally", "Απεργία/Στάση εργασίας": "Strike / Work stoppage", "Κατάληψη": "Occupation",
    "Αποκλεισμός/Μπλόκο": "Blockade", "Μποϊκοτάζ": "Boycott", "Διαδικτυακή εκστρατεία": "Online campaign", "Whistleblowing": "Whistleblowing", "Αποχή": "Abstention",
    "Εργασιακό": "Labour", "Πολιτικό/Θεσμικό": "Political / Institutional", "Οικονομικό": "Economic", "Περιβαλλοντικό": "Environmental",
    "Δικαιώματα/Κοινωνικό": "Rights / Social", "Εκπαίδευση": "Education", "Αστυνομική Βία": "Police violence", "Άλλο": "Other",
    "Φυσικό (offline)": "Physical (offline)", "Ψηφιακό (online)": "Digital (online)", "Υβριδικό": "Hybrid",
    "Ειρηνική": "Peaceful", "Διαταρακτική (μη βίαιη, παρεμποδιστική)": "Disruptive (non-violent, obstructive)", "Βίαιη/Συγκρουσιακή": "Violent / Confrontational",
}
MULTI = ("action_forms", "thematic_fields")
MULTI_LEAST, MULTI_MOST, LOW_CONFIDENCE = 0.35, 3, 0.45
#: Labels of all axes, at most.
MOST_LABELS = 1_000


def level(intensity: Column) -> Column:
    """1 to 3 by place on the intensity axis; null outside it."""
    place = F.array_position(F.array(*map(F.lit, INTENSITIES)), intensity)
    return F.when(place > 0, place.cast("int"))


def _scored(vectors: DataFrame, labels: DataFrame, key: str, vector: str, schema: str, pick) -> DataFrame:
    """What pick(similarities, axes, names) makes of each batch of vectors and all labels in order of axis and ord: row numbers and
    further columns. The labels, a fixed list of a checked size, go with the task, so no vector is repeated or shuffled. A null
    vector, or one of another length, has similarity 0; equal labels have equal similarities."""
    known = labels.select("axis", "ord", "label", F.col("label_vector").cast("array<double>").alias("v")).limit(MOST_LABELS + 1).collect()
    if len(known) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not known:
        return vectors.sparkSession.createDataFrame([], schema)
    known = sorted(known, key=lambda r: (r.axis, r.ord))
    sizes = {len(r.v) for r in known if r.v is not None}
    if len(sizes) > 1:
        raise ValueError("label vectors of different lengths")
    size = max(sizes, default=0)
    table, of = np.unique(np.array([r.v if r.v is not None else [0.0] * size for r in known], float), axis=0, return_inverse=True)
    axes, names = np.array([r.axis for r in known], object), np.array([r.label for r in known], object)
    lengths = np.sqrt((table * table).sum(axis=1))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sims = np.zeros((len(batch), len(table)))
            some = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
            if len(some) and size:
                x = pc.list_flatten(column.take(pa.array(some))).to_numpy(zero_copy_only=False).astype(float).reshape(len(some), size)
                sims[some] = x @ table.T / (np.sqrt((x * x).sum(axis=1))[:, None] * lengths + GUARD)
            at, *columns = pick(sims[:, of.ravel()], axes, names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[c.split()[0] for c in schema.split(", ")])

    return vectors.select(key, vector).mapInArrow(run, schema)


def zero_shot(vectors: DataFrame, labels: DataFrame, key: str, vector: str, multi: tuple[str, ...] = MULTI, least: float = MULTI_LEAST, most: int = MULTI_MOST) -> DataFrame:
    """(key, axis, labels, confidence): on a multi-label axis the best labels of at least a similarity, three at most, else the
    best one; on others the best one. The first label of an axis wins ties; confidence is the best similarity."""

    def pick(sims: np.ndarray, axes: np.ndarray, names: np.ndarray):
        at, said, lists, sure = [], [], [], []
        for axis in dict.fromkeys(axes):
            own = np.flatnonzero(axes == axis)
            s = sims[:, own]
            order = np.argsort(-s, axis=1, kind="stable")[:, : most if axis in multi else 1]
            best = np.take_along_axis(s, order, axis=1)
            keep = best >= least
            keep[:, :1] = True
            ends = np.concatenate([[0], keep.sum(axis=1).cumsum()])
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[own][order[keep]].tolist(), pa.string())))
            at.append(np.arange(len(s))), sure.append(best[:, 0]), said.extend([axis] * len(s))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return cat(at, np.int64), pa.array(said, pa.string()), pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string())), pa.array(cat(sure, float))

    return _scored(vectors, labels, key, vector, f"{key} {dict(vectors.dtypes)[key]}, axis string, labels array<string>, confidence double", pick)


def confidence(found: DataFrame, key: str, low: float = LOW_CONFIDENCE) -> DataFrame:
    """(key, confidence map, min_confidence, low): the least sure axis decides whether another opinion is asked."""
    rows = found.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "confidence")))).alias("confidence"), F.min("confidence").alias("min_confidence"))
    return rows.withColumn("low", F.col("min_confidence") < low)


def with_fallback(found: DataFrame, titles: DataFrame, key: str, model: Callable[[list[str]], dict[str, list[str]] | None]) -> DataFrame:
    """found with the labels that a model gives to keys of low confidence; where it fails, or says nothing, zero-shot stays.
    Confidence stays that of zero-shot. titles: key, titles."""
    low = confidence(found, key).where("low").select(key).join(titles, key, "left")
    kind = dict(low.dtypes)[key]

    def ask(batches):
        for batch in batches:
            keys, axes, labels = [], [], []
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    said = model(own or []) or {}
                except Exception:  # a model that is down costs its opinion only
                    said = {}
                for axis, names in said.items():
                    keys.append(k), axes.append(axis), labels.append(list(names))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(axes, pa.string()), pa.array(labels, pa.list_(pa.string()))], names=[key, "axis", "said"])

    said = low.select(key, "titles").mapInArrow(ask, f"{key} {kind}, axis string, said array<string>")
    return found.join(said, [key, "axis"], "left").select(key, "axis", F.coalesce("said", "labels").alias("labels"), "confidence")


def geocode_tiers(df: DataFrame, tiers: list[str]) -> DataFrame:
    """df with locations: the first tier (an array of structs name, lat, lon) that has any; the first of it is primary."""
    some = F.coalesce(*[F.when(F.size(t) > 0, F.col(t)) for t in tiers])
    flagged = F.transform(some, lambda x, i: F.struct(x["name"].alias("name"), x["lat"].alias("lat"), x["lon"].alias("lon"), (i == 0).alias("is_primary")))
    return df.withColumn("locations", flagged)


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], batch_size: int = 32) -> DataFrame:
    """(key, embedding) by a model that workers call on batches of texts; no rows, no call."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            vectors = [v for i in range(0, len(texts), batch_size) for v in model(texts[i : i + batch_size])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


class HashingModel:
    """A stand-in for an embedding model: unit vectors of hashed words, equal on every machine."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        words = [text.lower().split() for text in texts]
        codes, known = pd.factorize(np.array([w for own in words for w in own], object))
        hashes = np.fromiter((zlib.crc32(w.encode()) for w in known), np.int64, len(known))
        cells = np.repeat(np.arange(len(texts)), [len(own) for own in words]) * self.size + (hashes % self.size)[codes]
        signs = np.where(hashes >> 16 & 1, 1.0, -1.0)[codes]
        out = np.bincount(cells, signs, len(texts) * self.size).reshape(len(texts), self.size)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length > 0, length, 1)).tolist()


def prompt(titles: Column, bodies: Column, most_titles: int = 8, most_bodies: int = 3, chars: int = 400) -> Column:
    """What a summary model is given: the first titles, and the beginnings of the first bodies."""
    heads = F.array_join(F.transform(F.slice(titles, 1, most_titles), lambda t: F.concat(F.lit("- "), t)), "\n")
    texts = F.array_join(F.transform(F.slice(bodies, 1, most_bodies), lambda b: F.left(b, F.lit(chars))), "\n\n")
    return F.concat_ws("\n\n", heads, texts)


def category_of_titles(groups: DataFrame, key: str, titles: str, labels: DataFrame, model: Callable[[list[str]], list[list[float]]], most: int = 20) -> DataFrame:
    """(key, label, confidence, bucket) of a group by the embedding of its first titles in one text; a group without titles is left out."""
    texts = groups.where(F.size(titles) > 0).select(key, F.array_join(F.slice(titles, 1, most), " ").alias("__text"))
    return best_label(embed(texts, key, "__text", model), labels, key, "embedding")


def best_label(vectors: DataFrame, labels: DataFrame, key: str, vector: str, least: float | None = None) -> DataFrame:
    """(key, label, confidence, bucket) of the nearest label over all axes, the first in order on ties; below `least` the key is left out."""

    def pick(sims: np.ndarray, axes: np.ndarray, names: np.ndarray):
        best = sims.argmax(axis=1) if len(names) else np.empty(0, np.int64)
        return np.arange(len(best)), pa.array(names[best].tolist(), pa.string()), pa.array(sims[np.arange(len(best)), best])

    rows = _scored(vectors, labels, key, vector, f"{key} {dict(vectors.dtypes)[key]}, label string, confidence double", pick)
    return (rows if least is None else rows.where(F.col("confidence") >= least)).withColumn("bucket", confidence_bucket(F.col("confidence")))


def first_accepted(candidates: DataFrame, key: str, kinds: list[str], inside: Column) -> DataFrame:
    """The first candidate of each key, by ord, of an accepted kind that lies inside a territory."""
    rows = candidates.where(F.col("kind").isin(kinds) & inside)
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), "ord").alias("__b")).select(key, "__b.*")
