"""The audit against all orders applied to all documents one by one."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from tidewatch.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simulate(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = ""
        fails += "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (i is not None and i > first[text])
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                fails = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert collected(queries.queries()["op13_filter_audit"](spark, SF)) == simulate(docs, labels)


def test_edge_rows(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None, None), (2, "", ""), (3, " ", "a"), (None, "", "a"), (None, prose, None), (4, prose, "a"), (4, prose, "a"), (4, prose, "b"), (5, prose, "a"), (5, prose, "a"), (6, prose + " #", "b"), (7, "A " * 60, "b"), (8, prose * 300, "b")]
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("part", "mask", "digest", "n", "quality", "toxic", "low", "alone")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    assert collected(filter_audit.audit(table, known)) == simulate(docs, labels)
    assert filter_audit.audit(table.where("false"), known).count() == 0
    assert collected(filter_audit.audit(table, known.where("false"))) == simulate(docs, [])


def test_polynomial():
    p = filter_audit.RemovalPolynomial({0: 5, 1: 2, 3: 4, 7: 6, 31: 1})
    assert p.total == 18 and p.corner(0) == 0 and p.corner(1) == 13 and p.corner(2) == 11 and p.corner(31) == 13
    assert sum(p.shapley(i) for i in range(5)) == 13 and p.shapley(0) * 120 == 120 * 2 + 60 * 4 + 40 * 6 + 24
