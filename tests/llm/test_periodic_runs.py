"""Runs against a search over all periods, and the planted texts of the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(x, least):
    n, out = len(x), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i:
                part = x[i : j + q]
                if len(part) >= max(least, 2 * q) and not any(part[s:] == part[:-s] for s in range(1, q)):
                    out.add((i, len(part), q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kernel(docs, least):
    first = np.cumsum([0, *map(len, docs)])
    found = [[] for _ in docs]
    for d, *run in zip(*(x.tolist() for x in periodic_runs.runs(np.array([y for x in docs for y in x], np.int64), first, least)), strict=True):
        found[d].append(tuple(run))
    return found


def test_small_alphabets():
    rng = random.Random(5)
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 2, 13, 30, 55]), rng.choice([1, 2, 3, 9])
            x = [rng.randrange(k) for _ in range(n)]
            a, p = rng.randrange(n + 1), rng.randint(1, 12)
            docs.append([x[i] if i < a else x[a + (i - a) % p] for i in range(n)] if a + p <= n else x)
        least = rng.choice([2, 4, 12])
        assert kernel(docs, least) == [all_runs(x, least) for x in docs]


def test_known_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    x = [ord(c) for c in fib[-1]]
    found = kernel([x, [1] * 5000, [1, 2] * 900 + [1], list(range(300)), list(range(300, 0, -1))], 2)
    assert found[0] == all_runs(x, 2) and found[1] == [(0, 5000, 1)] and found[2] == [(0, 1801, 2)] and found[3] == found[4] == []


def test_next_smaller():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 200):
        v = rng.permutation(n)
        expected = [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]
        assert periodic_runs.next_smaller(v).tolist() == expected


def test_query(spark):
    found = {r.doc_id: r for r in queries.queries()["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    longer = 0
    for r in docs:
        x = WORD.findall(r.text or "")
        n, h = len(x), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        if n > 700:  # quadratic
            longer += 1
            continue
        runs = all_runs(x, 12)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        got = found[r.doc_id]
        best = max(runs, key=lambda t: (t[1], -t[0], -t[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (len(runs), *best, milli), r.doc_id
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(x) if i not in gone).encode()).hexdigest()
    assert longer < len(docs) / 2


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (5, "x " * 30), (5, "x " * 30), (6, " ".join(map(str, range(20000))) + " a b" * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "sig", "n_words", "collapsed", "best", "__w")})
    out = periodic_runs.periodic_runs(docs).collect()
    got = sorted((str(r.doc_id), r.n_words, len(r.runs), len(r.collapsed)) for r in out)
    tail = len(" ".join(map(str, range(20000))) + " a b")
    assert got == sorted([("1", 0, 0, 0), ("2", 0, 0, 0), ("3", 0, 0, 0), ("None", 30, 1, 1), ("5", 30, 1, 1), ("5", 30, 1, 1), ("6", 20012, 1, tail)])
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs.where("false"))).count() == 0
    same = periodic_runs.planted(docs.drop("__w"))
    assert same.columns == docs.drop("__w").columns and same.where("doc_id is null").first().text == "x " * 30
