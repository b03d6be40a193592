"""Random spans: planted secrets by form, encoding and length, plain texts, and a brute-force version over a whole table."""

import math
import random
import re

import pytest

from tidewatch.llm import queries, secrets

FORMS = ['export VALUE_X={}', 'value "{}" here', '{{"field": "{}"}}', 'see https://example.org/p?sig={}&v=2 now', "it is {} today"]


@pytest.mark.parametrize("length", [20, 24, 32, 48, 64])
def test_planted_secrets_are_found(spark, length):
    rng = random.Random(length)
    planted = [
        (f.format(token := "".join(rng.choice(a) for _ in range(length))), token, kind)
        for f in FORMS for kind, a in secrets.ENCODINGS.items() for _ in range(12)
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(planted)], "doc_id long, text string")
    found = {r.doc_id: [x.value for x in r.spans if x.kind in ("random", "hex")] for r in secrets.scan(docs).collect()}
    for kind in secrets.ENCODINGS:
        own = [any(v in token or token in v for v in found[i]) for i, (_, token, k) in enumerate(planted) if k == kind]
        assert sum(own) >= 0.9 * len(own), (kind, length, sum(own), len(own))


def test_prose_and_names_are_left_alone(spark):
    rng = random.Random(9)
    words = "the of and station report market government weather update morning service travel public history library river mountain".split()
    texts = []
    for i in range(400):
        slug = "-".join(rng.choice(words) for _ in range(6)) + f"-{rng.randrange(1990, 2030)}"
        name = "_".join(rng.choice(words) for _ in range(4)) + f"_v{rng.randrange(9)}"
        camel = "".join(rng.choice(words).title() for _ in range(4)) + str(rng.randrange(100))
        texts.append((i, f"{' '.join(rng.choice(words) for _ in range(40))} https://example.org/{slug} {name} {camel} x=1234567890123456789012"))
    got = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sum(len(r.spans) for r in got) <= 2


def brute(texts):
    """Random spans of all texts, from the definitions: tests on each token, then the two procedures by plain sorting."""
    tests = []
    for d, text in texts.items():
        for run in re.finditer(r"[0-9A-Za-z+/_=-]{20,}", text):
            if not re.search(r"[0-9]", run[0]):
                continue
            for a, b in secrets.pieces(run[0]):
                p = secrets.battery(run[0][a:b])
                if p is None:
                    continue
                mean = sum(math.tan((0.5 - min(max(p[k], 1e-15), 1 - 1e-15)) * math.pi) for k in ("even", "runs", "serial")) / 3
                fit = 1 / (math.pi * mean) if mean >= 1e6 else 0.5 - math.atan(mean) / math.pi
                up = lambda x: 10 ** (-min(320, int(-math.log10(max(x, 1e-300)) * 8)) / 8)
                tests.append((d, run.start() + a, run.start() + b, 2 ** int(math.log2(b - a)), up(fit), up(p["natural"])))

    def rejected(ps, share):
        weight = sum(w for w, _ in ps) / len(ps) if ps else 1
        q = sorted(p * weight / w for w, p in ps)
        cut = max((x for i, x in enumerate(q, 1) if x <= share * i / len(q)), default=-1)
        return [p * weight / w <= cut for w, p in ps]

    unfit = rejected([(t[3], t[4]) for t in tests], secrets.FIT)
    left = [t for t, u in zip(tests, unfit, strict=True) if not u]
    found = [t[:3] for t, r in zip(left, rejected([(t[3], t[5]) for t in left], secrets.FDR), strict=True) if r]
    return {(d, a, b) for d, a, b in found if not any(d == e and x <= a and b <= y and (a, b) != (x, y) for e, x, y in found)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_random_spans_of_the_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = queries.op4_secrets(spark, f"/root/testdata/{sf}").collect()
    mine = {(r.doc_id, *map(int, s.split(":")[1:])) for r in got for s in r.spans.split(",") if s.startswith("random")}
    assert mine == brute(texts)
