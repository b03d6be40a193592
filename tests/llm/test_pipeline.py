"""The whole pipeline against its stages written plainly, each over what the plain one before it kept."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_neardup import survivors
from test_random_spans import brute as random_spans
from tidewatch.llm import quality_rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def good(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        return {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)}

    if len(words) < 20 or 100 * len(inside(8)) > 30 * len(words):
        return False
    total = sum(map(len, words))
    if any(sum(len(words[i]) for i in inside(n)) / total > most for n, most in quality_rules.GRAM_LIMITS.items()):
        return False
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    return again / sum(map(len, lines)) <= quality_rules.LINE_LIMIT


def leaking(texts, bench):
    """Ids of texts that share 13 tokens in a row with an item."""
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = {tuple(w[k : k + 13]) for w in map(tokens, bench) for k in range(len(w) - 12)}
    return {i for i, t in texts.items() if any(tuple(w[k : k + 13]) in grams for w in [tokens(t)] for k in range(len(w) - 12))}


def masked(texts):
    spans = defaultdict(list)
    for d, a, b in random_spans(texts):
        spans[d].append((a, b))
    out = {}
    for d, text in texts.items():
        own = spans[d] + [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        own += [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        secret = sorted({i for a, b in own for i in range(a, b)})
        begins = {a for a, _ in own}
        done, parts = 0, []
        for i in secret:
            if i >= done and (i == 0 or i - 1 not in secret or i in begins and not any(a < i < b for a, b in own)):
                parts += [text[done:i], secrets.MASK]
            done = i + 1
        out[d] = "".join([*parts, text[done:]])
    return out


def targets(size, source):
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while True:
        left, free = sum(total.values()) - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * total[s] for s in over}


def planted(spark, at):
    """The smallest documents, with near copies, copies of other sources, leaks, secrets, repeated phrases and nulls beside them."""
    rng = random.Random(5)
    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    new = max(r["doc_id"] for r in docs) + 1
    some = [r for r in docs if r["text"] and len(WORD.findall(r["text"])) > 60]
    for k, r in enumerate(rng.sample(some, 12)):
        words = WORD.findall(r["text"])
        words[rng.randrange(len(words))] = f"other{k}"
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        fresh = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
        for text, source in (
            (" ".join(words), r["source"]), (r["text"], f"s{k % 3}"), (f"{fresh} {rng.choice(bench)} {fresh[::-1]}", r["source"]), (f"{fresh} x password = {token[:12]} {token} é", r["source"]),
            (fresh + " again and again" * 40, r["source"]), (None, r["source"]), (fresh, None),
        ):
            docs.append({**r, "doc_id": new, "text": text, "source": source})
            new += 1
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame([tuple(d[c] for c in schema.names) for d in docs], schema).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("own", [False, True])
def test_pipeline_by_plain_stages(spark, tmp_path, own):
    folder = planted(spark, tmp_path) if own else "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    raw = table.collect()
    source = {r.doc_id: r.source for r in raw}
    bench = [r.text or "" for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [{r.doc_id: r.text for r in raw if r.text and good(r.text)}]
    left = survivors(list(want[0].items()))
    want.append({i: t for i, t in want[0].items() if i in left})
    tainted = leaking(want[1], bench)
    want.append({i: t for i, t in want[1].items() if i not in tainted})
    want.append(masked(want[2]))
    assert len(want[0]) < len(raw) and tainted and (not own or len(want[1]) < len(want[0]) and any(secrets.MASK in t for t in want[3].values()))
    docs = table
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        path = f"{tmp_path}/stage-{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == table.columns and {r.doc_id: r.text for r in docs.collect()} == want[k], name
    final = corpus_pipeline.run(spark, folder).collect()
    assert len({r.doc_id for r in final}) == len(final) and all(r.text == want[3][r.doc_id] and r.source == source[r.doc_id] for r in final)
    size = {i: len(WORD.findall(t)) for i, t in want[3].items()}
    target, taken = targets(size, source), Counter()
    for r in final:
        assert r.size == size[r.doc_id] and 0 < r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
