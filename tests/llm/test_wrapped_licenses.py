"""License notices that are wrapped."""

import math
import random
import textwrap

import pytest

from tidewatch.llm import licenses


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "dnl "])
def test_wrapped_notices_are_found(spark, mark):
    def wrapped(text):
        return "some code here\n" + "\n".join(mark + x for x in textwrap.wrap(text, 60)) + "\nand code again"

    labels = [x for x, text in licenses.TEMPLATES.items() if len(text) > 75]
    assert {"bsd-terms", "mit-terms", "gpl-terms"} <= set(labels)
    docs = spark.createDataFrame([(i, wrapped(licenses.TEMPLATES[x])) for i, x in enumerate(labels)], "doc_id long, text string")
    for r in licenses.digest(licenses.scan(docs)).collect():
        assert labels[r.doc_id] in r.labels.split(",") and r.score == 1.0


def test_words_strewn_over_lines_are_no_notice(spark):
    words = licenses.TEMPLATES["bsd-terms"].split()
    text = "\n".join(f"{x} {' '.join(f'other{i}x{k}' for k in range(9))}" for i, x in enumerate(words))
    assert licenses.digest(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().labels == ""


def blocks_by_force(words, lines, own, contained):
    """All windows one by one: from the left, the best of those that overlap the first one, then on behind it."""
    need, span = math.ceil(contained * len(set(own)) - 1e-9), math.ceil(licenses.WIDER * len(own))
    out, at = [], 0
    while at < len(words):
        best = None
        for i in range(at, len(words)):
            if best and i >= reach:  # noqa: F821
                break
            seen, end = set(), None
            for j in range(i, min(i + span, len(words))):
                if words[j] in own and words[j] not in seen:
                    seen.add(words[j])
                    end = j + 1
            if words[i] in own and len(seen) >= need and lines[i] != lines[end - 1]:
                if best is None:
                    reach = end
                if best is None or len(seen) > best[2]:
                    best = (i, end, len(seen))
        if best is None:
            break
        out.append((best[0], best[2] / len(set(own))))
        at = best[1]
    return out


@pytest.mark.parametrize("label", ["mit-terms", "bsd-terms", "gpl-warranty", "apache-warranty"])
def test_notices_in_a_row_are_a_block_each(spark, label):
    text = licenses.TEMPLATES[label]
    docs = spark.createDataFrame([(k, "\n".join(textwrap.wrap(" ".join([text] * k), 50))) for k in range(1, 6)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        own = [b for b in r.blocks if b.label == label]
        assert len(own) == r.doc_id and all(b.share == 1 for b in own) and own[0].word == 0
        # A notice may end in words that it has before, which a block does not wait for.
        assert all(0 <= i * len(text.split()) - b.word <= 3 for i, b in enumerate(own))


def test_blocks_against_all_windows(spark):
    rng = random.Random(6)
    own = licenses.TEMPLATES["bsd-terms"].split()
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 6))]
            words += [w if rng.random() > 0.06 else rng.choice(own) for w in own[rng.randint(0, 3) :] if rng.random() > 0.04]
        texts.append("\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(b.word, round(b.share, 9)) for b in r.blocks] for r in licenses.scan(docs, {"bsd-terms": licenses.TEMPLATES["bsd-terms"]}).collect()}
    some = 0
    for i, text in enumerate(texts):
        lines = [k for k, line in enumerate(text.split("\n")) for _ in line.split()]
        expected = [(a, round(s, 9)) for a, s in blocks_by_force(text.split(), lines, own, licenses.CONTAINED)]
        assert found[i] == expected, i
        some += len(expected)
    assert some > 30
