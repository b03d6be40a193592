"""Secrets that stand behind names."""

import random
import string

from tidewatch.llm import secrets


def drawn(n, more, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(string.ascii_letters + string.digits + more) for _ in range(n))


NAMED = {
    1: ("aws_secret_access_key=", drawn(40, "+/", 1)),
    2: ("AccountKey=", drawn(86, "+/", 2) + "=="),
    3: ("https://host/path?sig=", drawn(43, "", 3)),
    4: ("sk_live_", drawn(30, "", 4) + "/+" + drawn(30, "", 5)),
    5: ("share/", drawn(30, "", 6) + "-_" + drawn(30, "", 7)),
    6: ("first=1=second-key=", drawn(40, "-_", 8)),
}


def test_values_are_cut_from_their_names(spark):
    rows = [(i, f"é before {name}{value} after") for i, (name, value) in NAMED.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in secrets.scan(docs).collect():
        assert any(s.value == NAMED[r.doc_id][1] for s in r.spans), (r.doc_id, r.spans)
    for r in secrets.redact(docs).collect():
        name, value = NAMED[r.doc_id]
        assert not any(value[i : i + 8] in r.text for i in range(len(value) - 7)), r.text
        if r.doc_id in (4, 5):  # cut at the marks of either alphabet, so that a name may go with its value
            assert r.text.startswith("é before ") and r.text.endswith(f"{secrets.MASK} after"), r.text
        else:
            assert r.text == f"é before {name}{secrets.MASK} after", r.text


def test_plain_names_and_values_stay():
    plain = "the_long_setting_name_2024=some-other/path_of_words2/and_more/plain_names3 utm_source=newsletter-for-autumn-2024"
    raw = secrets.np.frombuffer(plain.encode(), "uint8")
    assert secrets.find(raw, secrets.np.array([0, len(raw)])) == [[]]
