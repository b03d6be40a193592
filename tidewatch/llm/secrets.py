"""Operator 4: secret scans by a battery of randomness tests.

Three fixed patterns give the base spans. Beside them, every long token (a run of token bytes, cut where an equals
sign stands inside or where no one encoding has all of it) is put to a battery: its encoding is inferred from its
characters; a chi-squared test of alphabet uniformity, a runs test and a serial-correlation test ask how well it fits random
draws from that alphabet, and a normal test asks whether natural text would be as even.

False discoveries are controlled over all tokens of the table, by length: the three tests' combined p-values go through a weighted step-up
procedure that rejects randomness where it is untenable, and among the tokens that are left another one rejects natural text; these
are the random spans. Weights are in proportion to length, as short tokens carry little evidence, with mean one. The
procedures need only counts of tokens by length and p-value, which are gathered in a pass before.

Defined cases: null is empty and has no spans; spans count code points from the text's start, end
exclusive; base spans depend on the row alone, random ones on the table's tokens too, so that repeated rows have equal spans; very long texts are
scanned whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, as_batch, mapped, passes, row_sig
from .words import LOWER

KINDS = ("assign", "access", "hex", "random")
#: The base patterns, in lower case where letters match in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Bytes of tokens that the battery takes, and the fewest in a row.
TOKEN_LEAST = 20
#: Expected share of false discoveries among the random tokens, and among those that are said not to be random draws.
FDR, FIT = 1e-4, 1e-3
#: Steps of a p-value's negative decimal logarithm in one decade, and decades that are told apart.
STEPS, DECADES = 8, 40

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_TOKEN[[ord(c) for c in "+/_=-"]] = True
#: Encodings in the order of inference, and their alphabets.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "base64url": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
}
#: Letter frequencies of English text, in per cent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)

#: The share of vowels among letters of text in per cent, of letters in the case of the one before, and of kinds after kinds.
VOWELS, KEPT_CASE = 38.2, 0.93
CHAIN = {
    "start": {"vowel": 0.35, "consonant": 0.55, "digit": 0.08, "sign": 0.02},
    "vowel": {"vowel": 0.10, "consonant": 0.72, "digit": 0.06, "sign": 0.12},
    "consonant": {"vowel": 0.50, "consonant": 0.33, "digit": 0.05, "sign": 0.12},
    "digit": {"vowel": 0.06, "consonant": 0.12, "digit": 0.70, "sign": 0.12},
    "sign": {"vowel": 0.28, "consonant": 0.52, "digit": 0.18, "sign": 0.02},
}


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer(token: str) -> str | None:
    """The first encoding whose alphabet has all characters of a token; digits must be among them, as words have none."""
    chars = set(token)
    if not chars & set("0123456789") or not any(c.isalpha() for c in chars):
        return None
    return next((k for k, a in ENCODINGS.items() if chars <= set(a)), None)


def _kind(c: str) -> str:
    return "vowel" if c in "aeiouAEIOU" else "consonant" if c.isalpha() else "digit" if c.isdigit() else "sign"


def evidence(token: str, k: int) -> float:
    """The log-likelihood of uniform draws from k characters over that of natural text and names.

    Text is a chain of kinds of characters: vowels and consonants take turns, digits keep together, case is kept; within
    their kind, letters come by their frequency.
    """
    total, kind, upper = 0.0, "start", None
    one_case = k in (16, 32, 36)
    for c in token:
        new = _kind(c)
        share = CHAIN[kind][new]
        if c.isalpha():
            share *= LETTERS[ord(c.lower()) - 97] / (VOWELS if new == "vowel" else 100 - VOWELS)
            if not one_case:
                share *= (0.2 if c.isupper() else 0.8) if upper is None else KEPT_CASE if c.isupper() == upper else 1 - KEPT_CASE
            upper = c.isupper()
        else:
            share /= 10 if new == "digit" else 2
        total -= math.log(share * k)
        kind = new
    return total


def battery(token: str) -> dict[str, float] | None:
    """The p-values of a token: even (chi-squared), runs, serial under randomness, and natural under letter frequencies of text."""
    token = token.rstrip("=")
    kind = infer(token)
    if kind is None or len(token) < TOKEN_LEAST:
        return None
    alphabet = ENCODINGS[kind]
    n, k = len(token), len(alphabet)
    at = [alphabet.index(c) for c in token]
    counts = Counter(at)
    chi = sum((counts.get(i, 0) - n / k) ** 2 for i in range(k)) * k / n
    df = k - 1
    cube = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    even = _upper_tail(cube)
    high = [2 * a >= k for a in at]
    ones = sum(high)
    mean = 1 + 2 * ones * (n - ones) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    run_p = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    centre = sum(at) / n
    spread = sum((a - centre) ** 2 for a in at)
    corr = sum((a - centre) * (b - centre) for a, b in zip(at, at[1:], strict=False)) / spread if spread else 1.0
    serial = _two_sided((corr + 1 / n) * math.sqrt(n))
    natural = min(1.0, math.exp(-max(0.0, evidence(token, k))))  # under text, the likelihood ratio has mean 1 at most: Markov's bound
    return {"even": even, "runs": run_p, "serial": serial, "natural": natural}


def combined(p: dict[str, float]) -> float:
    """One p-value of the three tests of randomness, by the Cauchy combination, which holds for dependent tests."""
    mean = sum(math.tan((0.5 - min(max(x, 1e-15), 1 - 1e-15)) * math.pi) for x in (p["even"], p["runs"], p["serial"])) / 3
    return 0.5 - math.atan(mean) / math.pi if mean < 1e6 else 1 / (math.pi * mean)


def step_of(p: float) -> int:
    """The step of a p-value: it stands for the largest p-value in it, so rounding only makes control stricter."""
    return min(STEPS * DECADES, int(-math.log10(max(p, 1e-300)) * STEPS))


def traits(token: str) -> tuple[int, int, int] | None:
    """Of a token that the battery takes: length class (a power of two), and steps of the combined and the natural p-value."""
    p = battery(token)
    return None if p is None else (len(token).bit_length() - 1, step_of(combined(p)), step_of(p["natural"]))


def step_up(counts: Counter, share: float) -> dict[int, int]:
    """The first rejected step by length class, of counts by (length class, step), in a weighted step-up procedure at a share."""
    m = sum(counts.values())
    if not m:
        return {}
    mean = sum(n * (1 << c) for (c, _), n in counts.items()) / m
    classes = sorted({c for c, _ in counts})
    q = sorted((10 ** (-k / STEPS) * mean / (1 << c), n) for (c, k), n in counts.items())
    limit, seen = 0.0, 0
    for i, (x, n) in enumerate(q):
        seen += n
        if (i + 1 == len(q) or q[i + 1][0] > x) and x <= share * seen / m:
            limit = x
    if not limit:
        return {c: STEPS * DECADES + 1 for c in classes}
    return {c: next((k for k in range(STEPS * DECADES + 1) if 10 ** (-k / STEPS) * mean / (1 << c) <= limit), STEPS * DECADES + 1) for c in classes}


class Control:
    """Which tokens are random, by counts of traits() over a family of tokens."""

    def __init__(self, counts: Counter):
        fits: Counter = Counter()
        for (c, fit, _), n in counts.items():
            fits[c, fit] += n
        self.unfit = step_up(fits, FIT)
        left: Counter = Counter()
        for (c, fit, natural), n in counts.items():
            if fit < self.unfit[c]:
                left[c, natural] += n
        self.found = step_up(left, FDR)

    def random(self, token: str) -> bool:
        t = traits(token)
        return t is not None and t[0] in self.found and t[1] < self.unfit[t[0]] and t[2] >= self.found[t[0]]


def random_tokens(tokens: list[tuple[int, int, str]], control: Control | None = None) -> list[tuple[int, int]]:
    """Spans of the tokens (start, end, text) that are random under a control, by default that of these tokens alone."""
    control = control or Control(Counter(t for _, _, token in tokens if (t := traits(token))))
    return [(a, b) for a, b, token in tokens if control.random(token)]


def pieces(token: str) -> list[tuple[int, int]]:
    """Start and end of the parts of a run of token bytes that the battery takes.

    Values are cut from names at '='; padding stays with the last part. A part with characters of both base64
    alphabets is cut once at those of either, and all parts are tried.
    """
    out = []
    for m in re.finditer("[^=]+", token):
        a, b = m.span()
        end = len(token) if not token[b:].strip("=") else b
        if infer(token[a:b]) is None and re.search("[_-]", m[0]) and re.search("[/+]", m[0]):
            for cut in ("[^_-]+", "[^/+]+"):
                out += [(a + x.start(), end if a + x.end() == b else a + x.end()) for x in re.finditer(cut, m[0])]
        else:
            out.append((a, end))
    return [(a, b) for a, b in dict.fromkeys(out) if b - a >= TOKEN_LEAST]


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that lie in no other one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of True of a length, cut between texts."""
    n = len(mask)
    cuts = np.zeros(n + 1, bool)
    cuts[off] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | cuts[1:n]
    last[:-1] &= ~mask[1:] | cuts[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = e - s >= least
    return s[long], e[long]


def tokens_of(data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    """(start byte in data, end byte, token) of what the battery looks at, by text."""
    s, e = _runs(_TOKEN[data], off, TOKEN_LEAST)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    some = digits[e] > digits[s]
    out: dict[int, list[tuple[int, int, str]]] = {}
    for d, a, b in zip((np.searchsorted(off, s[some], side="right") - 1).tolist(), s[some].tolist(), e[some].tolist(), strict=True):
        token = data[a:b].tobytes().decode("ascii")
        out.setdefault(d, []).extend((a + i, a + j, token[i:j]) for i, j in pieces(token))
    return out


def controlled(docs: DataFrame) -> Control:
    """The control over all tokens of a table, by their counts: at most a row for each length class and pair of steps."""
    arrow = arrow_schema("size int, fit int, natural int, n long")

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for _, _, data, off in passes(batch.column(0)):
                for own in tokens_of(data, off).values():
                    total.update(t for _, _, token in own if (t := traits(token)))
        if total:
            yield as_batch([*zip(*total, strict=True), list(total.values())], arrow)

    rows = docs.select("text").mapInArrow(count, "size int, fit int, natural int, n long").groupBy("size", "fit", "natural").agg(F.sum("n").alias("n"))
    return Control(Counter({(r.size, r.fit, r.natural): r.n for r in rows.collect()}))


def find(data: np.ndarray, off: np.ndarray, control: Control | None = None) -> list[list[tuple[int, int, int]]]:
    """The spans of each text: (start byte in data, end byte, index in KINDS), ordered; control is by default that of each text's tokens."""
    docs = len(off) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(docs)]
    if not len(data):
        return out
    owner = lambda at: np.searchsorted(off, at, side="right") - 1
    raw = data.tobytes()
    signs = np.flatnonzero((data == 58) | (data == 61))
    for d in np.unique(owner(signs)).tolist():
        a, b = int(off[d]), int(off[d + 1])
        for m in ASSIGN.finditer(LOWER[data[a:b]].tobytes()):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out[d].append((a + m.start(), a + m.end(), 0))
    at = raw.find(b"AKIA")
    done = 0
    while at >= 0:
        d = int(owner(at))
        if at >= done:
            m = ACCESS.match(raw, at, int(off[d + 1]))
            if m:
                done = m.end()
                if m.end() - m.start() >= ACCESS_LEAST:
                    out[d].append((at, m.end(), 1))
        at = raw.find(b"AKIA", max(at + 1, done))
    s, e = _runs(_HEX[data], off, HEX_LEAST)
    for d, a, b in zip(owner(s).tolist(), s.tolist(), e.tolist(), strict=True):
        out[d].append((a, b, 2))
    for d, own in tokens_of(data, off).items():
        out[d].extend((a, b, 3) for a, b in outermost(random_tokens(own, control)))
    for spans in out:
        spans.sort(key=lambda x: (x[0], x[2]))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Every row's spans: (kind, start, end, value) in code points, base first by kind, with doc_id and sig."""
    control = controlled(docs)

    def kernel(batch: pa.RecordBatch):
        for i, j, data, off in passes(batch.column(1)):
            rows = batch.slice(i, j - i)
            found = find(data, off, control)
            lists = [[]] * len(found)
            if any(found):
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                lists = [
                    [{"kind": KINDS[k], "start": int(chars[a] - chars[off[d]]), "end": int(chars[b] - chars[off[d]]), "value": data[a:b].tobytes().decode()} for a, b, k in own]
                    for d, own in enumerate(found)
                ]
            yield [rows.column(0), rows.column(2), lists]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig"))
    return mapped(rows, kernel, "doc_id long, sig long, spans array<struct<kind:string,start:long,end:long,value:string>>")


def joined(spans, kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in kinds)


def digest(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the SHA-256 of the base spans, and all spans, of scan()'s rows."""
    text = lambda only: F.array_join(
        F.transform(F.filter("spans", only), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(text(lambda x: x["kind"] != "random"), 256).alias("base_sha256"), text(lambda x: F.lit(True)).alias("spans"),
    )


#: What stands in a cleaned text where a secret stood.
MASK = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret's characters replaced by MASK (overlapping spans by one) and n_chars renewed where there is one."""
    names, schema, control = docs.columns, docs.schema, controlled(docs)
    at = names.index("text")

    def clean(data: np.ndarray, off: np.ndarray, text: pa.Array) -> list[str | None]:
        out = text.to_pylist()
        for d, own in enumerate(find(data, off, control)):
            if own:
                parts, done = [], int(off[d])
                for a, b, _ in own:
                    if b <= done:
                        continue
                    if a >= done:
                        parts += [data[done:a].tobytes(), MASK.encode()]
                    done = b
                out[d] = b"".join([*parts, data[done : off[d + 1]].tobytes()]).decode()
        return out

    def run(batches):
        for batch in batches:
            texts: list[str | None] = []
            for i, j, data, off in passes(batch.column(at)):
                texts += clean(data, off, batch.column(at).slice(i, j - i))
            cols = batch.columns
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                length = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                was = batch.column(at)
                same = [a == b for a, b in zip(was.to_pylist(), texts, strict=True)]
                cols[k] = pa.compute.if_else(pa.array(same, pa.bool_()), cols[k], length.cast(cols[k].type))
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)
