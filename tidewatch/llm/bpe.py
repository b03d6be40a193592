"""Operator 12: byte-level BPE encoding and decoding, by speculation and verification.

A pass cuts its texts into words (letters, numbers, signs, white space, English endings) by the classes of their code points and keeps
each distinct word once. For all of these at once, a walk down a trie proposes the longest token at each byte, from which a greedy
sequence follows. A sequence of tokens is what merging gives if and only if no merge crosses a border between two neighbours,
which depends on the two tokens alone: at each border the pieces that touch it are traced back in time, newest first, and a
merge of two of them that would have come before either was merged away refutes the proposal. The check runs over
all distinct pairs of a pass in numpy. Words with a refuted pair are merged exactly, lowest rank first, leftmost of equals.

The tokenizer file's bytes are read on the driver, go to the tasks in a broadcast of a checked size, and are made into tables once a process.
Files with settings that this does not model (normalizers, dropout, other splitters) are refused.

Defined cases: null text is empty text, which has no tokens; the strings of added tokens in a text are those tokens; broken UTF-8
counts as replacement characters, as in a string; a text is encoded by itself, so repeated rows and ids change nothing; a text over
4 MB is worked on in pieces that end before a space, where words end; decoding leaves out unknown ids and puts replacement characters
for broken bytes; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PASS_BYTES, arrow_schema, as_batch, passes, row_sig
from .words import gathered

#: Text bytes of a pass: the larger, the fewer words are worked on twice.
PASS = 4 * PASS_BYTES
#: Bytes of a tokenizer file, at most; it is sent to all workers.
MOST_FILE = 64 << 20
#: Bytes of a word that is merged together with others; in longer ones, which need more rounds, merges wait in a heap.
SHORT = 64
_NEVER = np.int64(1) << 40
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    first = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    kinds = np.frombuffer(first.encode(), np.uint8)
    out = np.full(len(kinds), _OTHER, np.uint8)
    out[kinds == ord("L")], out[kinds == ord("N")], out[kinds == ord("Z")] = _LETTER, _NUMBER, _SPACE
    out[[*range(9, 14), 0x85]] = _SPACE
    return out


def word_starts(cp: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where words start in code points: a run of one class with one space before it, or white space but its last; cut marks the segments' starts."""
    n = len(cp)
    kind = char_classes()[cp]
    fresh = cut[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    led = np.zeros(n, bool)  # a blank stands before it, in its segment
    led[1:] = (cp[:-1] == 32) & ~cut[1:n]
    starts = fresh & (space | ~led)
    ends = fresh.copy()  # the first character after white space
    ends[1:] &= space[:-1]
    after = np.flatnonzero(ends & ~cut[:n] & ~space)
    after = after[after > 0]
    starts[after - 1] = True
    # Endings: an apostrophe that is the first of its run and no part of a word with a blank before it.
    at = np.flatnonzero((cp == 39) & fresh & ~led)
    at = at[at + 1 < n]
    one, two = cp[at + 1], np.zeros(len(at), cp.dtype)
    far = at + 2 < n
    two[far] = np.where(cut[at[far] + 2], 0, cp[at[far] + 2])
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    ok = (single | double) & ~cut[at + 1]
    at, length = at[ok], np.where(single, 1, 2)[ok]
    starts[at + 1] = False
    behind = at + 1 + length
    starts[behind[behind < n]] = True
    return np.flatnonzero(starts)


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file."""

    def __init__(self, raw: bytes):
        whole = json.loads(raw)
        model = whole["model"]
        splitter, decoder = whole.get("pre_tokenizer") or {}, whole.get("decoder") or {}
        unused = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
        plain = splitter.get("type") == decoder.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        if model.get("type", "BPE") != "BPE" or any(unused) or not plain or whole.get("normalizer") or whole.get("post_processor"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        added = whole.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        own = model["vocab"]
        self.size = max([*own.values(), *(t["id"] for t in added)]) + 1
        strings = [b""] * self.size
        self.known = np.zeros(self.size, bool)
        for text, i in own.items():
            strings[i] = bytes(byte_of[c] for c in text)
            self.known[i] = True
        self.added = {t["content"].encode(): t["id"] for t in added}
        for content, i in self.added.items():
            strings[i], self.known[i] = content, True
        self.off = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=self.off[1:])
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        of = {strings[i]: i for i in own.values()}
        self.byte_id = np.array([of[bytes([b])] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([own[t] for t in side], np.int64) for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.of_pair = {(a << 32) | b: (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        key = left * self.size + right
        order = np.argsort(key)
        self._pairs, self._ranks = key[order], order
        # A token's last merge; a token of one byte has none.
        self.birth, self.left, self.right = (np.full(self.size, -1, np.int64) for _ in range(3))
        self.birth[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        self._made = made
        self.sound = self._sound(left, right, made)
        self._trie(strings)

    def _sound(self, left, right, made) -> np.ndarray:
        """Tokens that the merging of their own bytes gives, so that a proposal may use them."""
        sound = np.zeros(self.size, bool)
        sound[self.byte_id] = True
        rank = np.arange(len(made))
        self.ordered = bool(len(np.unique(made)) == len(made) and (self.birth[left] < rank).all() and (self.birth[right] < rank).all())
        if self.ordered:
            whole = ~self.crossed(left, right, rank)
            good = sound.tolist()
            for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), whole.tolist(), strict=True):
                good[m] = ok and good[a] and good[b]
            sound = np.array(good)
        return sound

    def _trie(self, strings) -> None:
        child, ids = {}, [-1]
        for i in np.flatnonzero(self.sound).tolist():
            node = 0
            for b in strings[i]:
                step = node << 8 | b
                node = child.get(step, 0)
                if not node:
                    node = child[step] = len(ids)
                    ids.append(-1)
            ids[node] = i
        order = np.argsort(np.fromiter(child.keys(), np.int64, len(child)))
        self._steps = np.fromiter(child.keys(), np.int64, len(child))[order]
        self._nodes = np.fromiter(child.values(), np.int64, len(child))[order]
        self._ids = np.array(ids, np.int64)
        self._two = np.zeros(1 << 16, np.int64)  # the nodes of two bytes
        for step, node in child.items():
            if step < 256:
                for b in range(256):
                    self._two[step << 8 | b] = child.get(node << 8 | b, 0)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of merging x with y; a number above all ranks if they don't merge."""
        key = x * self.size + y
        at = np.searchsorted(self._pairs, key)
        at[at == len(self._pairs)] = 0
        return np.where(self._pairs[at] == key, self._ranks[at], _NEVER) if len(self._pairs) else np.full(len(key), _NEVER)

    def crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Which neighbours a, b are not what merging gives for their bytes: some merge (before a rank) crosses the border between them.

        x and y are the pieces at the border, at the end a and b themselves. Going back in time, the one that was made last
        falls apart; before its making its own part at the border was there. x and y, while both are there, merge if their rank comes before
        the merge that takes x into its whole, and not after the one that takes y (of equal merges the left one goes first).
        """
        x, y = a.copy(), b.copy()
        x_goes = np.full(len(a), _NEVER) if before is None else before.astype(np.int64)
        y_goes = x_goes.copy()
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            r = self.rank(x[live], y[live])
            hit = (r < _NEVER) & (r < x_goes[live]) & (r <= y_goes[live])
            out[live[hit]] = True
            live = live[~hit]
            x_made, y_made = self.birth[x[live]], self.birth[y[live]]
            some = (x_made >= 0) | (y_made >= 0)
            live, x_made, y_made = live[some], x_made[some], y_made[some]
            newer = x_made > y_made
            on_x, on_y = live[newer], live[~newer]
            x_goes[on_x], x[on_x] = x_made[newer], self.right[x[on_x]]
            y_goes[on_y], y[on_y] = y_made[~newer], self.left[y[on_y]]
        return out

    def longest(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest sound token from each byte on, not beyond stop, and its length."""
        token, length = self.byte_id[data], np.ones(len(data), np.int64)
        live = np.flatnonzero(np.arange(1, len(data) + 1) < stop)
        node, depth = self._two[data[live].astype(np.int64) << 8 | data[live + 1]], 2
        live, node = live[node > 0], node[node > 0]
        while len(live):
            found = self._ids[node]
            is_token = found >= 0
            token[live[is_token]], length[live[is_token]] = found[is_token], depth
            more = live + depth < stop[live]
            live, node = live[more], node[more]
            step = node << 8 | data[live + depth]
            at = np.searchsorted(self._steps, step)
            at[at == len(self._steps)] = 0
            on = self._steps[at] == step
            live, node, depth = live[on], self._nodes[at[on]], depth + 1
        return token, length

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: of all pairs the one of lowest rank, leftmost of equals, until none is left."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []

        def offer(i):
            j = after[i]
            if j < n:
                found = self.of_pair.get((ids[i] << 32) | ids[j])
                if found:
                    heapq.heappush(waiting, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, a, b, made = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of them is gone
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
                offer(i)
            if prior[i] >= 0:
                offer(prior[i])
        return [x for x in ids if x >= 0]

    def merge_all(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each round the pairs of each word's lowest rank. Tokens by word, and the word of each.

        A merge makes pairs of higher ranks only, so that equal pairs of a word may go in one round; of overlapping ones each second stays.
        """
        ids, word = self.byte_id[data], np.repeat(np.arange(len(off) - 1), np.diff(off))
        r = np.full(len(ids), _NEVER)  # the rank of merging with the next one
        inner = np.flatnonzero(word[1:] == word[:-1])
        r[inner] = self.rank(ids[inner], ids[inner + 1])
        done = []
        while len(ids):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(r, begins), np.diff(np.append(begins, len(ids))))
            over = low == _NEVER
            if over.any():
                done.append((word[over], ids[over]))
                word, ids, r, low = word[~over], ids[~over], r[~over], low[~over]
            hit = np.flatnonzero(r == low)
            if not len(hit):
                break
            begins = np.flatnonzero(np.append(True, np.diff(hit) != 1))
            hit = hit[(np.arange(len(hit)) - np.repeat(begins, np.diff(np.append(begins, len(hit))))) % 2 == 0]
            ids[hit] = self._made[r[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            word, ids, r = word[keep], ids[keep], r[keep]
            hit = hit - np.arange(len(hit))
            touched = np.zeros(len(ids) + 1, bool)
            touched[hit] = touched[hit - 1] = True  # of a first one, the entry behind the last
            near = np.flatnonzero(touched[:-1])
            r[near] = _NEVER
            near = near[near + 1 < len(ids)]
            near = near[word[near] == word[near + 1]]
            r[near] = self.rank(ids[near], ids[near + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The tokens of distinct words, which are not empty, and their offsets; and how many words had to be merged."""
        n, sizes = len(off) - 1, np.diff(off)
        token, length = self.longest(data, np.repeat(off[1:], sizes))
        at, ends, path = off[:-1], off[1:], []
        while len(at) > 16:  # one token of each word; no token goes beyond its word
            path.append(at)
            at = at + length[at]
            more = at < ends
            at, ends = at[more], ends[more]
        for one, end in zip(at.tolist(), ends.tolist(), strict=True):  # the few longest ones
            steps, rest = length[one:end].tolist(), []
            while one < end:
                rest.append(one)
                one += steps[one - end]
            path.append(np.array(rest, np.int64))
        path = np.sort(np.concatenate(path))
        ids, word = token[path], np.searchsorted(off, path, side="right") - 1
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        bad = np.zeros(n, bool)
        bad[word[inner[self.crossed(pairs // self.size, pairs % self.size)[which]]]] = True
        failed = int(bad.sum())
        parts = []
        raw = data.tobytes()
        if self.added:
            for w in np.flatnonzero(np.isin(sizes, list({len(c) for c in self.added}))).tolist():
                special = self.added.get(raw[off[w] : off[w + 1]])
                if special is not None:
                    bad[w] = True
                    parts.append((np.array([special]), np.array([w])))
        many = np.flatnonzero(bad & (sizes <= SHORT)) if self.ordered else np.zeros(0, np.int64)
        many = np.setdiff1d(many, [p[1][0] for p in parts])
        own = np.zeros(len(many) + 1, np.int64)
        np.cumsum(sizes[many], out=own[1:])
        merged, of = self.merge_all(gathered(data, off[many], sizes[many]), own)
        left = np.setdiff1d(np.flatnonzero(bad), np.concatenate([many, *(p[1] for p in parts)]))
        parts.append((merged, many[of]))
        for w in left.tolist():
            one = np.array(self.merge(raw[off[w] : off[w + 1]]))
            parts.append((one, np.full(len(one), w)))
        kept = ~bad[word]
        ids = np.concatenate([ids[kept], *(p[0] for p in parts)])
        word = np.concatenate([word[kept], *(p[1] for p in parts)])
        ids = ids[np.argsort(word, kind="stable")]
        out = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=n), out=out[1:])
        return ids, out, failed

    def _cuts(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Where added tokens stand in the texts: their first bytes and ends, in order."""
        found = []
        if self.added:
            any_of = re.compile(b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)))
            if any_of.search(raw):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    found += [x for m in any_of.finditer(raw, a, b) for x in m.span()]
        return np.array(found, np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of several texts and the offsets between them."""
        raw = data.tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            parts = [raw[a:b].decode(errors="replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            text, off = "".join(parts), np.cumsum([0, *(len(p.encode()) for p in parts)])
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
        if not raw:
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        special = self._cuts(raw, off)
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = cut[special] = True
        starts = lead[word_starts(cp, cut[np.append(lead, len(data))])]
        if len(special):  # what starts within an added token is part of it
            inside = np.searchsorted(special, starts, side="right") % 2 == 1
            starts = starts[~inside | np.isin(starts, special[::2])]
        bounds = np.append(starts, len(data))
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        _, at, own = column.dictionary.buffers()
        count = len(column.dictionary)
        at = np.frombuffer(at, np.int64)[: count + 1]
        ids, of, _ = self.words(np.frombuffer(own, np.uint8)[: at[-1]], at)
        which = column.indices.to_numpy()
        sizes = np.diff(of)[which]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        return gathered(ids, of[which], sizes), total[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of sequences of ids, and their offsets in bytes."""
        ok = ids < self.size
        ok[ok] = self.known[ids[ok]]
        kept = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ok, out=kept[1:])
        ids = ids[ok].astype(np.int64)
        sizes = np.diff(self.off)[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        data, at = gathered(self.data, self.off[ids], sizes), total[kept[off]]
        raw = data.tobytes()
        lead = np.append((data & 0xC0) != 0x80, True)
        try:
            raw.decode()
            whole = bool(lead[at].all())
        except UnicodeDecodeError:
            whole = False
        if not whole:
            parts = [raw[a:b].decode(errors="replace").encode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            data, at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        return data, at


@lru_cache(4)
def _tables(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read(MOST_FILE + 1)
    if len(raw) > MOST_FILE:
        raise ValueError(f"{path} has over {MOST_FILE} bytes")
    Vocabulary(raw)  # refuses what it does not model here, not in a task
    return df.sparkSession.sparkContext.broadcast(raw)


def pieces(data: np.ndarray, most: int = PASS):
    """(start, end) of stretches of about so many bytes, each ending before a blank that follows an ASCII letter or digit, or with the text."""
    a = 0
    while len(data) - a > most:
        b = a + most
        found = np.zeros(0, np.int64)
        while b < len(data) and not len(found):
            part = data[b - 1 : b + most]
            before = part[:-1]
            plain = (before >= 48) & (before <= 57) | (before >= 65) & (before <= 90) | (before >= 97) & (before <= 122)
            found = np.flatnonzero(plain & (part[1:] == 32))
            b += int(found[0]) if len(found) else most
        if b >= len(data):
            break
        yield a, b
        a = b
    yield a, len(data)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Every row's doc_id, sig, number of tokens, and ids as little-endian unsigned 32-bit integers (numpy: np.frombuffer(ids, "<u4"))."""
    shared = _shared(docs, path)
    schema = "doc_id long, sig long, n_tokens long, ids binary"
    arrow = arrow_schema(schema)

    def run(batches):
        vocabulary = _tables(shared.value)
        for batch in batches:
            for i, j, data, off in passes(batch.column(1), PASS):
                if j - i > 1:
                    ids, at = vocabulary.encode(data, off)
                else:
                    parts = [vocabulary.encode(data[a:b], np.array([0, b - a]))[0].astype("<u4") for a, b in pieces(data)]
                    ids = np.concatenate(parts)
                    at = np.array([0, len(ids)])
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(4 * at), pa.py_buffer(ids.astype("<u4"))])
                rows = batch.slice(i, j - i)
                yield as_batch([rows.column(0), rows.column(2), np.diff(at), packed], arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_sig().alias("sig")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encoded, ids replaced by the text that they stand for; null ids are an empty text."""
    shared = _shared(encoded, path)
    names = [c for c in encoded.columns if c != "ids"]
    rows = encoded.select(*names, F.coalesce("ids", F.expr("X''")).alias("ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"), "decoded string"])
    arrow = arrow_schema(schema)

    def run(batches):
        vocabulary = _tables(shared.value)
        for batch in batches:
            for i, j, data, off in passes(batch.column(len(names))):
                text, at = vocabulary.decode(np.frombuffer(data.tobytes(), "<u4"), off // 4)
                column = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text.tobytes())])
                part = batch.slice(i, j - i)
                yield as_batch([*part.columns[:-1], column], arrow)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Every row's doc_id, sig and number of tokens, the SHA-256 of its packed ids, and the text that they decode to."""
    found = encode(docs, path).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(found, path)
