"""Byte-level BPE from a rank file, encoded by replaying the merges over many words at once, and decoded.

The distinct pre-tokens of a block of texts are laid out as one array of bytes. An inverted index maps each mergeable
pair, named by the rank of what it makes, to the positions where it stands; a heap hands out the ranks in order. A rank's
positions are merged together in NumPy, and only the pairs with their neighbours to the left and right are looked up again
and filed. Of overlapping positions every second one is merged, from the left. A new pair may have a better rank than
the one being replayed (the whole was learnt before its part); for ranks where that can happen, one position a word is
merged at a time and the others wait, so that the better pair goes first; a word in which many wait is merged alone, with a heap.
A pre-token that is a token takes its id without merging, as the rank files' library has it.

Null and empty texts encode to nothing, an empty table to an empty one, repeated rows alike; columns named like a result
are replaced, others pass through. Whole texts are encoded; there are no special tokens. A Python worker keeps
the ids of at most ``KEEP`` pre-tokens, a memory bound that changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_or_empty

#: Pre-tokens whose ids a Python worker keeps, and characters of the texts replayed together.
KEEP, TOGETHER = 250_000, 2_000_000
#: Waiting positions of a word from which it is merged alone.
ALONE = 16
#: Characters up to this one are spelt out in the pattern; others are classed one by one.
SPELT = 0x24F
NEVER = np.int32(2**31 - 1)


class Splitter:
    """The matches of a pattern of the classes ``\\p{L}``, ``\\p{N}``, ``\\s`` and their complements.

    Characters beyond ``SPELT`` are replaced, one for one, by a plain character of the same class before matching, so
    that the matcher of the standard library serves every script. Characters younger than Python's tables are classed by the library.
    """

    def __init__(self, pattern: str):
        import regex

        shown = [chr(i) for i in range(SPELT + 1)]
        letter, number, space = ("".join(re.escape(c) for c in shown if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
        spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
        self.pattern = re.compile(spelt.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        self.whole, self.space = pattern, regex.compile(r"\s")
        self.rare = re.compile(f"[^\x00-{chr(SPELT)}]")
        splitter = self

        class Plain(dict):
            def __missing__(self, code: int) -> str:
                self[code] = splitter.plain(chr(code)) if code > SPELT else chr(code)
                return self[code]

        self.stand_in = Plain()

    def plain(self, c: str) -> str:
        """A letter, digit, space (not the common one, which the pattern names) or mark of the class of ``c``."""
        kind = unicodedata.category(c)
        if kind == "Cn":
            return self.probe(c)
        return "\xa0" if self.space.match(c) else {"L": "é", "N": "5"}.get(kind[0], "!")

    def probe(self, c: str) -> str:
        """The class of a character by the library's own tables: with which neighbour is it one match?"""
        import tiktoken

        one = {p: (p + c).encode() for p in ("é", "5", "!")}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(one.values())}
        coder = tiktoken.Encoding("probe", pat_str=self.whole, mergeable_ranks=ranks, special_tokens={})
        return next((p for p, t in one.items() if len(coder.encode_ordinary(t.decode())) == 1), "\xa0")

    def split(self, text: str) -> list[str]:
        if not self.rare.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]


class MergeReplay:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.split = Splitter(pattern).split
        self.size = max(self.ids.values()) + 1
        self.bytes_of = [b""] * self.size
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the rank file lacks a byte")
        pairs = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        left, right, made = np.array(pairs, np.int64).T if pairs else np.zeros((3, 0), np.int64)
        order = np.argsort(left * self.size + right)
        self.keys, self.made = np.append((left * self.size + right)[order], np.int64(2**62)), np.append(made[order].astype(np.int32), NEVER)
        # tokens that stand in a pair of better rank than their own
        self.early = np.zeros(self.size, bool)
        self.early[left[made < left]] = True
        self.early[right[made < right]] = True
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.done: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id and rank of what each pair makes, NEVER if nothing."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NEVER)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian, by one replay over all of them."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1], before[ends - sizes] = -1, -1
        now = np.full(n, NEVER, np.int32)  # rank of the pair that starts here
        inner = np.flatnonzero(after >= 0)
        now[inner] = self.rank(ids[inner], ids[inner + 1])
        alive = np.ones(n, bool)
        alone: dict[int, list[int]] = {}
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def file(places: np.ndarray) -> None:
            """Add positions to the index under their pairs."""
            r = now[places]
            places, r = places[r < NEVER], r[r < NEVER]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            places, r = places[order], r[order]
            starts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for key, a, b in zip(r[starts[:-1]].tolist(), starts, starts[1:]):  # noqa: B905  starts is one longer
                if key not in index:
                    index[key] = []
                    heapq.heappush(ranks, key)
                index[key].append(places[a:b])

        file(inner)
        while ranks:
            r = heapq.heappop(ranks)
            parts = index.pop(r)
            p = np.concatenate(parts)
            p = p[now[p] == r]
            if len(parts) > 1:
                p.sort()
                p = p[np.concatenate(([True], p[1:] != p[:-1]))] if len(p) else p
            if len(p) > 1:
                chained = np.concatenate(([False], after[p[:-1]] == p[1:]))
                if chained.any():  # overlapping: every second of a run
                    at = np.arange(len(p))
                    start = np.maximum.accumulate(np.where(chained, 0, at))
                    later = p[(at - start) % 2 == 1]
                    p = p[(at - start) % 2 == 0]
                else:
                    later = p[:0]
                if self.early[r] and len(p) + len(later) > 1:
                    both = np.sort(np.concatenate((p, later)))
                    _, first, many = np.unique(word[both], return_index=True, return_counts=True)
                    for w in word[both[first[many > ALONE]]].tolist():
                        alone[w] = self.merge_alone(words[w])
                        now[ends[w] - sizes[w] : ends[w]] = NEVER
                    p = both[first[many <= ALONE]]
                    waiting = np.setdiff1d(both, both[first])
                    waiting = waiting[now[waiting] == r]
                else:
                    waiting = later[:0]
            else:
                waiting = p[:0]
            if len(p):
                gone = after[p]
                ids[p], alive[gone], now[gone] = r, False, NEVER
                next_ = after[gone]
                after[p] = next_
                has = next_ >= 0
                before[next_[has]] = p[has]
                now[p] = NEVER
                left = before[p]
                near = np.concatenate((p[has], left[left >= 0]))  # a pair filed twice is met once
                now[near] = self.rank(ids[near], ids[after[near]])
                file(near)
            if len(waiting):
                file(waiting)
        kept = np.flatnonzero(alive)
        flat, owner = ids[kept].astype("<u4").tobytes(), word[kept]
        cut = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        return [np.array(alone[w], "<u4").tobytes() if w in alone else flat[cut[w] : cut[w + 1]] for w in range(len(words))]

    def merge_alone(self, word: bytes) -> list[int]:
        """One word, best rank first, leftmost first, by a heap over a linked list."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        texts = [word[i : i + 1] for i in range(len(word))]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (made := self.ids.get(texts[i] + texts[j])) is not None:
                heapq.heappush(heap, (made, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], texts[i], alive[j], after[i] = made, texts[i] + texts[j], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.done) > KEEP:
            self.done.clear()
        raw, todo = [], []
        for w in {w for parts in split for w in parts} - self.done.keys():
            b = w.encode("utf-8", "surrogatepass")
            if b in self.ids:
                self.done[w] = np.array([self.ids[b]], "<u4").tobytes()
            else:
                todo.append(w)
                raw.append(b)
        if todo:
            self.done.update(zip(todo, self.replay(raw), strict=True))
        get = self.done.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], MergeReplay] = {}


def codec(path: str, pattern: str) -> MergeReplay:
    """The codec of a rank file, built once in a Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = MergeReplay(path, pattern)
    return _loaded[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``: the ids of each whole text under the rank file ``path``, as array<int>.

    ``pattern`` splits the text; matches are encoded separately. The file must exist on every executor.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batch: pd.Series) -> pd.Series:
        found = (x for _, part in chunks(batch.tolist(), TOGETHER) for x in codec(path, pattern).encode(part))
        return pd.Series([np.frombuffer(x, "<i4") for x in found], dtype=object)

    return df.withColumn(out, ids(text_or_empty(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes of each id array (any ids of the file, not only those of whole characters); null gives null."""
    small_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def raw(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codec(path, pattern).decode(np.asarray(x, "<u4").tobytes()) for x in batch], dtype=object)

    return df.withColumn(out, raw(F.col(ids)))


def round_trip_digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 (of the ids, and of the bytes decoded from them), in one pass."""
    small_batches(df.sparkSession)

    def digests(texts: list[str]) -> Iterator[tuple[int, str, str]]:
        own = codec(path, pattern)
        for _, part in chunks(texts, TOGETHER):
            for x in own.encode(part):
                yield len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(own.decode(x)).hexdigest()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(digests(batch.tolist())), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    got = df.withColumn("__sd_digests", run(text_or_empty(text)))
    return got.withColumns({c: F.col(f"__sd_digests.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("__sd_digests")
