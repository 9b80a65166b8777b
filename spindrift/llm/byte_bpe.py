"""Byte-level BPE, encoded by speculation and verification, and decoded.

Speculate: greedy longest match proposes tokens for every distinct pre-token. Verify: a sequence of
tokens is the BPE encoding exactly if each token encodes to itself and no merge crosses the border of
any adjacent pair; the distinct pairs are tested together in NumPy by walking both tokens' edges back
through their merges. Repair: only pre-tokens with an incompatible pair are merged exactly.

Null and empty texts encode to nothing, an empty table to an empty one, repeated rows alike; columns named like a
result are replaced, others pass through. Texts are never shortened; special strings inside a text become
their ids, as the library does by default. Results of pre-tokens are kept per Python worker within
``KEEP`` entries (a memory bound, not a limit of the method).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_or_empty

#: Fixed value: the pre-token pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a Python worker keeps, and characters of the texts encoded together.
KEEP, TOGETHER = 120_000, 250_000
NEVER = np.int64(1) << 40
#: Bytes up to which pre-tokens are merged side by side in a NumPy grid; longer ones use a heap.
WIDEST = 48
#: Pre-tokens merged side by side at a time, which bounds the grid's memory.
GRID = 4_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule: bytes
    that print stand for themselves, the others take the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SpeculativeBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.path = path
        self.pre = Tokenizer.from_file(path).pre_tokenizer  # it alone is kept; it serves scripts whose classes vary by Unicode version
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level BPE files are supported")
        back = byte_chars()
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([self.ids[raw(m[k])] for m in pairs], np.int64) for k in (0, 1))
        made = np.array([self.ids[raw(a + b)] for a, b in pairs], np.int64)
        ranks = np.arange(len(pairs), dtype=np.int64)
        order = np.argsort(left * size + right, kind="stable")
        self.size, self.pair_keys, self.pair_ranks, self.pair_made = size, (left * size + right)[order], ranks[order], made[order]
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.merge = dict(zip((left * size + right).tolist(), (ranks * size + made).tolist(), strict=True))  # of one long each, not of tuples
        # how each token is made: its parts and its rank, -1 for bytes
        self.rank = np.full(size, -1, np.int64)
        self.part = np.full((2, size), -1, np.int64)
        for a, b, k, c in zip(left[::-1], right[::-1], ranks[::-1], made[::-1], strict=True):
            self.rank[c], self.part[0, c], self.part[1, c] = k, a, b
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # the same pattern with its classes spelt out up to U+024F, for the standard library's faster matcher
        shown = [chr(i) for i in range(0x250)]
        letter, number, space = ("".join(re.escape(c) for c in shown if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
        spelt = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
        self.pattern = re.compile(spelt.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        self.rare = re.compile("[^\x00-\x1b\x20-\u024f]")
        del spec, pairs  # the parsed file is large, and building the automaton needs the room
        self.greedy = ahocorasick.Automaton()
        tokens = list(self.ids)
        short = [t for t in tokens if len(t) <= WIDEST]
        own = dict(zip(short, map(len, self.exact_many(short)), strict=True))
        del short
        for t in tokens:
            if (own[t] if t in own else len(self.exact_long(t))) == 1:  # a token that splits is never proposed
                self.greedy.add_word(t.decode("latin-1"), self.ids[t])
        self.greedy.make_automaton()
        self.done: dict[str, bytes] = {}

    @property
    def library(self):
        """The library's tokenizer of the same file, to compare with; loaded anew at each use, as no worker needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def exact(self, word: bytes) -> list[int]:
        """Merge by merge, best rank first, leftmost first."""
        return self.exact_long(word) if len(word) > WIDEST else self.exact_many([word])[0].tolist()

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair (NEVER if there is none) and what it makes."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NEVER), np.where(hit, self.pair_made[at], -1)

    def exact_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of short words side by side: each round makes the best merge of every word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        todo = np.argsort([len(w) for w in words], kind="stable")
        for block in np.array_split(todo, max(1, len(todo) // GRID)):
            if not len(block):
                continue
            width = max(1, *(len(words[i]) for i in block[-1:]))
            sizes = np.array([len(words[i]) for i in block])
            grid = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in block), np.uint8).reshape(len(block), width)
            ids = self.byte_ids[grid]
            cols = np.arange(width)
            ids[cols >= sizes[:, None]] = -1
            ids = np.hstack([ids, np.full((len(ids), 1), -1)])
            rank, made = self.ranks_of(ids[:, :-1], ids[:, 1:])
            dead = (ids[:, :-1] < 0) | (ids[:, 1:] < 0)
            rank[dead] = NEVER
            live = np.arange(len(ids))
            while len(live):
                j = rank[live].argmin(1)
                go = rank[live, j] < NEVER
                live, j = live[go], j[go]
                if not len(live):
                    break
                ids[live, j] = made[live, j]
                shift = np.minimum(cols + (cols > j[:, None]), width - 1)
                tail = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > j[:, None]), width)
                ids[live] = np.take_along_axis(ids[live], tail, 1)
                rank[live], made[live] = (np.take_along_axis(x[live], shift, 1) for x in (rank, made))
                rank[live, width - 1] = NEVER
                for k in (j - 1, j):
                    inside = (k >= 0) & (k < width)
                    w, k = live[inside], k[inside]
                    r, m = self.ranks_of(ids[w, k], ids[w, k + 1])
                    r[(ids[w, k] < 0) | (ids[w, k + 1] < 0)] = NEVER
                    rank[w, k], made[w, k] = r, m
            for i, row in zip(block.tolist(), ids, strict=True):
                out[i] = row[row >= 0]
        return out

    def exact_long(self, word: bytes) -> list[int]:
        """The same with a heap and a linked list: n log n for very long pre-tokens."""
        import heapq

        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(heap, (m // self.size, i, ids[i], ids[j], m % self.size))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = to, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether no merge crosses the border between them.

        Both tokens are taken apart in the reverse order of their merges; at each moment the two parts
        at the border stood side by side until the next merge of either, and must not have merged before.
        """
        a, b, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        a_until, b_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank, _ = self.ranks_of(x, y)
            crossed = (rank < a_until[live]) & (rank <= b_until[live]) & (rank < NEVER)
            ok[live[crossed]] = False
            undo_a = self.rank[x] > self.rank[y]
            undo_a |= (self.rank[x] == self.rank[y]) & (self.rank[x] >= 0)
            undo_b = ~undo_a & (self.rank[y] >= 0)
            go = live[undo_a]
            a_until[go], a[go] = self.rank[a[go]], self.part[1, a[go]]
            go = live[undo_b]
            b_until[go], b[go] = self.rank[b[go]], self.part[0, b[go]]
            live = live[~crossed & (undo_a | undo_b)]
        return ok

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: tokens, and the word that each belongs to."""
        found = np.array(list(self.greedy.iter_long("\u0100".join([w.decode("latin-1") for w in words]))), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(w) + 1 for w in words])
        return found[:, 1], np.searchsorted(ends, found[:, 0], "right")

    def encode_words(self, new: list[str]) -> None:
        """Ids of distinct pre-tokens, into ``done``."""
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        flat, owner = self.propose(raw)
        inner = owner[1:] == owner[:-1]
        pairs = (flat[:-1] * self.size + flat[1:])[inner]
        distinct, which = np.unique(pairs, return_inverse=True)
        fit = self.compatible(distinct // self.size, distinct % self.size)
        failing = np.unique(owner[:-1][inner][~fit[which]])
        ids = flat.astype("<u4").tobytes()
        ends = (4 * np.searchsorted(owner, np.arange(len(new)), "right")).tolist()
        at = 0
        for w, end in zip(new, ends, strict=True):
            self.done[w] = ids[at:end]
            at = end
        short = [i for i in failing.tolist() if len(raw[i]) <= WIDEST]
        for i, exact in zip(short, self.exact_many([raw[i] for i in short]), strict=True):
            self.done[new[i]] = exact.astype("<u4").tobytes()
        for i in failing.tolist():
            if len(raw[i]) > WIDEST:
                self.done[new[i]] = np.array(self.exact_long(raw[i]), "<u4").tobytes()

    def pretokens(self, text: str) -> list[str]:
        if not self.rare.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts, at = [], 0
            for m in self.find_special.finditer(text) if self.special else ():
                parts += [*self.pretokens(text[at : m.start()]), (self.special[m[0]],)]
                at = m.end()
            split.append(parts + self.pretokens(text[at:]) if at else self.pretokens(text))
        if len(self.done) > KEEP:
            self.done.clear()
        new = {w for parts in split for w in parts} - self.done.keys()
        for w in [w for w in new if isinstance(w, tuple)]:
            self.done[w] = np.array(w, "<u4").tobytes()
            new.discard(w)
        self.encode_words(list(new))
        get = self.done.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, SpeculativeBPE] = {}


def codec(path: str) -> SpeculativeBPE:
    """The codec of a tokenizer file, built once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBPE(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``: the ids of each whole text under the tokenizer file ``path``, as array<int>.

    The file must exist on every executor. Null and empty texts give an empty array.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batch: pd.Series) -> pd.Series:
        found = (x for _, part in chunks(batch.tolist(), TOGETHER) for x in codec(path).encode(part))
        return pd.Series([np.frombuffer(x, "<i4") for x in found], dtype=object)

    return df.withColumn(out, ids(text_or_empty(text)))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of each id array; special tokens are kept, null gives null."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def texts(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codec(path).decode(np.asarray(x, "<u4").tobytes()) for x in batch], dtype=object)

    return df.withColumn(out, texts(F.col(ids)))


def round_trip_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 (of the ids, and of the text decoded from them), in one pass."""
    small_batches(df.sparkSession)

    def digests(texts: list[str]) -> Iterator[tuple[int, str, str]]:
        for _, part in chunks(texts, TOGETHER):
            for x in codec(path).encode(part):
                back = codec(path).decode(x).encode("utf-8")
                yield len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(back).hexdigest()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(digests(batch.tolist())), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    got = df.withColumn("__sd_digests", run(text_or_empty(text)))
    return got.withColumns({c: F.col(f"__sd_digests.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("__sd_digests")
