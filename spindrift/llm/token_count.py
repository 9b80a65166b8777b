"""Token counts by a compiled finite-state transducer.

A sentencepiece BPE model is compiled, state by state as texts need them, into a deterministic
transducer over characters. A transition carries the change in the number of tokens of the prefix
read so far, so a text's token count is the sum along its path and no segmentation is built.

State. BPE encodings of all prefixes of a text form a tree: the encoding of a prefix ends in exactly
one piece p such that the encoding of what comes before p ends in a piece compatible with p (no merge
of the pair crosses their border). The state therefore needs the longest suffix that some piece starts
with, and for every start inside it the last piece and the relative count of the prefix up to there.

Parallel scan. A batch is cut into equal chunks, which run as lanes of one NumPy loop. A word start
(a space mark after something else) puts any state into the same state, so a chunk's state map is
constant from its first word start on; chunks run from there. What stands before it needs the state that the chunk
before it ends in. Where that is open (a chunk without a word start), the map is first evaluated at the state that a short run-up
gives; then the ends are passed on along the chunks, and the maps of all chunks whose entry has changed are evaluated anew,
together, until none changes. The entries are then exact, by induction from the first chunk; since states forget what is
further back than a piece, one or two rounds do, however long the text without a word start is.

Nulls and empty texts have no tokens, an empty table gives an empty one, repeated rows equal counts; a column named
like the result is replaced. Texts are never shortened. Characters outside the vocabulary are classed by their length in UTF-8.
The table holds the ``DENSE`` character classes met first, other transitions go to a dictionary. Both are dropped, as in
lazy automata, even in the middle of a run, when they exceed ``MAX_CELLS`` or ``MAX_FAR``; states in use are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_or_empty

MARK = "▁"
#: Cells (states times columns) of the compiled table at most, 4 bytes a cell; other transitions and compared pairs at most.
MAX_CELLS, MAX_FAR, MAX_PAIRS = 40_000_000, 300_000, 500_000
#: Character classes with a column of their own at most; the table has as many columns as the classes met, up to a power of two.
DENSE = 512
#: Characters of a lane, of its run-up, and of the texts that run together.
LANE, RUN_UP, TOGETHER = 192, 48, 3_000_000


class CountTransducer:
    """Lazily compiled token-count transducer of one sentencepiece BPE model."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize("ﬁ ｆ  x ") != f"{MARK}ﬁ{MARK}ｆ{MARK}{MARK}x{MARK}":
            raise ValueError("only identity normalisation with a leading space mark is supported")
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        byte_fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = {sp.id_to_piece(i): k for k, i in enumerate(order)}
        self.byte_fallback = byte_fallback
        self.starts = {p[:k] for p in self.rank for k in range(1, len(p))}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece joins two words; word starts would not reset the transducer")
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.clear()

    # -- merges ---------------------------------------------------------------------------------
    def split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes ``piece`` from its characters; None if its own encoding differs."""
        if piece not in self.splits:
            parts, last = list(piece), None
            while len(parts) > 1:
                best = min((self.rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if best[0] == 1 << 40:
                    break
                i = best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.splits[piece] = last if len(parts) == 1 else None
        return self.splits[piece]

    def valid(self, piece: str) -> bool:
        return piece in self.rank and (len(piece) == 1 or self.split(piece) is not None)

    def spine(self, piece: str, side: int) -> list[tuple[str, int]]:
        """What stands at one edge of ``piece`` while it is made, with the rank of the merge that ends it."""
        out, until = [(piece, 1 << 40)], self.rank[piece]
        while len(piece) > 1:
            piece = self.split(piece)[side]
            out.append((piece, until))
            until = self.rank[piece]
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border when ``left`` and ``right`` stand side by side."""
        key = (left, right)
        if key not in self.fits:
            ok = True
            for a, a_ends in self.spine(left, 1):
                for b, b_ends in self.spine(right, 0):
                    m = self.rank.get(a + b)
                    if m is not None and m < a_ends and m <= b_ends:
                        since = max(self.rank[x] if len(x) > 1 else -1 for x in (a, b))
                        if since < min(a_ends, b_ends):
                            ok = False
            self.fits[key] = ok
        return self.fits[key]

    # -- states ---------------------------------------------------------------------------------
    def clear(self) -> None:
        self.class_of = np.full(0x110000, -1, np.int32)
        self.chars: list[str] = []
        self.foreign: dict[int, int] = {}
        self.held: list[np.ndarray] = []
        self.forget([])
        self.mark = self.char_class(MARK)
        self.class_of[ord(" ")] = self.mark

    def forget(self, used: list[np.ndarray]) -> None:
        """Drop all states and transitions but the states in the arrays ``used``, which are renumbered in place."""
        old = self.keys if used else []
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        width = min(DENSE, max(64, 1 << (len(self.chars) - 1).bit_length())) if self.chars else 64
        self.table = np.full((1024, width), -1, np.int32)  # 256 * next state + 128 + change of the count
        self.far: dict[int, int] = {}  # the same by state * 2 ** 21 + class, for classes without a column
        self.state(("", ((0, "", 0),)))  # state 0: nothing read since a reset
        for a in used:
            distinct, back = np.unique(a, return_inverse=True)
            a[:] = np.array([self.state(old[i]) for i in distinct.tolist()], a.dtype)[back]
        if len(self.fits) > MAX_PAIRS:
            self.fits.clear()

    def state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
        return self.ids[key]

    def make_room(self, used: list[np.ndarray]) -> None:
        """Rows for all states and columns for all dense classes; what is compiled is dropped instead if it has grown too large."""
        while self.table.shape[1] < min(DENSE, len(self.chars)):
            self.table = np.hstack([self.table, np.full_like(self.table, -1)])
        if len(self.keys) * self.table.shape[1] > MAX_CELLS or len(self.far) > MAX_FAR:
            self.forget(used)
        while len(self.keys) > len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])

    def char_class(self, c: str) -> int:
        k = int(self.class_of[ord(c)])
        if k < 0:
            size = 0 if c in self.rank else len(c.encode("utf-8", "surrogatepass"))
            k = self.foreign.get(size, len(self.chars))
            if size:
                self.foreign[size] = k
            self.class_of[ord(c)] = k
            if k == len(self.chars):
                self.chars.append(c)
        return k

    def compile(self, state: int, k: int) -> None:
        """Fill in one transition."""
        c, key = self.chars[k], self.keys[state]
        if c == MARK and not key[0].endswith(MARK):
            key = self.keys[0]
        suffix, opens = key
        if c not in self.rank:
            to, delta = 0, (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)
        else:
            found = None
            for start, last, count in opens:
                piece = suffix[start:] + c
                if self.valid(piece) and (not last or self.compatible(last, piece)):
                    found = (piece, count + 1)
                    break
            piece, delta = found
            grown, opened = suffix + c, {start: (last, count) for start, last, count in opens}
            keep = [i for i in range(len(grown)) if grown[i:] in self.starts and i in opened]
            base = keep[0] if keep else len(grown)
            to = self.state((grown[base:], (*((i - base, opened[i][0], opened[i][1] - delta) for i in keep), (len(grown) - base, piece, 0))))
        if k < DENSE:
            self.table[state, k] = 256 * to + 128 + delta
        else:
            self.far[state << 21 | k] = 256 * to + 128 + delta

    def steps(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Transitions of the states, -1 where they are not compiled yet."""
        away = np.flatnonzero(k >= DENSE)
        if not len(away):
            return self.table[s, k]
        step = self.table[s, np.minimum(k, DENSE - 1)]
        step[away] = [self.far.get(x, -1) for x in (s[away].astype(np.int64) << 21 | k[away]).tolist()]
        return step

    # -- runs -----------------------------------------------------------------------------------
    def run(self, symbols: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Advance a lane from each ``start`` to its ``stop``; updates ``state``, returns the counts."""
        count, at = np.zeros(len(start), np.int64), start.copy()
        live = np.flatnonzero(at < stop)
        while len(live):
            s, k = state[live], symbols[at[live]]
            step = self.steps(s, k)
            if (unknown := step < 0).any():
                for pair in set(zip(s[unknown].tolist(), k[unknown].tolist(), strict=True)):
                    self.compile(*pair)
                step = self.steps(s, k)
            count[live] += (step & 255) - 128
            state[live] = step >> 8
            at[live] += 1
            if len(self.keys) > len(self.table) or len(self.far) > MAX_FAR:
                self.make_room([*self.held, state])
            live = live[at[live] < stop[live]]
        return count

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        self.held = []
        points = [np.frombuffer((MARK + t).encode("utf-32-le", "surrogatepass") if t else b"", "<u4") for t in texts]
        flat = np.concatenate([*points, np.zeros(0, "<u4")]).astype(np.int64)
        for c in np.unique(flat[self.class_of[flat] < 0]):
            self.char_class(chr(int(c)))
        self.make_room([np.zeros(1, np.int32)])
        symbols = self.class_of[flat]
        sizes = np.array([len(p) for p in points], np.int64)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.zeros(len(owner), bool)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first[nth == 0] = True
        begin = np.repeat(np.cumsum(sizes) - sizes, lanes) + nth * LANE
        end = np.minimum(begin + LANE, np.repeat(np.cumsum(sizes), lanes))
        # the constant part of each chunk's state map: from its first word start to its end
        is_mark = symbols == self.mark
        word = is_mark & ~np.concatenate([[False], is_mark[:-1]]) if len(symbols) else is_mark
        marks = np.flatnonzero(word)
        where = np.searchsorted(marks, begin)
        body = np.where(where < len(marks), marks[np.minimum(where, max(len(marks) - 1, 0))] if len(marks) else end, end)
        body = np.where(first, begin, np.minimum(body, end))
        state = np.zeros(len(owner), np.int32)
        total = self.run(symbols, body, end, state)
        # what stands before a chunk's first word start runs from the state before it, first from a likely one
        todo = np.flatnonzero(~first & (begin < body))
        entry = np.zeros(len(todo), np.int32)
        self.held = [state, entry]
        through = (~first & (body == end))[todo - 1]
        warm = np.zeros(int(through.sum()), np.int32)
        start = begin[todo[through]]
        self.run(symbols, np.maximum(start - RUN_UP, begin[todo[through] - nth[todo[through]]]), start, warm)
        entry[through] = warm
        entry[~through] = state[todo[~through] - 1]
        heads, stale = np.zeros(len(todo), np.int64), np.arange(len(todo))
        while len(stale):
            now = todo[stale]
            out = entry[stale]
            heads[stale] = self.run(symbols, begin[now], body[now], out)
            passing = body[now] == end[now]
            state[now[passing]] = out[passing]
            stale = np.flatnonzero(entry != state[todo - 1])
            entry[stale] = state[todo[stale] - 1]
        total[todo] += heads
        self.held = []
        return np.bincount(owner, total, len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)


_compiled: dict[str, CountTransducer] = {}


def counter(model: str) -> CountTransducer:
    """The transducer of ``model``, compiled once in a Python worker."""
    if model not in _compiled:
        _compiled[model] = CountTransducer(model)
    return _compiled[model]


def count_tokens(df: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``: the tokens of each whole text under the sentencepiece model file ``model``.

    The file must exist on every executor. Null and empty texts count 0. Other columns pass through.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def tokens(batch: pd.Series) -> pd.Series:
        texts, machine = batch.tolist(), counter(model)
        return pd.Series(np.concatenate([*(machine.count(part) for _, part in chunks(texts, TOGETHER)), np.zeros(0, np.int64)]))

    return df.withColumn(out, tokens(text_or_empty(text)))
