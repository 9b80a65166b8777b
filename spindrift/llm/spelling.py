"""Spelling variants: words one edit apart, each attached to a much more frequent neighbour.

Words are counted in every task before they move. For the pairs, an edit leaves the first or the second half
of the shorter word whole, so words are dealt by (length of the shorter word, which half, that half). Inside such a shard the
other parts are cut into padded bigrams with positions, and an inverted index lists the words of each (bigram, position), apart for each length.
A probe takes of its bigrams the rarest, as many as one edit can destroy and one more; a heap merges their postings, limited to the
lengths and positions that one edit allows; words that share enough bigrams in all (the count filter) are verified letter by letter.

A shard of more than ``BLOCK`` words is dealt into blocks, and each pair of blocks is a task of its own, so that a half that
a third of all words have is spread and no task holds more than two blocks. Chains of forms are followed by doubling
over written tables; each step at least doubles the count of the word, so there are few.

Null texts have no words, a null doc_id counts as an empty string, repeated rows count again, an empty table gives an empty
one; further columns are left out. Whole texts are read. Words need ``LEAST`` code points, under which an edit could leave no bigram.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, small_batches, text_or_empty, write_table

#: Fixed value: the letters of a word.
WORD = "[A-Za-zÀ-ÿ]+"
#: Words of a shard that one block holds, salts of the join that tells large shards, distinct words counted in a task before they are passed on.
BLOCK, SALTS, HELD = 4096, 16, 200_000
#: Code points that a word needs at least.
LEAST = 4


def word_counts(df: DataFrame, min_chars: int = 5, min_count: int = 3, slip: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of whole texts, A-Z in lower case, that have ``min_chars`` code points and occur ``min_count`` times.

    With ``slip``, a word whose crc32 together with its document's id is divisible by it loses one letter first.
    """
    if min_chars < LEAST:
        raise ValueError(f"words need at least {LEAST} code points")
    small_batches(df.sparkSession)
    find = re.compile(WORD).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(find(body.encode("utf-8").lower().decode("utf-8")))  # bytes lower A-Z only
                if slip is None:
                    held.update({w: n for w, n in found.items() if len(w) >= min_chars})
                else:
                    seed = zlib.crc32(f"{doc}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), seed)
                        if not h % slip:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= min_chars:
                            held[w] += n
                if len(held) > HELD:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), text_or_empty(text).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def bigrams(part: str) -> list[tuple[str, int]]:
    """The bigrams of a padded string with their positions."""
    padded = f"\0{part}\0"
    return [(padded[i : i + 2], i) for i in range(len(part) + 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one longer, is one replaced or inserted code point away."""
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return i < len(b) and a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Postings:
    """The inverted index of the free parts of words of one length: (bigram, position) to word numbers, ascending."""

    def __init__(self, parts: list[str]):
        self.parts, self.lists = parts, defaultdict(list)
        for i, part in enumerate(parts):
            for key in bigrams(part):
                self.lists[key].append(i)

    def candidates(self, part: str, after: int = -1) -> Iterator[int]:
        """Numbers above ``after`` whose part may be one edit from ``part``, which is as long or one shorter."""
        longer = bool(self.parts) and len(self.parts[0]) > len(part)
        grams, get = bigrams(part), self.lists.get
        # an inserted code point destroys one bigram of the shorter word, a replaced one two
        most = 1 if longer else 2
        shifts = (0, 1) if longer else (0,)
        sizes = sorted((sum(len(get((g, p + s), ())) for s in shifts), g, p) for g, p in grams)
        lists = [x for _, g, p in sizes[: most + 1] for s in shifts if (x := get((g, p + s)))]
        if after >= 0:
            lists = [x[bisect_right(x, after) :] for x in lists]
        least, before = len(grams) - most, -1
        for i in heapq.merge(*lists) if len(lists) > 1 else lists[0] if lists else ():
            if i != before:
                before = i
                other = f"\0{self.parts[i]}\0"
                if sum(any(other[p + s : p + s + 2] == g for s in shifts) for g, p in grams) >= least:
                    yield i


def pairs_of(short: list, long: list, more_short: list | None, more_long: list | None, half: int, head: bool) -> Iterator[tuple]:
    """Near pairs of (word, n) lists: inside one block, or between a block and another one (``more_``)."""
    free = (lambda w: w[half:]) if head else (lambda w: w[: len(w) - half])
    kept = len(short[0][0]) // 2 if short else len(more_short[0][0]) // 2 if more_short else 0

    def joined(probes: list, index: Postings, words: list, own: bool = False) -> Iterator[tuple]:
        for k, (w, n) in enumerate(probes):
            for i in index.candidates(free(w), k if own else -1):
                v, m = words[i]
                # pairs with both halves in common are found by the first half
                if one_edit(w, v) and (head or w[:kept] != v[:kept]):
                    yield w, n, v, m

    if more_short is None:
        index = Postings([free(w) for w, _ in short])
        yield from joined(short, index, short, True)
        if long and short:
            yield from joined(short, Postings([free(w) for w, _ in long]), long)
        return
    if short and more_short:
        yield from joined(more_short, Postings([free(w) for w, _ in short]), short)
    if long and more_short:
        yield from joined(more_short, Postings([free(w) for w, _ in long]), long)
    if short and more_long:
        yield from joined(short, Postings([free(w) for w, _ in more_long]), more_long)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) once for each pair of distinct words of (word, n) that are exactly one edit apart.

    ``words`` must be cheap to read twice (a written table).
    """
    size = F.length("word")
    shards = []
    for less in (0, 1):
        m = size - less
        half = F.floor(m / 2).cast("int")
        shards += [F.struct(m.alias("m"), F.lit(True).alias("head"), F.substring("word", F.lit(1), half).alias("half")), F.struct(m.alias("m"), F.lit(False).alias("head"), F.right("word", m - half).alias("half"))]
    dealt = words.select("word", "n", F.inline(F.array(*shards))).filter(F.col("m") >= LEAST)
    # a shard without a word of the shorter length has no pair
    key = ["m", "head", "half"]
    count = dealt.groupBy(*key).count().filter(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    count = count.select(*key, "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(count, [*key, "salt"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("word", F.lit(1)), blocks).cast("int")
    met = salted.select(*key, "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")
    tasks = met.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "word")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            a, n, b, k = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.string()), pa.array(k, pa.int64())], ["a", "n_a", "b", "n_b"])

        for (m, head, half, i, j), group in groups(batches):
            parts: dict = defaultdict(list)
            for own, w, n in group:
                parts[own, len(w) > m].append((w, n))
            get = lambda o, longer: parts.get((o, longer), [])  # noqa: B023, E731
            more = (None, None) if i == j else (get(j, False), get(j, True))
            for pair in pairs_of(get(i, False), get(i, True), *more, len(half), head):
                out.append(pair)
                if len(out) >= 10_000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return tasks.mapInArrow(work, "a string, n_a long, b string, n_b long")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted stream by their first five columns; lone rows are passed over."""
    now, held = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for key, row in zip(zip(*cols[:5], strict=True), zip(*cols[5:], strict=True), strict=True):
            if key != now:
                if len(held) > 1:
                    yield now, held
                now, held = key, []
            held.append(row)
    if len(held) > 1:
        yield now, held


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n).

    The form is the near word of largest n (of equal ones the first in code-point order) if that n is ``factor`` times
    the word's own; the root is the end of the chain of forms, the word itself if it has none.
    """
    if factor < 2:
        raise ValueError("chains of forms end only with a factor of at least 2")
    words = write_table(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    sides = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = pairs.select(sides).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    big = -F.col("best.less") >= factor * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(big, F.col("best.near")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n"))
    formed = write_table(formed, "forms")
    roots = write_table(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the part of every chain that is done
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = write_table(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_table(roots)
        roots = further.select("word", "root")
        if not further.filter("moved").limit(1).count():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
