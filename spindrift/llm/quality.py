"""Quality rules as a bitmask ledger, in DataFrame operations only.

``ledger`` evaluates every rule once and stores its measurements and one failure bit per rule. Policies
are versioned bit masks over that ledger: ``apply_policy`` keeps a row if none of the policy's bits is
set, and ``ablation`` counts in one aggregation what each rule of a policy removes alone, so a policy can
change without reading the texts again.

Nulls and empty texts have no words: all measurements are 0 and the length rule fails. Repeated rows are
judged one by one; an empty table gives an empty ledger; columns named like a measurement are replaced. Texts are
never shortened. Equal windows are found by the 64-bit hash of the hashes of
their 8 words inside one text (20,000 windows of one text collide with a chance below 1e-10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, words

#: Words of a repetition window.
WINDOW = 8
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: One bit per rule: name -> (bit, failure condition over the measurements).
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "10 * n_symbols > 3 * n_words"),
    "duplicate_lines": (3, "n_lines >= 5 and 2 * n_dup_lines > n_lines"),
    "short_words": (4, "n_words > 0 and word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
    "marks": (6, "10 * n_marks > 6 * n_words"),
    "capitals": (7, "n_letters >= 40 and 10 * n_capitals > 6 * n_letters"),
}

#: Versioned policies: the names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[policy])


def window_hashes(ws: Column) -> Column:
    """A hash of each window of words, in order; empty for shorter texts."""
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    rolled = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    return let(hashes, lambda h: F.when(F.size(h) >= WINDOW, rolled(h)).otherwise(F.array().cast("array<bigint>")))


def repeat_words(ws: Column) -> Column:
    """Words inside a window that occurs at least twice in the text, the first occurrence included:
    sort (hash, position), keep equal neighbours, add up what each kept position covers before the next."""

    def places(windows: Column) -> Column:
        return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(placed: Column) -> Column:
        has_twin = lambda x, i: F.get(placed, i - 1)["h"].eqNullSafe(x["h"]) | F.get(placed, i + 1)["h"].eqNullSafe(x["h"])
        return F.array_sort(F.transform(F.filter(placed, has_twin), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(windows: Column) -> Column:
        repeats = let(places(windows), lambda placed: let(twins(placed), covered))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), repeats).otherwise(0)

    return let(window_hashes(ws), count).cast("long")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks, n_letters, n_capitals
    and fail_bits. Each step stands in its own projection, so that no array is computed twice."""
    t = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words(F.col(text), SPACE_CLASS), lambda ws: F.struct(F.size(ws).alias("n"), repeat_words(ws).alias("repeats")))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dups")))
    out = df.withColumns({"__sd_words": counts, "__sd_lines": of_lines})
    out = out.withColumns({
        "n_words": F.col("__sd_words.n").cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\u000b\f\r", "")).cast("long"),
        "n_symbols": without(SYMBOLS),
        "n_lines": F.col("__sd_lines.n").cast("long"),
        "n_dup_lines": F.col("__sd_lines.dups").cast("long"),
        "n_repeat_words": F.col("__sd_words.repeats"),
        "n_marks": without("!?|{}\\"),
        "n_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long"),
        "n_capitals": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
    })
    bits = [F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, test in RULES.values()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("fail_bits", total.cast("int")).drop("__sd_words", "__sd_lines")


def apply_policy(led: DataFrame, policy: str = "v1", out: str = "kept") -> DataFrame:
    """Add ``out``: whether no rule of the policy failed."""
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of the policy: rows that fail it, rows that only it rejects (what dropping the rule
    would keep), and rows kept by the whole policy. One aggregation over the bits, no text is read."""
    m = mask(policy)
    failing = F.col("fail_bits").bitwiseAND(F.lit(m))
    counts = led.groupBy(failing.alias("bits")).agg(F.count("*").alias("n"))
    rules = led.sparkSession.createDataFrame([(policy, r, 1 << RULES[r][0]) for r in POLICIES[policy]], "policy string, rule string, bit int")
    # at most 2**rules rows of counts meet the rules
    joined = rules.join(F.broadcast(counts), F.lit(True), "left")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return joined.groupBy("policy", "rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )


#: DuckDB twin of the query op7: the measurements by explicit windows, the policy spelt out.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT k, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
      FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
c AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM p) WHERE n > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM c, range(0, 8) AS o(j) GROUP BY k),
m AS (SELECT w.k, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^!?|{}\\]', '', 'g'))::BIGINT AS n_marks,
             length(regexp_replace(t, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters,
             length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_capitals,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words
            OR (n_lines >= 5 AND 2 * n_dup_lines > n_lines) OR (n_words > 0 AND word_chars < 2 * n_words)
            OR word_chars > 20 * n_words OR 10 * n_marks > 6 * n_words
            OR (n_letters >= 40 AND 10 * n_capitals > 6 * n_letters)) AS kept
FROM m
"""
