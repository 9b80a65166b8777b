"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` words (the whole item if it is shorter). As a set join: a
window is a set of ``shingle``-word shingles with their offsets, a document contains it if it has all of
them at those offsets. Since all must be there, one shingle is a sufficient prefix: shingles are ordered
by how often the documents have them, and only a window's rarest is joined. Its offset gives the place
where the window must start (positional bound), which must leave room for the whole window (length
bound); the candidates left are verified shingle by shingle at their exact places.

The documents are read twice: once for the places of benchmark shingles (a stage without shuffles as long
as the benchmark's shingles are few enough to broadcast, which is checked), once for the word counts and the
caller's columns. There the results of the texts with hits are broadcast, if a count finds them few enough;
else the rows, with the columns that the caller keeps, are shuffled to them.

Nulls and empty texts have no words and no hits; items without words have no windows. Repeated documents
each get their own row. Items are told apart by item_id; several rows of one id count as one item. Null
ids of items are left out of the items' list but their windows still hit. Without documents the result is
empty, without items nothing is hit. Columns named like a result are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD_CLASS, let, lower_ascii, words, write_table

#: Columns that ``decontaminate`` adds.
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Benchmark shingles up to which their table is broadcast (about 100 bytes each); more are shuffled.
BROADCAST_SHINGLES = 500_000
#: Distinct texts with hits up to which their results are broadcast (about 150 bytes each); beyond, texts are shuffled to them.
BROADCAST_FOUND = 200_000


def plain_words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return words(lower_ascii(c), NON_WORD_CLASS)


def shingles(ws: Column, k: int) -> Column:
    """All runs of ``k`` words, space-joined, in order; empty if there are fewer words."""
    if k == 1:
        return ws
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, k)))
    return let(ws, lambda w: F.when(F.size(w) >= k, runs(w)))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """Distinct windows: win (its words, space-joined), n (words), and one row per item that has it."""
    ws = items.select(F.col(item_id).alias("item_id"), plain_words(text).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1))
    out = ws.select("item_id", "ws", n.alias("n"), starts.alias("i"))
    return out.select("item_id", "n", F.concat_ws(" ", F.slice("ws", F.col("i"), F.col("n"))).alias("win")).distinct()


def occurrences(docs: DataFrame, wins: DataFrame, key: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, start, n, win) of every occurrence of a window in ``docs``; starts count words from 0.

    ``key`` must tell the rows of ``docs`` apart as far as their texts differ.
    """
    # shingles have `shingle` words, or all words of a shorter window; each length is searched by itself
    w = wins.select("win", "n").distinct().withColumn("k", F.least("n", F.lit(shingle)))
    parts = w.select("win", "n", "k", F.split("win", " ").alias("ws"))
    cut = F.lit(None).cast("array<string>")
    lengths = sorted(r.k for r in w.select("k").distinct().collect())  # at most `shingle` numbers
    for k in lengths:
        cut = F.when(F.col("k") == k, shingles(F.col("ws"), k)).otherwise(cut)
    need = parts.select("win", "n", F.posexplode(cut).alias("offset", "sh"))
    need = write_table(need, "window-shingles")
    vocabulary = need.select("sh").distinct()
    if vocabulary.count() <= BROADCAST_SHINGLES:
        vocabulary = F.broadcast(vocabulary)
    base = docs.select(F.col(key).alias("__sd_k"), plain_words(text).alias("ws"))
    if len(lengths) == 1:
        found = base.select("__sd_k", F.posexplode(shingles(F.col("ws"), lengths[0])).alias("at", "sh"))
    elif lengths:  # one pass over the documents for all lengths
        at = lambda k: F.transform(F.coalesce(shingles(F.col("ws"), k), F.array().cast("array<string>")), lambda x, i: F.struct(i.alias("at"), x.alias("sh")))
        found = base.select("__sd_k", F.inline(F.concat(*map(at, lengths))))
    else:
        found = base.select("__sd_k", F.lit(0).alias("at"), F.lit("").alias("sh")).limit(0)
    places = write_table(found.join(vocabulary, "sh", "left_semi").distinct(), "shingle-places")
    rarity = places.groupBy("sh").agg(F.count("*").alias("df"))
    # the prefix of each window: its rarest shingle; a window with a shingle that no document has is dropped
    ranked = need.join(rarity, "sh", "left").groupBy("win", "n").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "sh")).alias("p"), F.count("*").alias("n_sh")
    )
    prefix = ranked.filter("p.df > 0").select("win", "n", "n_sh", F.col("p.offset").alias("offset"), F.col("p.sh").alias("sh"))
    last = places.groupBy("__sd_k").agg(F.max(F.col("at") + F.size(F.split("sh", " "))).alias("end"))
    candidates = places.join(prefix, "sh").select("__sd_k", "win", "n", "n_sh", (F.col("at") - F.col("offset")).alias("start"))
    candidates = candidates.filter("start >= 0").join(last, "__sd_k").filter("start + n <= end").drop("end")
    checks = candidates.join(need.select("win", "offset", "sh"), "win").withColumn("at", F.col("start") + F.col("offset"))
    full = checks.join(places, ["__sd_k", "at", "sh"]).groupBy("__sd_k", "win", "n", "n_sh", "start").agg(F.count("*").alias("n_ok"))
    return full.filter("n_ok = n_sh").select("__sd_k", "start", "n", "win")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated to every row of ``docs``."""
    own = [c for c in docs.columns if c not in RESULTS]
    keyed = docs.select(*own, F.md5(F.coalesce(text, F.lit(""))).alias("__sd_k"))
    wins = write_table(item_windows(items, item_id, text, window), "item-windows")
    hits = write_table(occurrences(keyed, wins, "__sd_k", text), "window-hits")
    covered = hits.select("__sd_k", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
    n_hit = covered.distinct().groupBy("__sd_k").agg(F.count("*").alias("n_hit"))
    of_items = hits.select("__sd_k", "win").distinct().join(wins.select("win", "item_id"), "win").select("__sd_k", "item_id").distinct()
    per_doc = of_items.groupBy("__sd_k").agg(
        F.count("item_id").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.col("item_id").cast("string")))), 256).alias("items_sha256"),
    )
    found = write_table(n_hit.join(per_doc, "__sd_k"), "documents-hit")
    if found.count() <= BROADCAST_FOUND:
        found = F.broadcast(found)
    out = keyed.withColumn("n_words", F.size(plain_words(text)).cast("long")).join(found, "__sd_k", "left").drop("__sd_k")
    nothing = F.sha2(F.lit(""), 256)
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items_sha256": F.coalesce("items_sha256", nothing)}).withColumn("contaminated", F.col("n_hit") > 0)


#: DuckDB twin of the query op8, by explicit windows of the whole documents.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT k, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
       FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT k, i, dw.n AS n, win, item_id FROM dw JOIN bw USING (n, win)),
c AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS pos FROM h) GROUP BY k),
s AS (SELECT k, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN s USING (k)
"""
