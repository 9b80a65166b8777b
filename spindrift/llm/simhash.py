"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance by BK-trees.

Distinct fingerprints are dealt into shards by exact keys: fingerprints that differ in at most ``radius``
bits agree on ``blocks - radius`` of ``blocks`` bit blocks, so each is filed once under every choice of
that many blocks and no link is missed. Every shard is a forest of BK-trees, one root per key, children
keyed by their integer Hamming distance to the parent; a query follows only the edges within the radius
of its own distance (triangle inequality). Trees are built and walked level by level in NumPy.

A tree meets its queries in the task that shuffles put them in. Sending the trees of all shards to every
executor, as for a reference set of fixed size, would mean collecting all fingerprints in the driver.
Keys with more than ``SHARD`` fingerprints are cut into tiles (tree of part i, queries of part j), so no
task ever holds more than two parts. Tasks return spanning trees of bounded degree instead of all pairs;
components follow from minimum labels with pointer jumping, written to the shared folder each round.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and exact copies
share one fingerprint and so one component. An empty table gives an empty result; only doc_id and text are read, so
other columns may have any name. The component is the smallest doc_id; null ids don't count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, partitions, pick_rows, small_batches, text_or_empty, write_table

#: Fingerprints of one key in one tree at most; pairs of query and node walked at once.
SHARD, WALK = 8192, 2_000_000
#: Children of a node in the spanning trees that tasks return.
DEGREE = 8
#: 64-bit words of wide fingerprints; minima of a band; share of pairs just at the similarity that may share no band.
WIDE, MINIMA, MISS = 4, 4, 0.005
#: Shingles below which a set has no useful fingerprint.
SMALL = 64
#: Shingles of one part of a cluster in the exact check.
SHINGLES = 2_000_000


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle of a text, repeats included; fewer words make one shingle."""
    import xxhash

    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(ws)
    if len(ws) <= k:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(sizes)
    begin, stop = (ends - sizes)[: len(ws) - k + 1].tolist(), (ends - 1)[k - 1 :].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(begin, stop, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Each bit set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str, k: int = 4) -> int:
    """Unsigned SimHash of the k-word shingles of one text."""
    return majority(shingle_hashes(text, k))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WIDE independent SimHashes of distinct shingle hashes, mixed again with a different odd factor for each."""
    out = []
    for i in range(WIDE):
        x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & 0xFFFFFFFFFFFFFFFF | 1)
        out.append(majority((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)))
    return out


def fingerprints(df: DataFrame, text: str = "text", k: int = 4, out: str = "fp") -> DataFrame:
    """Add ``out``: the fingerprint as a signed long."""
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, k) for t in batch], np.uint64).view(np.int64))

    return df.withColumn(out, run(text_or_empty(text)))


class BKForest:
    """BK-trees over rows grouped by ``group`` (any labels); the first row of a group is its root."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps = fps
        n = len(fps)
        _, first, self.tree = np.unique(group, return_index=True, return_inverse=True)
        self.roots = first
        at = first[self.tree]
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rest = np.flatnonzero(at != np.arange(n))
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[at[rest]]).astype(np.int64)
            slot = at[rest] * 65 + d
            _, head, which = np.unique(slot, return_index=True, return_inverse=True)
            child = rest[head]
            parent[child], edge[child] = at[child], d[head]
            at[rest] = child[which]
            rest = rest[at[rest] != rest]
        # children by (parent, distance)
        self.key = np.sort(parent * 65 + edge)
        self.child = np.argsort(parent * 65 + edge, kind="stable")

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs at most ``radius`` bits apart; ``tree`` tells each query's tree."""
        step = 1024
        for begin in range(0, len(queries), step):
            q = np.arange(begin, min(begin + step, len(queries)))
            node = self.roots[tree[q]]
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
                hit = d <= radius
                yield q[hit], node[hit]
                low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
                width = high - low
                q = np.repeat(q, width)
                node = self.child[np.repeat(low - (np.cumsum(width) - width), width) + np.arange(len(q))]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; labels are the smallest member index."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def local_links(fps: np.ndarray, group: np.ndarray, side: tuple[np.ndarray, np.ndarray], radius: int, wide: np.ndarray | None = None, most: int = 0, names: np.ndarray | None = None) -> pd.DataFrame:
    """Spanning-tree edges of the components inside each group. ``side``: whether a row stands in the tree, and
    whether it queries. ``wide``: fingerprints of several words, which must differ in ``most`` bits at most.
    ``names``: what edges call the rows, else their fingerprints."""
    names = fps.view(np.int64) if names is None else names
    in_tree, asks = np.flatnonzero(side[0]), np.flatnonzero(side[1])
    forest = BKForest(fps[in_tree], group[in_tree])
    known = np.unique(group[in_tree])
    where = np.searchsorted(known, group[asks])
    fine = (where < len(known)) & (known[np.minimum(where, max(len(known) - 1, 0))] == group[asks]) if len(known) else np.zeros(len(asks), bool)
    asks, where = asks[fine], where[fine]
    label = np.arange(len(fps))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for q, node in forest.within(fps[asks], where, radius):
        q, node = asks[q], in_tree[node]
        if wide is not None:
            near = np.bitwise_count(wide[q] ^ wide[node]).sum(1) <= most
            q, node = q[near], node[near]
        held.append((q, node))
        size += len(q)
        if size > WALK:
            merge_labels(label, *map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        merge_labels(label, *map(np.concatenate, zip(*held, strict=True)))
    return one_group(names, label)


def one_group(names: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Edges of a tree of bounded degree over the rows of each label."""
    order = np.argsort(label, kind="stable")
    sorted_labels = label[order]
    begin = np.searchsorted(sorted_labels, sorted_labels, "left")
    nth = np.arange(len(order)) - begin
    child = nth > 0
    up = begin + (nth - 1) // DEGREE
    return pd.DataFrame({"a": names[order[child]], "b": names[order[up[child]]]})


def block_count(n: int, radius: int) -> int:
    """Blocks so that a key of ``blocks - radius`` of them leaves few unrelated fingerprints together."""
    blocks = radius + 2
    while blocks < 2 * radius and n > 2 ** (64 * (blocks - radius) // blocks + 3):
        blocks += 1
    return blocks


def block_keys(fp: str, radius: int, blocks: int):
    """Array of (choice, key) structs: every choice of ``blocks - radius`` bit blocks, cut out of the fingerprint."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = [sum(masks[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints ``fp`` within ``radius`` bits."""
    n = fps.count()
    filed = fps.select("fp", F.explode(block_keys("fp", radius, block_count(n, radius))).alias("k")).select("fp", "k.choice", "k.key")
    sizes = filed.groupBy("choice", "key").agg(F.count("*").alias("m")).filter("m > 1")
    sizes = write_table(sizes.withColumn("parts", F.ceil(F.col("m") / SHARD).cast("int")), "simhash-keys")

    def solve(rows: pd.DataFrame, group: np.ndarray, side: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        return local_links(rows.fp.values.view(np.uint64), group, side, radius)

    return in_shards(filed.join(sizes, ["choice", "key"]), ["fp"], solve)


def in_shards(filed: DataFrame, columns: list[str], solve) -> DataFrame:
    """Edges that ``solve`` finds among the rows of each (choice, key); ``parts`` tells into how many parts it is cut.
    A hot key's rows go to every tile (i, j), i <= j, that their part belongs to; other keys have one tile."""
    spark = filed.sparkSession
    part = F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int")
    tiled = filed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.select("choice", "key", *columns, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    dealt = tiled.repartition(partitions(spark), "choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges(rows: pd.DataFrame) -> pd.DataFrame:
            new = np.zeros(len(rows), bool)
            for c in ("choice", "key", "i", "j"):
                v = rows[c].values
                new[1:] |= v[1:] != v[:-1]
            p, i, j = rows.part.values, rows.i.values, rows.j.values
            return solve(rows, np.cumsum(new), (p == i, p == j))

        kept: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = b.iloc[-1]
            open_ = ((b.choice == last.choice) & (b.key == last.key) & (b.i == last.i) & (b.j == last.j)).values
            done = b[~open_]
            if len(done):
                yield edges(pd.concat([*kept, done], ignore_index=True))
                kept = []
            kept.append(b[open_])
        if kept:
            yield edges(pd.concat(kept, ignore_index=True))

    return dealt.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes with edges."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = write_table(both, "component-edges")
    label = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "component-labels")
    for _ in range(rounds):
        # each node takes the smallest label around it, then the label of its label
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = step.join(up, "label").select("node", "old", F.least("label", "up").alias("label"))
        new = write_table(jumped, "component-labels")
        moved = new.filter("label <> old").limit(1).count()
        drop_table(label)
        label = new.select("node", "label")
        if not moved:
            drop_table(both)
            return label
    raise ValueError("components did not settle")


def bit_share(similarity: float) -> float:
    """Expected share of differing SimHash bits at a Jaccard similarity of equally large shingle sets."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def cuts(similarity: float) -> tuple[int, int]:
    """Bits in which the first word and all words may differ: three deviations beyond the expected distance."""
    p = bit_share(similarity)
    return tuple(int(np.ceil(w * p + 3 * np.sqrt(w * p * (1 - p)))) for w in (64, 64 * WIDE))


def band_count(similarity: float) -> int:
    """Bands so that a pair just at the similarity shares none with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**MINIMA)))


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """One key per band: a hash of the smallest values of a set under MINIMA different mixings (MinHash)."""
    least = np.full(bands * MINIMA, 0xFFFFFFFFFFFFFFFF, np.uint64)
    factor = np.arange(1, bands * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096]
        x = (x ^ (x >> np.uint64(31))) * factor[:, None]
        np.minimum(least, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(1), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for m in least.reshape(bands, MINIMA).T:
        key = (key ^ m) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    return key


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate edges (a, b) between the ``node`` s of distinct shingle sets; ``verified_links`` decides.

    ``sets`` has ``bands`` (``band_keys``), ``size`` and the wide fingerprint of each set. Sets that share a band
    make a shard; their number doesn't depend on how many sets there are. Shards are searched by BK-trees over the
    first word; it and all words are cut at three standard deviations. Sets of fewer than SMALL shingles have too
    few for a fingerprint, so in shards of their own all members are candidates; sets up to SMALL / similarity,
    which may be alike to one of those, are filed in both ways.
    """
    radius, most = cuts(similarity)
    names = [f"w{i}" for i in range(WIDE)]
    one, both, zero = (F.array(*map(F.lit, x)) for x in ((1,), (1, 0), (0,)))
    kinds = F.when(F.col("size") < SMALL, one).when(F.col("size") <= SMALL / similarity, both).otherwise(zero)
    filed = sets.select("node", F.explode("bands").alias("key"), kinds.alias("kinds"))
    filed = filed.select("node", "key", F.explode("kinds").alias("choice"))
    shared = filed.groupBy("key", "choice").agg(F.count("*").alias("m")).filter("m > 1")
    shared = write_table(shared.select("key", "choice", F.ceil(F.col("m") / SHARD).cast("int").alias("parts")), "simhash-keys")
    # only sets that share a shard send their fingerprints there
    met = filed.join(shared, ["key", "choice"]).join(sets.select("node", *names), "node")

    def solve(rows: pd.DataFrame, group: np.ndarray, side: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        wide = np.ascontiguousarray(rows[names].to_numpy(np.int64)).view(np.uint64)
        node, tiny = rows.node.to_numpy(np.int64), rows.choice.values == 1
        out = []
        for mask, free in ((tiny, True), (~tiny, False)):
            if mask.any():
                w = wide[mask]
                sides = tuple(x[mask] for x in side)
                out.append(one_group(node[mask], group[mask]) if free else local_links(np.ascontiguousarray(w[:, 0]), group[mask], sides, radius, w, most, node[mask]))
        return pd.concat(out, ignore_index=True)

    return in_shards(met, ["node", *names], solve)


def exact_links(sets: list[np.ndarray], wide: np.ndarray, side: tuple[np.ndarray, np.ndarray], similarity: float, most: int) -> list[tuple[int, int]]:
    """Pairs of rows, one of each side, that span the components of Jaccard ``similarity`` of sets. Each row that is
    reached is compared with those not reached yet whose fingerprint is at most ``most`` bits away, if not small."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own, tiny = np.zeros(int(flat.max(initial=-1)) + 1, np.uint8), sizes <= SMALL / similarity
    left, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], todo = False, [seed]
        while todo:
            at = todo.pop()
            other = (side[1] if side[0][at] else False) | (side[0] if side[1][at] else False)
            near = np.flatnonzero(left & other & (np.minimum(sizes, sizes[at]) >= similarity * np.maximum(sizes, sizes[at]) - 1e-9))
            near = near[tiny[near] | (np.bitwise_count(wide[near] ^ wide[at]).sum(1) <= most)]
            if not len(near):
                continue
            mine = flat[starts[at] : starts[at] + sizes[at]]
            own[mine] = 1
            ends = np.cumsum(sizes[near])
            where = np.repeat(starts[near] - (ends - sizes[near]), sizes[near]) + np.arange(ends[-1])
            common = np.add.reduceat(own[flat[where]], ends - sizes[near], dtype=np.int64)
            own[mine] = 0
            alike = near[common * (1 + similarity) >= similarity * (sizes[near] + sizes[at]) - 1e-9]
            left[alike] = False
            todo += alike.tolist()
            out += [(at, i) for i in alike.tolist()]
    return out


def verified_links(clusters: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that span the components of texts whose shingle sets have Jaccard ``similarity`` or more, within
    candidate clusters (label, node, hashes, w0, ...) of distinct sets. Large clusters are cut into tiles."""
    names, most = [f"w{i}" for i in range(WIDE)], cuts(similarity)[1]
    sizes = clusters.groupBy("label").agg(F.ceil(F.sum(F.size("hashes")) / SHINGLES).cast("int").alias("parts"))
    sizes = write_table(sizes.filter("parts > 1"), "simhash-clusters")
    filed = clusters.select(F.lit(0).alias("choice"), F.col("label").alias("key"), "node", "hashes", *names)
    if sizes.limit(1).count():
        filed = filed.join(sizes.withColumnRenamed("label", "key"), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        filed = filed.withColumn("parts", F.lit(1))

    def solve(rows: pd.DataFrame, group: np.ndarray, side: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        wide, node, out = rows[names].to_numpy(np.int64).view(np.uint64), rows.node.to_numpy(np.int64), []
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            sets = [np.asarray(x, np.int64) for x in rows.hashes.values[a:b]]
            out += [(node[a + i], node[a + j]) for i, j in exact_links(sets, wide[a:b], (side[0][a:b], side[1][a:b]), similarity, most)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return in_shards(filed, ["node", "hashes", *names], solve)


def similar_documents(df: DataFrame, similarity: float = 0.8, k: int = 5, doc_id: str = "doc_id", text: str = "text", row: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: doc_id and component_id, linking texts whose k-word shingle sets have a Jaccard
    similarity of ``similarity`` or more. Equal sets are always linked, texts without words with each other.
    ``row``: a unique number that ``df`` was written with, else one is written; it and the columns ``carry`` are kept.

    Texts stay where they are: what is shuffled are keys, fingerprints, and the shingle hashes of candidates.
    """
    small_batches(df.sparkSession)
    names, bands = [f"w{i}" for i in range(WIDE)], band_count(similarity)
    if row is None:
        df = write_table(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carry, F.monotonically_increasing_id().alias("__sd_row")), "simhash-rows")
        doc_id, text = "doc_id", "text"
    key, kept = row or "__sd_row", ["doc_id", *([row] if row else []), *carry]

    @F.pandas_udf(f"{', '.join(f'{w} long' for w in ['node', 'size', *names])}, bands array<long>")
    def run(batch: pd.Series) -> pd.DataFrame:
        import xxhash

        out = []
        for t in batch:
            x = np.unique(shingle_hashes(t, k))
            numbers = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7), len(x), *wide_fingerprint(x)], np.uint64)
            out.append((*numbers.view(np.int64).tolist(), band_keys(x, bands).view(np.int64)))
        return pd.DataFrame(out, columns=["node", "size", *names, "bands"])

    @F.pandas_udf("array<long>")
    def hashes(batch: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, k).view(np.int64)) for t in batch], dtype=object)

    marked = df.select(F.col(doc_id).alias("doc_id"), F.col(key).alias(key), *carry, run(text_or_empty(text)).alias("w"))
    marked = write_table(marked.select("doc_id", key, *carry, "w.*"), "simhash-wide")
    same = [F.any_value(c).alias(c) for c in ("size", *names, "bands")]
    per = write_table(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(key).alias("__sd_first"), *same), "simhash-sets")
    # one text of each set in a cluster of several is read again, by the number of its row
    near = per.select("node", "__sd_first", *names).join(components(similar_links(per.drop("least", "__sd_first"), similarity)), "node")
    near = write_table(near, "simhash-near")
    texts = pick_rows(df.select(F.col(key).alias("__sd_first"), F.col(text).alias("__sd_text")), "__sd_first", near)
    texts = texts.select("__sd_first", hashes(text_or_empty("__sd_text")).alias("hashes")).join(near, "__sd_first")
    clusters = write_table(texts.select("label", "node", *names, "hashes"), "simhash-clusters")
    label = components(verified_links(clusters, similarity))
    named = per.select("node", "least").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.select(*kept, "node").join(named.join(least, "label").select("node", "component_id"), "node").select(*kept, "component_id")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id."""
    spark = df.sparkSession
    marked = write_table(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", k).select("doc_id", "fp"), "simhash-fingerprints")
    per_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(per_fp.select("fp"), radius))
    named = per_fp.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "label").select("fp", "component_id")
    out = marked.join(of_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
