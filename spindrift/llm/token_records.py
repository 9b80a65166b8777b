"""Token-id sequences in length-delimited binary record files, with an offset index.

File format (all integers little-endian). A file is a run of records; a record is
    uint64 length | uint32 masked CRC-32C of those 8 bytes | payload | uint32 masked CRC-32C of the payload
with mask(c) = rotate_right(c, 15) + 0xa282ead8 modulo 2**32. The payload is
    int64 doc_id | uint8 flags (1: doc_id is null) | uint8 bytes of an id (2 or 4) | ids.
The index is a separate Parquet table (shard, file, ordinal, doc_id, offset, n_bytes, n_tokens): any
record can be fetched by one ranged read, so training can read in shuffled order.

Writers name a file after shard and attempt; only files that the index names count, and Spark commits the
index rows of one attempt a task. A lost executor or a second attempt therefore never mixes records.

Rows are ordered by doc_id (nulls first, then by text). Null and empty texts hold the end id alone.
Repeated rows each get a record, an empty table none; only doc_id and text are read, whatever else there is.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import byte_chars
from .common import chunks, open_fs, partitions, shared_dir, small_batches, text_or_empty, write_table

INDEX = "shard int, file string, ordinal long, doc_id long, offset long, n_bytes long, n_tokens long"
#: Words whose ids a Python worker keeps, characters encoded together, bytes of a read.
KEEP, TOGETHER, READ = 900_000, 3_000_000, 8 << 20
MASK = np.uint32(0xA282EAD8)
BLOCK = 256


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32C (reflected 0x82F63B78) by 16-bit steps, and the effect of BLOCK zero bytes on a state by its 4 bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    pairs = np.arange(65536, dtype=np.uint32)
    wide = t[pairs & 255] ^ (pairs >> 8)
    wide = t[wide & 255] ^ (wide >> 8)
    ahead = np.zeros((4, 256), np.uint32)
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(BLOCK // 2):
            c = wide[c & 0xFFFF] ^ (c >> 16)
        ahead[k] = c
    return wide, ahead


_WIDE, _AHEAD = _crc_tables()


def masked_crc32c(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each byte string of 4 bytes or more, all at once.

    Strings stand right-aligned in rows of BLOCK bytes; leading zeros leave a zero state alone and the
    usual start value is folded into the first 4 bytes. Rows of a string are then joined in order.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    rows = -(-sizes // BLOCK)
    ends = np.cumsum(rows) * BLOCK
    grid = np.zeros(int(rows.sum()) * BLOCK, np.uint8)
    for p, end, n in zip(parts, ends.tolist(), sizes.tolist(), strict=True):
        grid[end - n : end] = np.frombuffer(p, np.uint8)
        grid[end - n : end - n + 4] ^= 255
    steps = grid.reshape(-1, BLOCK).view("<u2").T.astype(np.uint32)
    state = np.zeros(steps.shape[1], np.uint32)
    for step in np.ascontiguousarray(steps):
        state = _WIDE[(state ^ step) & 0xFFFF] ^ (state >> 16)
    first = np.cumsum(rows) - rows
    crc = np.zeros(len(parts), np.uint32)
    live, k = np.flatnonzero(rows > 0), 0
    while len(live):
        c = crc[live]
        crc[live] = _AHEAD[0, c & 255] ^ _AHEAD[1, c >> 8 & 255] ^ _AHEAD[2, c >> 16 & 255] ^ _AHEAD[3, c >> 24] ^ state[first[live] + k]
        k += 1
        live = live[rows[live] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + MASK


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    checks = zip(masked_crc32c(heads).tolist(), masked_crc32c(payloads).tolist(), strict=True)
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b))) for h, p, (a, b) in zip(heads, payloads, checks, strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """Payloads of whole records; raises if a length or checksum is wrong."""
    if not records:
        return []
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    want = np.array([[*struct.unpack("<I", r[8:12]), *struct.unpack("<I", r[-4:])] for r in records], np.uint32)
    if any(struct.unpack("<Q", h)[0] != len(p) for h, p in zip(heads, payloads, strict=True)):
        raise ValueError("a record's length is wrong")
    if (masked_crc32c(heads) != want[:, 0]).any() or (masked_crc32c(payloads) != want[:, 1]).any():
        raise ValueError("a record's checksum is wrong")
    return payloads


class WordEncoder:
    """The tokenizers library, asked once for each distinct piece of a word.

    Tokenizers that drop white space and mark word ends encode every pre-token alone. So texts are cut at white space
    and their distinct words numbered by Arrow; a word's ids are those that the library's model gives its pre-tokens.
    Texts with other scripts or special strings, and tokenizers of other kinds, go to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        size = self.library.get_vocab_size()
        self.dtype = "<u2" if size < 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])], [s["type"] for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and bool(suffix)
        if self.by_word:
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            self.by_word = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
            pattern = split["pattern"]["Regex"]
            for k in (r"\p{L}", r"\p{N}", r"\s"):
                pattern = pattern.replace(k, "".join(re.escape(chr(i)) for i in range(0x250) if regex.match(k, chr(i))))
            self.pattern = re.compile(pattern)
            self.shown = {b: c for c, b in byte_chars().items()}
            self.special = [t["content"] for t in spec["added_tokens"]]
            # letters whose small form lies beyond the classes spelt out are left to the library, as U+0130, which becomes two characters
            near = "".join(re.escape(chr(i)) for i in range(0x250) if not 0x1C <= i < 0x20 and len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 0x250)
            self.foreign = re.compile(f"[^{near}]")

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        tokenize, letter, known = self.model.tokenize, "HI"[self.dtype == "<u4"], self.pieces.get
        for w in words:
            ids = b""
            for p in self.pattern.findall(w.lower()):
                own = known(p)
                if own is None:
                    raw = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.shown)
                    tokens = tokenize(raw)
                    own = self.pieces[p] = struct.pack(f"<{len(tokens)}{letter}", *[t.id for t in tokens])
                ids += own
            self.words[w] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.ids(texts)
        out: list[bytes] = [b""] * len(texts)
        whole = [self.foreign.search(t) is not None or any(s in t for s in self.special) for t in texts]
        odd, plain = ([i for i, x in enumerate(whole) if x is kind] for kind in (True, False))
        for i, x in zip(odd, self.ids([texts[i] for i in odd]), strict=True):
            out[i] = x
        for kept in (self.words, self.pieces):
            if len(kept) > KEEP:
                self.words.clear()
                self.pieces.clear()
        split = pc.utf8_split_whitespace(pa.array([texts[i] for i in plain], pa.large_string()))
        words = split.values.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([w for w in distinct if w not in self.words])
        get = [self.words[w] for w in distinct].__getitem__
        numbers, ends = words.indices.to_numpy().tolist(), split.offsets.to_numpy().tolist()
        for i, a, b in zip(plain, ends, ends[1:], strict=False):
            out[i] = b"".join(map(get, numbers[a:b]))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_records(df: DataFrame, tokenizer: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write ``df`` in ascending ``doc_id`` order below ``folder``; returns the written index."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        enc, offset, ordinal = encoder(tokenizer), 0, 0
        width = np.dtype(enc.dtype).itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for at, part in chunks(batch.text.tolist(), TOGETHER):
                    docs = batch.doc_id.iloc[at : at + len(part)]
                    ids = [x + end for x in enc.encode(part)]
                    heads = [struct.pack("<qBB", 0 if n else int(d), n, width) for d, n in zip(docs, docs.isna(), strict=True)]
                    records = frame([h + x for h, x in zip(heads, ids, strict=True)])
                    for r in records:
                        out.write(r)
                    sizes = np.array([len(r) for r in records], np.int64)
                    yield pd.DataFrame({"shard": shard, "file": name, "ordinal": ordinal + np.arange(len(sizes)), "doc_id": docs.values, "offset": offset + np.cumsum(sizes) - sizes, "n_bytes": sizes, "n_tokens": [len(x) // width for x in ids]})
                    offset, ordinal = offset + int(sizes.sum()), ordinal + len(sizes)

    return write_table(rows.mapInPandas(write, INDEX), "token-index")


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack("<qBB", payload[:10])
    return None if null else doc_id, np.frombuffer(payload[10:], f"<u{width}").astype("<u4")


def scan_files(index: DataFrame, folder: str) -> DataFrame:
    """Read every file front to back, verify it, and return one row per record:
    shard, ordinal, doc_id, local_start (ids before it in its file), n_tokens, ids_crc32."""
    files = index.groupBy("shard", "file").agg(F.count("*").alias("n"))
    files = files.repartition(partitions(index.sparkSession), "shard")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_fs(folder)
        for shard, name, n in (x for b in batches for x in b.itertuples(index=False)):
            tail, start, ordinal = b"", 0, 0
            with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                while True:
                    more = f.read(READ)
                    tail += more
                    records, at = [], 0
                    while at + 12 <= len(tail) and at + 16 + (size := struct.unpack_from("<Q", tail, at)[0]) <= len(tail):
                        records.append(tail[at : at + 16 + size])
                        at += 16 + size
                    tail = tail[at:]
                    got = [parse(p) for p in unframe(records)]
                    if got:
                        sizes = np.array([len(x) for _, x in got], np.int64)
                        yield pd.DataFrame({"shard": shard, "ordinal": ordinal + np.arange(len(got)), "doc_id": pd.array([d for d, _ in got], "Int64"), "local_start": start + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": [zlib.crc32(x.tobytes()) for _, x in got]})
                        start, ordinal = start + int(sizes.sum()), ordinal + len(got)
                    if not more:
                        break
            if tail or ordinal != n:
                raise ValueError(f"{name}: {ordinal} whole records, the index has {n}")

    return files.mapInPandas(read, "shard int, ordinal long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """Fetch the records of ``index`` rows (any subset, in any order) by their offsets: doc_id, token_ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_fs(folder)
        for b in batches:
            for name, rows in b.groupby("file"):
                with fs.open_input_file(f"{path}/{name}") as f:
                    got = [parse(p) for p in unframe([f.read_at(n, o) for o, n in zip(rows.offset, rows.n_bytes, strict=True)])]
                yield pd.DataFrame({"doc_id": pd.array([d for d, _ in got], "Int64"), "token_ids": [x.astype(np.int64) for _, x in got]})

    return index.select("file", "offset", "n_bytes").mapInPandas(read, "doc_id long, token_ids array<long>")


def starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Turn local_start into ``start``, the ids of all records before it. Only one row a file meets in one task."""
    per_file = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    base = per_file.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return records.join(base, "shard").withColumn("start", F.col("local_start") + F.col("_base")).drop("_base")


def token_records(spark: SparkSession, df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files, read them back, and return one row per document (see ``scan_files`` and ``starts``)."""
    folder = shared_dir(spark, "token-records")
    index = write_records(df, tokenizer, end_id, folder)
    return starts(scan_files(index, folder), index)
