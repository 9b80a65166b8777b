"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from spindrift.llm import queries, spelling, sql_twins
from spindrift.llm.common import write_table


def counted(rows, slip=97, least=5, often=3):
    out = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= often}


def edits(w, alphabet):
    for i in range(len(w) + 1):
        yield w[:i] + w[i + 1 :]
        for c in alphabet:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1 :]


def neighbours(words):
    alphabet = {c for w in words for c in w}
    return {w: {v for v in edits(w, alphabet) if v in words and v != w} for w in words}


def expected(words):
    near, form = neighbours(words), {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


def odd_words():
    r = random.Random(6)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(1500)} | {"aaaaa", "aaaaaa", "aaaa", "ababab", "bababa", "ÿÿÿÿÿ", "ÿÿÿÿÀ"}
    return {w: r.choice([3, 3, 4, 6, 12, 24, 50, 100]) for w in words}


@pytest.mark.parametrize("block", [4096, 20])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    """With small blocks every shard is dealt into pairs of blocks; nothing may be lost or found twice."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = odd_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = spelling.near_pairs(write_table(df, "test-words")).collect()
    near = neighbours(words)
    assert sorted(tuple(sorted((p.a, p.b))) for p in pairs) == sorted({tuple(sorted((w, v))) for w, vs in near.items() for v in vs})
    assert all((p.n_a, p.n_b) == (words[p.a], words[p.b]) for p in pairs)
    assert result(spelling.variants(df)) == expected(words)


def test_chains_of_forms(spark):
    words = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "abcdefghij": 96, "zzzzz": 5}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {w: "abcdefghij" for w in words} | {"zzzzz": "zzzzz"}


def test_odd_rows(spark, documents, clashing, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for df in (documents, clashing):
        assert {r.word: r.n for r in spelling.word_counts(df, slip=97).collect()} == counted(rows)
        assert {r.word: r.n for r in spelling.word_counts(df).collect()} == counted(rows, None)
    assert result(spelling.variants(spelling.word_counts(documents, slip=97))) == expected(counted(rows))
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling.word_counts(empty, 3)


def test_case_and_letters(spark):
    df = spark.createDataFrame([(1, "ÉTÉSX étésx ÉTÉsx ÉTÉSX a×b÷c×d x_yabcd naïve-naïve NAÏVE"), (1, None)], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(df, 5, 1).collect()} == {"ÉtÉsx".replace("t", "t"): 3, "étésx": 1, "a×b÷c×d": 1, "yabcd": 1, "naïve": 2, "naÏve": 1}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert result(queries.op13_spelling_variants(spark, sf_dir)) == expected(counted(rows))


def test_the_sql_twin_reads_the_contract_alike(documents):
    import duckdb

    rows = [(r.doc_id, r.text) for r in documents.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert set(con.execute(sql_twins.SPELLING).fetchall()) == expected(counted(rows))
