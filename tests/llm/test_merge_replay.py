"""Merge replay against the library of the rank files."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import merge_replay, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(st.one_of(st.sampled_from(list("aaehilnorst  \n'.,éñ0日й")), st.characters(exclude_categories=["Cs"])), max_size=300)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=5))
def test_equals_the_library(library, texts):
    own = merge_replay.codec(PATH, P.PATTERN)
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(x).decode() for x in ids] == texts


def test_random_words_in_one_replay(library):
    """Thousands of words share the index; pairs of better rank than their parts are common among them."""
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("aeinstrhd"), size=r.integers(1, 40))) for _ in range(8000)]
    own = merge_replay.MergeReplay(PATH, P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.replay([w.encode() for w in words if w.encode() not in own.ids])] == [library.encode_ordinary(w) for w in words if w.encode() not in own.ids]


@pytest.mark.parametrize("word", ["a" * 20001, "ab" * 9000, " " * 9000 + "x", "the" * 7000, "日本語" * 3000, "aab" * 5000])
def test_long_words(library, word):
    own = merge_replay.codec(PATH, P.PATTERN)
    assert np.frombuffer(own.encode([word])[0], "<u4").tolist() == library.encode_ordinary(word)


def test_worse_whole_than_part():
    """Ranks where a pair made late merges early: the waiting positions of a word must let the better pair go first."""
    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"ab", b"abab"]
    import os
    import tempfile

    import tiktoken

    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken", delete=False) as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = merge_replay.MergeReplay(f.name, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    words = ["abab", "ababab", "babababab", "ab" * 40, "ab" * 7 + "c" + "ab" * 30, "aabb"]
    assert own.early.any() and [np.frombuffer(x, "<u4").tolist() for x in own.encode(words)] == [lib.encode_ordinary(w) for w in words]
    os.unlink(f.name)


def test_characters_of_every_class():
    s = merge_replay.Splitter(P.PATTERN)
    assert [s.plain(c) for c in ("ж", "語", "٣", "\u3000", "🙂", "\u2028")] == ["é", "é", "5", "\xa0", "!", "\xa0"]
    assert [s.probe(c) for c in ("ж", "٣", "\u3000", "🙂")] == ["é", "5", "\xa0", "!"]
    assert s.split("ab 日本٣\u3000🙂\u3000語") == ["ab", " 日本", "٣", "\u3000", "🙂", "\u3000", "語"]


def test_odd_rows(spark, documents, clashing, empty, library):
    for df in (documents, clashing):
        got = merge_replay.round_trip_digests(df, PATH, P.PATTERN)
        assert set(got.columns) == {*df.columns, "n_tokens", "ids_sha256", "decoded_sha256"}
        rows = got.collect()
        assert len(rows) == df.count()
        for r in rows:
            ids = library.encode_ordinary(r.text or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert merge_replay.round_trip_digests(empty, PATH, P.PATTERN).count() == 0
    back = merge_replay.decode(merge_replay.encode(documents, PATH, P.PATTERN), PATH, P.PATTERN)
    assert back.filter("cast(decoded as string) <> coalesce(text, '')").count() == 0


def test_query_equals_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op11_merge_replay(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
