"""Token counts, byte BPE and token records against the libraries."""

import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import byte_bpe, token_count, token_records
from spindrift.llm.common import shared_dir

BYTE, WORD, PIECE = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXT = st.text(st.one_of(st.sampled_from(list("aehilnorst  \n'.,▁éñ0")), st.characters(exclude_categories=["Cs"])), max_size=300)


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_counts_equal_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert token_count.counter(PIECE).count(texts).tolist() == [len(x) for x in sp.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_byte_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(BYTE), byte_bpe.codec(BYTE)
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in ids] == [lib.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ids]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_word_pieces_equal_the_library(texts):
    enc = token_records.encoder(WORD)
    assert enc.encode(texts) == enc.ids(texts)


def test_long_words_without_boundaries(piece):
    texts = ["a" * 5000, "▁" * 700 + "b", "日本語" * 300, "ab" * 2000 + " " + "c" * 999]
    assert token_count.counter(PIECE).count(texts).tolist() == [len(x) for x in piece.encode(texts)]
    own = byte_bpe.codec(BYTE)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


def test_dropping_the_compiled_table_changes_nothing(piece, monkeypatch):
    monkeypatch.setattr(token_count, "MAX_CELLS", 1)
    texts = ["some words to count", "and others again"]
    m = token_count.CountTransducer(PIECE)
    assert [m.count([t])[0] for t in texts * 2] == [len(x) for x in piece.encode(texts * 2)]


def test_count_and_digests_on_odd_rows(spark, documents, clashing, empty, piece):
    for df in (documents, clashing):
        got = token_count.count_tokens(df, PIECE).select("text", "n_tokens").collect()
        assert len(got) == df.count() and all(r.n_tokens == len(piece.encode(r.text or "")) for r in got)
        for r in byte_bpe.round_trip_digests(df, BYTE).collect():
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert token_count.count_tokens(empty, PIECE).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(documents, BYTE), BYTE).filter("decoded <> coalesce(text, '')").count() == 0


def test_records_round_trip(spark, documents, clashing, empty):
    enc = token_records.encoder(WORD)
    for df in (documents, clashing):
        got = token_records.token_records(spark, df, WORD, 2).collect()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
        start, want = 0, []
        for known, d, t in rows:
            ids = [*enc.library.encode(t, add_special_tokens=False).ids, 2]
            want.append((d if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert token_records.token_records(spark, empty, WORD, 2).count() == 0


def test_offset_index_serves_shuffled_reads_and_damage_is_seen(spark, documents, tmp_path):
    folder = shared_dir(spark, "records-test")
    index = token_records.write_records(documents, WORD, 2, folder)
    some = index.orderBy("n_tokens").limit(4)
    enc = token_records.encoder(WORD)
    texts = {r.doc_id: r.text for r in documents.filter("doc_id is not null").collect()}
    for r in token_records.read_at(some, folder).collect():
        if r.doc_id is not None:
            assert r.token_ids == [*enc.library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
    good = token_records.frame([b"0123456789abc"])[0]
    assert token_records.unframe([good]) == [b"0123456789abc"]
    for i in range(len(good)):
        with pytest.raises(ValueError):
            token_records.unframe([good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]])


def test_crc32c_known_value():
    c = 0xE3069283  # CRC-32C of "123456789"
    assert token_records.masked_crc32c([b"123456789"])[0] == (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def mixed_scripts(n, seed=3):
    r = np.random.default_rng(seed)
    spans = [(0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x61, 0x7A), (0x400, 0x4FF), (0x1F300, 0x1F600)]
    lows, highs = np.array(spans).T
    k = r.integers(0, len(spans), n)
    return "".join(map(chr, r.integers(lows[k], highs[k])))


def test_many_distinct_characters_in_bounded_memory(piece, monkeypatch):
    """Characters outside the vocabulary share classes; the table is dropped in the middle of a run and the counts stay right."""
    texts = [mixed_scripts(60_000), mixed_scripts(3000, 4) + " a word", "the end"]
    want = [len(x) for x in piece.encode(texts)]
    own = token_count.CountTransducer(PIECE)
    assert own.count(texts).tolist() == want
    assert own.table.nbytes <= 8 * token_count.MAX_CELLS and len(own.far) <= token_count.MAX_FAR + 20_000
    monkeypatch.setattr(token_count, "MAX_CELLS", 3000 * 64)
    monkeypatch.setattr(token_count, "MAX_FAR", 3000)
    own = token_count.CountTransducer(PIECE)
    assert own.count(texts).tolist() == want and own.count(texts[::-1]).tolist() == want[::-1]
    assert len(own.table) <= 40_000


def test_long_texts_without_a_word_start(piece, monkeypatch):
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("aeinstrhd"), 30_000)), "a" * 20_001, "ab" * 9000, "x", "日本語の文" * 3000, "no " * 500]
    want = [len(x) for x in piece.encode(texts)]
    assert token_count.CountTransducer(PIECE).count(texts).tolist() == want
    monkeypatch.setattr(token_count, "RUN_UP", 1)  # bad guesses only cost rounds
    monkeypatch.setattr(token_count, "LANE", 16)
    assert token_count.CountTransducer(PIECE).count(texts).tolist() == want


def test_letters_whose_small_form_is_beyond_the_spelt_classes():
    """Such letters (U+0181 becomes U+0253) were cut as signs, apart from the letters around them."""
    path = P.path("word_bpe_49k.json")
    texts = [f"x{chr(i)}y {chr(i)}'s" for i in range(0x250)]
    enc = token_records.WordEncoder(path)
    assert enc.encode(texts) == enc.ids(texts)


def test_a_word_is_looked_up_once_a_chunk():
    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    enc = token_records.WordEncoder(P.path("word_bpe_49k.json"))
    enc.words = Counted()
    texts = ["red  green\n it's " * 500, "", " green"]
    assert enc.encode(texts) == enc.ids(texts)
    assert Counted.asked <= 4  # and the empty word before a leading space


def test_the_byte_codec_keeps_no_second_vocabulary():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, library = byte_bpe.SpeculativeBPE(path), Tokenizer.from_file(path)
    assert not any(isinstance(v, Tokenizer) for v in vars(own).values()) and all(type(k) is int for k in own.merge)
    texts = ["abcabcab" * 30 + "x", "undergroundings" * 9, "中文 " * 40]  # merged by the heap; other scripts
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
