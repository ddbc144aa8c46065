"""Token counts, prefix BPE and packed ids against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from goldseam.llm import packed_ids, prefix_bpe, token_counts
from goldseam.llm.pretokens import PreTokenizer

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
library = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in (BYTE, WORD)}

TEXTS = [
    "Is and the of, nterti thorreou.\nWhst  the\tby\r\n and 12345 don't we'll",
    "", " ", "\n\n  \n", "a", "aaaa" * 700, "ab" * 999 + "a", "the" * 1000, "  leading and trailing  ",
    "<|endoftext|>x<|startoftext|> <|endoftext|><|endoftext|", "Ünïcödé “quotes” – dash € ÇA",
    "日本語のテキスト 한국어 русский Ελληνικά ΣΑΣ", "🙂🙂 e\u0301 \u200d \u00a0nbsp\u2028x", "\x00\x01\x7f",
    "İstanbul ſ ß ŉ", "x" * 30_000, "1234567890" * 50, "'s 't 'RE ''s",
]


def library_ids(text, name):
    return library[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_character_classes_agree_with_the_library(name):
    pre = PreTokenizer(name)
    codes = [*range(0x180), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC, *range(0x180, 0x3000, 7)]
    for ch in map(chr, codes):
        text = f"a{ch}a1{ch}1.{ch}. {ch}{ch} x{ch} 's {ch}"
        shown = library[name].normalizer.normalize_str(text) if library[name].normalizer else text
        pieces = [shown[a:b] for _, (a, b) in library[name].pre_tokenizer.pre_tokenize_str(shown)]
        assert pre.split(text) == pieces, hex(ord(ch))


@pytest.mark.parametrize("text", TEXTS)
def test_counts_and_ids_are_those_of_the_library(text):
    assert token_counts.count_tokens([text], BYTE) == [len(library_ids(text, BYTE))]
    ids = library_ids(text, WORD)
    assert prefix_bpe.encode_text(text, WORD) == ids
    assert prefix_bpe.decode_ids(ids, WORD) == library[WORD].decode(ids, skip_special_tokens=False)
    assert packed_ids.encode_ids(text, BYTE).tolist() == library_ids(text, BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aábcde thn's\n1Σ.", max_size=80))
def test_random_texts(text):
    assert token_counts.count_tokens([text], BYTE) == [len(library_ids(text, BYTE))]
    assert prefix_bpe.encode_text(text, WORD) == library_ids(text, WORD)
    assert packed_ids.encode_ids(text, BYTE).tolist() == library_ids(text, BYTE)


def test_merging_many_words_at_once_equals_one_by_one():
    random.seed(5)
    some = ["".join(random.choice("aeinrst h") for _ in range(random.randint(1, 40))) for _ in range(500)]
    some.append("a" * 4001)
    merger = token_counts.RankMerger(BYTE)
    together = merger.count([w.encode() for w in some]).tolist()
    assert together == [int(merger.count([w.encode()])[0]) for w in some]


def _long_words():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "".join(r.choices(letters, k=40_000))
    yield "".join(r.choices("ab", k=20_000))
    yield "".join(r.choices("\u00e9\u00fc\u00df\u00f1", k=5_000))
    yield "".join(r.choices("-=_*", k=20_000))
    yield "".join(r.choices(["the", "ing", "aaa", "xyz", "tion"], k=9_000))
    for run in ("x", "ab", "aab", "="):
        yield run * 5_001
    for length in (511, 512, 513, 576, 577):
        yield "".join(r.choices(letters, k=length))


@pytest.mark.parametrize("word", list(_long_words()), ids=lambda w: f"{w[:4]}-{len(w)}")
def test_long_words_are_counted_from_pieces(word):
    for text in (word, f"a {word} b", word + word):
        assert token_counts.count_tokens([text], BYTE) == [len(library_ids(text, BYTE))]
    assert prefix_bpe.encode_text(word, WORD) == library_ids(word, WORD)


def test_pieces_of_any_length_give_the_same_count(monkeypatch):
    word = b"".join(random.Random(6).choices([b"th", b"e", b"in", b"g", b"qz", b"aa"], k=700))
    merger = token_counts.RankMerger(BYTE)
    whole = merger.count([word])[0]
    for piece in (1, 2, 3, 7, 64, 5000):
        monkeypatch.setattr(token_counts, "PIECE", piece)
        assert merger.count_long(word) == whole


def test_count_rows(spark):
    docs, rows = awkward(spark, TEXTS)
    got = sorted(token_counts.with_token_counts(docs, BYTE, 1024).collect(), key=repr)
    want = sorted(
        [
            (r[0], len((r[1] or "").encode()), len(library_ids(r[1], BYTE)), len(library_ids(r[1], BYTE)) > 1024)
            for r in rows
        ],
        key=lambda x: repr(x),
    )
    assert sorted(map(tuple, got), key=repr) == want
    assert token_counts.with_token_counts(empty(spark), BYTE, 10).collect() == []


def test_encoding_rows(spark):
    docs, rows = awkward(spark, TEXTS)
    got = sorted(map(tuple, prefix_bpe.encoding_digests(docs, WORD).collect()), key=repr)
    want = []
    for r in rows:
        ids = library_ids(r[1], WORD)
        plain = library[WORD].decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), plain)]
        want.append((r[0], len(ids), *sha))
    assert got == sorted(want, key=repr)
    full = prefix_bpe.encoded(docs, WORD).collect()
    assert sorted(len(r.ids) for r in full) == sorted(x[1] for x in want)
    assert prefix_bpe.encoding_digests(empty(spark), WORD).collect() == []


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 31])
def test_bit_fields_round_trip(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1000).astype("<u4")
    packed = packed_ids.pack(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    assert (packed_ids.unpack(packed, width, 0, 1000) == ids).all()
    for start, count in ((0, 1), (3, 5), (999, 1), (500, 0), (13, 987)):
        assert (packed_ids.unpack(packed, width, start, count) == ids[start : start + count]).all()
    with pytest.raises(ValueError):
        packed_ids.pack(np.array([1 << width], np.uint64), width)


def test_packed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed_ids, "BLOCK_IDS", 64)
    docs, rows = awkward(spark, TEXTS)
    path = str(tmp_path / "ids")
    packed_ids.write_packed(docs, path, BYTE, 0, partitions=3)
    got = sorted(packed_ids.read_packed(spark, path).collect(), key=lambda r: r.start)
    want = {}
    for r in rows:
        ids = np.array([*library_ids(r[1], BYTE), 0], "<u4")
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    asked = spark.createDataFrame([(3,), (5,)], "doc_id long")
    found = {r.doc_id: r.ids for r in packed_ids.read_ids(spark, path, asked).collect()}
    assert found == {i: [*library_ids(TEXTS[i], BYTE), 0] for i in (3, 5)}


def test_packed_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    packed_ids.write_packed(empty(spark), path, BYTE, 0)
    assert packed_ids.read_packed(spark, path).collect() == []


def test_packed_ids_keep_frequent_words_when_their_memory_is_full(monkeypatch):
    monkeypatch.setattr(packed_ids, "REMEMBERED_WORDS", 40)
    packed_ids._words.cache_clear()
    asked = []
    make = packed_ids.Words.made
    monkeypatch.setattr(packed_ids.Words, "made", lambda self, words: asked.extend(words) or make(self, words))
    for i in range(200):
        text = f" often again été {'x' * (i % 7)}q{i:x}z <|endoftext|> {i} 日本{chr(0x4E00 + i)}"
        assert packed_ids.encode_ids(text, BYTE).tolist() == library_ids(text, BYTE)
        assert packed_ids.encode_ids(text, WORD).tolist() == library_ids(text, WORD)
    packed_ids._words.cache_clear()
    assert asked.count(" often") == 1 and asked.count("often") == 1
