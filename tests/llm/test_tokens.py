"""BPE and token files against the tokenizers library; Elias-Fano against the plain sequence."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, byte_words, token_files
from tidemark.llm.elias_fano import EliasFano
from tidemark.llm.shingles import Lanes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", None, "it's  a   test\n\n  x <|endoftext|>'s", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa", "日本語 text", "l'eau   ", "\n's", " " * 50, "tab\t\tend\t", "We'll they've I'd 'll 'x'", "😀🏽 é́", "x" * 30000, "a b " * 4000]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strevldmSL  \n\t ,.!09é日")), max_size=20), max_size=4))
def test_word_starts_equal_the_pattern(texts):
    whole = "".join(texts)
    points, bounds = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])
    starts = np.flatnonzero(byte_words.word_starts(points, bounds)).tolist() if len(points) else []
    pattern = regex.compile(byte_words.PATTERN)
    assert [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)], strict=True)] == [w for t in texts for w in pattern.findall(t)] if whole else starts == []


@pytest.mark.parametrize("encoder", [bpe.Encoder(PATH), token_files.LibraryEncoder(PATH)])
def test_encoders_equal_the_library(encoder):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeéß,. \n'0123<|>") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    ids, bounds = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ids_of(t) for t in texts]


MORSE = ["".join(letters[bin(i).count("1") % 2] for i in range(n)) for n in (1024, 2048, 8192) for letters in ("ab", "ba")]


@pytest.mark.parametrize("equal_numbers", [False, True])
@pytest.mark.parametrize("kind", [bpe.Encoder, token_files.LibraryEncoder])
def test_words_with_the_same_letters_keep_their_own_ids(monkeypatch, kind, equal_numbers):
    if equal_numbers:
        monkeypatch.setattr(Lanes, "numbers", lambda self: (self.sizes % 2).astype(np.uint64))
    encoder = kind(PATH)
    for texts in (MORSE, MORSE[::-1], [f"{a} {b} {b}" for a, b in zip(MORSE[::2], MORSE[1::2], strict=True)], ODD, ["abc cba bac", "cba abc"]):
        ids, bounds = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ids_of(t) for t in texts]


def test_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(byte_words, "CACHE_WORDS", 5)
    encoder = bpe.Encoder(PATH)
    for t in ["one two three four", "five six seven eight", "one two three four"]:
        assert encoder.encode([t])[0].tolist() == ids_of(t)


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    for coded in (bpe.decode_column(bpe.encode(df, PATH), PATH), bpe.round_trip(df, PATH)):
        rows = coded.collect()
        assert [r.ids for r in sorted(rows, key=lambda r: r.doc_id)] == [ids_of(t) for t in ODD]
        assert all(r.decoded == LIBRARY.decode(r.ids, skip_special_tokens=False) for r in rows)
    loose = spark.createDataFrame([(1, [10, 200, 50255]), (2, [255, 254]), (3, None), (4, [])], "doc_id long, ids array<int>")
    found = {r.doc_id: r.decoded for r in bpe.decode_column(loose, PATH).collect()}
    assert found == {1: LIBRARY.decode([10, 200, 50255]), 2: LIBRARY.decode([255, 254]), 3: "", 4: ""}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(gaps):
    values = np.cumsum(gaps).astype(np.int64)
    coded = EliasFano.of(values)
    assert [coded.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    assert coded.select(np.arange(len(values))).tolist() == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 600, 8192))
    coded = EliasFano.of(values)
    assert len(coded.low) + len(coded.high) + len(coded.samples) < 8192 * 12 / 8


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    rows = [(i * 37 % 101, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    token_files.write(df, PATH, str(tmp_path / "files"))
    found = sorted(token_files.read(spark, str(tmp_path / "files")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    place = 0
    for r in found:
        assert r.start == place and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        place += r.n_tokens
    assert sorted(r.ids for r in found) == sorted([*ids_of(t), 0] for _, t in rows)
    sums = {(r.start, r.ids_crc32) for r in token_files.read_checksums(spark, str(tmp_path / "files")).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in found}


def test_single_documents_equal_all_of_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    folder = str(tmp_path / "single")
    token_files.write(spark.createDataFrame(list(enumerate([*ODD[:11], "a few words"] * 2)), "doc_id long, text string"), PATH, folder)
    want = [r.ids for r in token_files.read(spark, folder).orderBy("start").collect()]
    blocks = spark.read.parquet(folder).select("shard", "block", "n_docs").orderBy("shard", "block").collect()
    assert [token_files.read_one(spark, folder, b["shard"], b.block, i).tolist() for b in blocks for i in range(b.n_docs)] == want
    with pytest.raises(IndexError):
        token_files.read_one(spark, folder, blocks[0]["shard"], blocks[0].block, blocks[0].n_docs)


def test_documents_are_found_by_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    rows = [*((i * 3, t) for i, t in enumerate([*ODD[:11], "a few words"] * 2)), (9, "twice"), (None, "none"), (0, "zero")]
    folder = str(tmp_path / "by_id")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, folder)
    for doc in (0, 9, 33, 69, 1, 500):
        assert sorted(x.tolist() for x in token_files.read_document(spark, folder, doc)) == sorted([*ids_of(t), 0] for d, t in rows if d == doc)


def test_no_files(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).collect() == []


def test_a_tokenizer_with_other_words(spark, tmp_path):
    other = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(spark.createDataFrame([(1, "Some Words"), (2, None)], "doc_id long, text string"), other, str(tmp_path / "w"))
    found = {r.doc_id: r.ids for r in token_files.read(spark, str(tmp_path / "w")).collect()}
    library = Tokenizer.from_file(other)
    assert found == {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in ((1, "Some Words"), (2, ""))}
