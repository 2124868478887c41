from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from rubato.llm import token_files
from rubato.llm.common import scratch_path
from rubato.llm.token_files import Grammar
from tokenizers import Tokenizer

PATH = public_tokenizers.path(token_files.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_word_encoder_gives_the_librarys_ids(library):
    texts = ["", "Hello, World! don't DON'T 12ab", "<|endoftext|> x<|startoftext|>", "é ÉTÉ İI ſ 　中文 x y", "a\x1cb\x85c d \x00e", "...!!! a.b,c (d) 'tis n't", "\U0001f600\U0001f600 k̈", "A" * 500, "###$$$ word*** 3.14 x_y"]
    for text, ids in zip(texts, token_files.word_encoder(PATH).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    ids = rng.choice([1, 2, 3, 49_000], 20_000, p=[0.6, 0.2, 0.1, 0.1]).astype(np.uint32)
    ends = np.sort(np.r_[rng.integers(0, len(ids), 50), 0, len(ids)])
    grammar = Grammar.from_bytes(Grammar.build(ids, ends, 49_408).to_bytes())
    assert len(grammar.left) and len(grammar.symbols) < len(ids) / 2
    assert grammar.expand(grammar.symbols).tolist() == ids.tolist()
    for i in range(len(ends)):
        assert grammar.document(i).tolist() == ids[ends[i - 1] if i else 0 : ends[i]].tolist()
    for a, b in rng.integers(0, len(ids), (50, 2)):
        assert grammar.span(int(min(a, b)), int(max(a, b))).tolist() == ids[min(a, b) : max(a, b)].tolist()


def brute(rows, library):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_reads_back_what_the_library_encodes(spark, small_dir, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    found = token_files.op5_token_files(spark, small_dir).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == brute(docs, library)


def test_awkward_rows(spark, awkward, no_rows, library):
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(awkward, path)
    found = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert len(found) == awkward.count()
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda x: (x is not None, x))
    want = brute([(r.doc_id, r.text) for r in awkward.collect()], library)
    assert sorted(r.ids_crc32 for r in found) == sorted(w[3] for w in want)
    empty = scratch_path(spark, "tokens")
    token_files.write_token_files(no_rows, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_slices_of_a_large_batch(spark, library):
    rng = np.random.default_rng(4)
    words = ["Plain", "WORDS", "of", "ASCII", "only", "don't", "1234"]
    rows = [(i, " ".join(rng.choice(words + ["été", "Ünïcode", "中文"] * (i % 2), 5).tolist())) for i in range(12_000)]  # over 512 a task
    texts = pa.array([t for _, t in rows])
    for lo in (0, 512, 1536):
        part = texts.slice(lo, 512)
        for text, ids in zip(part.to_pylist(), token_files.word_encoder(PATH).encode(part), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    found = token_files.read_token_files(spark, path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == brute(rows, library)


def test_replacement_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(6)
    phrase = rng.integers(0, 40_000, 3000)
    ids = np.concatenate([phrase] * 40 + [rng.integers(0, 300, 60_000)]).astype(np.uint32)
    ends = np.array([3000 * i for i in range(1, 41)] + [len(ids)])
    grammar = Grammar.build(ids, ends, 49_408)
    assert np.array_equal(grammar.expand(grammar.symbols), ids)
    # whole copies shrink to a symbol each, but for what the random part shares with them
    assert len(grammar.symbols) < 60_000 + 40 * 50
    upto = np.cumsum(np.r_[np.ones(49_408, np.int64), grammar.lengths][grammar.symbols])
    pairs = np.stack([grammar.symbols[:-1], grammar.symbols[1:]], 1)[~np.isin(upto[:-1], ends)]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < token_files.LEAST_COUNT


def test_words_of_ascii_letters_are_learnt_without_the_expression(library):
    class Counted:
        asked = 0

        def fullmatch(self, word: bytes):
            self.asked += 1
            return token_files.WordEncoder.WORD_AND_TAIL.fullmatch(word)

    encoder = token_files.WordEncoder(PATH)
    encoder.WORD_AND_TAIL = Counted()
    text = "plain Words of letters, été plain"
    assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.WORD_AND_TAIL.asked == 2  # "letters," and "été"


def test_pairs_are_found_without_a_search(monkeypatch):
    def search(*_):
        raise AssertionError("a search for each pair")

    monkeypatch.setattr(np, "searchsorted", search)
    ids = np.tile(np.arange(50, dtype=np.uint32), 100)
    grammar = Grammar.build(ids, np.array([len(ids)]), 49_408)
    assert np.array_equal(grammar.expand(grammar.symbols), ids) and len(grammar.symbols) < 500
