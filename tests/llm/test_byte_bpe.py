from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from rubato.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts() -> list[str]:
    rng = random.Random(3)
    alphabet = "aZ9 '\n\tsdmtrevl.,!éß 　中\U0001f600́ \x1c\x85٠Ⅰ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*texts, "", " ", "  ", "'s're'll", " 's", "a's 're", "x" * 20_000, "ab" * 9_000, " " * 3000 + "x", "中" * 2000, "".join(texts)]


def test_ids_are_the_librarys(library):
    enc = byte_bpe.encoder(PATH)
    texts = random_texts()
    for text, (ids, offsets) in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        raw = text.encode()
        assert enc.decode(ids.tolist()) == raw
        ends = [*offsets.tolist()[1:], len(raw)] if len(ids) else []
        assert [raw[a:b] for a, b in zip(offsets.tolist(), ends, strict=True)] == [enc.tokens[i] for i in ids.tolist()]


def test_scan_equals_the_automaton_step_by_step():
    cls = np.random.default_rng(1).integers(0, byte_bpe.N_CLASSES, 1000).astype(np.uint8)
    state, expected = byte_bpe.CLOSED, []
    for c in cls:
        expected.append(state)
        state = byte_bpe.STEP[state, c]
    assert byte_bpe.scan_states(cls).tolist() == expected


def check(rows, texts, library):
    for r, text in zip(rows, texts, strict=True):
        ids = library.encode_ordinary(text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_query_and_awkward_rows(spark, small_dir, awkward, no_rows, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = byte_bpe.op3_byte_bpe(spark, small_dir).collect()
    check(rows, [texts[r.doc_id] for r in rows], library)
    rows = byte_bpe.decoded_digests(byte_bpe.encode_documents(awkward, keep=("doc_id", "text")), keep=("doc_id", "text")).collect()
    assert len(rows) == awkward.count()
    check(rows, [r.text for r in rows], library)
    assert byte_bpe.decoded_digests(byte_bpe.encode_documents(no_rows)).count() == 0


def test_short_pieces_are_merged_side_by_side():
    """Many pieces at once give what each gives alone, and no piece is merged by a Python loop of its own."""
    enc = byte_bpe.encoder(public_tokenizers.path(byte_bpe.VOCABULARY))
    rng = np.random.default_rng(4)
    pieces = [bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in rng.integers(1, 49, 500)] + [b"\xff\xfe", b"a", " größe".encode(), b"aaaaaaaaaaaaaaaa"]
    found = [tuple(np.frombuffer(x, "<u4").tolist()) for x in enc.merge_many(pieces)]
    assert [(enc.ranks[p],) if p in enc.ranks else ids for p, ids in zip(pieces, found, strict=True)] == [enc.merge(p) for p in pieces]
    assert enc.merge_many([]) == []
    text, at = enc.decode_all(np.array([i for ids in found for i in ids], np.uint32))
    assert bytes(text[: at[-1]]) == b"".join(pieces)
