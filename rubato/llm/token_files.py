"""Binary token files compressed by Re-Pair.

Documents are encoded, put in ascending doc_id order and cut into blocks of
about ``BLOCK_IDS`` ids.  Within a block, frequent pairs of neighbouring ids
are replaced by nonterminals again and again; a pair never crosses the end of
a document.  A block stores the rules, every rule's expansion length and each
document's end, so any span of ids can be decoded without the rest.

A block is one binary value.  The values are rows of a Parquet table, which
Spark's committer writes to whatever store the path names.  Layout, little
endian: ``RPR1``; counts of documents, rules, symbols and ids (4 x uint64); the
vocabulary size (uint32); the width of a symbol, 2 or 4 bytes (uint32); ends of
the documents in ids (uint64 each); left and right sides and expansion lengths
of the rules (uint32 each); the symbols.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import scratch_path, shuffle_partitions, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 20
#: Files per shuffle partition of the session.
SHARDS_PER_PARTITION = 4
#: Words kept in a worker's cache; beyond it the cache starts anew.
CACHE_WORDS = 1 << 20
#: Bytes of text whose words are looked up together; bounds memory.  A longer text is a slice of its own.
SLICE_BYTES = 1 << 22
#: Pairs replaced in a round, the most frequent first, and the least count that pays.
PAIRS_A_ROUND, LEAST_COUNT = 2048, 16
HEAD = struct.Struct("<4s4Q2I")


class WordEncoder:
    """The library's ids of a text, encoded word by word behind a cache.

    The tokenizer never merges across white space and normalises character by
    character, so a text's ids are those of its words in a row.  It lowers
    case, so ASCII letters are lowered first, except where that could touch a
    special token's name or a letter that composes with a combining mark.  A
    word of letters and a tail of ASCII marks is two pieces to it as well.
    """

    #: Small letters of ASCII and Latin-1: they stay as they are and make one piece.
    WORD_AND_TAIL = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([^a-z0-9A-Z\x80-\xff']*)")
    UNSAFE = (b"<|", b"\xcc", b"\xcd")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.cache: dict[bytes, bytes] = {}
        self.is_end = np.zeros(self.vocabulary, bool)
        self.is_end[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def learn(self, words: list[bytes]) -> None:
        """Put new words, each given once, and their parts into the cache."""
        cache, cut_at = self.cache, self.WORD_AND_TAIL.fullmatch
        plain, others, cut = [], set(), []
        for w in words:
            if w.isalpha() and w.islower():  # ASCII letters, which need no expression
                plain.append(w)
                continue
            m = cut_at(w)
            if m is None or b"<|" in m[2]:
                others.add(w)
            elif m[2]:
                cut.append((w, *m.groups()))
            else:
                plain.append(w)
        heads = {a for _, a, _ in cut}.difference(cache)
        plain += heads.difference(words)
        others.update({b for _, _, b in cut}.difference(cache))
        for lo in range(0, len(plain), 8192):  # one piece each, which its last token tells, so they can go in one call
            part = plain[lo : lo + 8192]
            found = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = ((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()
            raw, at = ids.tobytes(), 0
            for p, end in zip(part, ends, strict=True):
                cache[p] = raw[at:end]
                at = end
        rest = list(others)
        found = self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)
        cache.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rest, found, strict=True))
        cache.update((w, cache[a] + cache[b]) for w, a, b in cut)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; words are told apart by Arrow, so the cache is asked once for each distinct word."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        # copied first: pyarrow's ascii_lower reads beside the slice in an array that is a slice and then cast
        whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
        raw = whole.cast(pa.large_binary())
        unsafe = reduce(pc.or_, [pc.match_substring(raw, x) for x in self.UNSAFE])
        words = pc.ascii_split_whitespace(pc.if_else(unsafe, whole, pc.ascii_lower(whole)))
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return [np.zeros(0, "<u4")] * len(texts)
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        known = list(map(self.cache.get, distinct))
        missing = [i for i, ids in enumerate(known) if ids is None]
        if missing:
            new = [distinct[i] for i in missing]
            self.learn(new)
            for i, w in zip(missing, new, strict=True):
                known[i] = self.cache[w]
        found = pa.array(known, pa.large_binary()).take(coded.indices)
        _, offsets, values = found.buffers()
        at = np.frombuffer(offsets, np.int64, len(found) + 1) // 4
        ids = np.frombuffer(values, "<u4", int(at[-1]))
        ends = at[np.cumsum(pc.list_value_length(words).to_numpy())].tolist()
        return [ids[lo:hi] for lo, hi in zip([0, *ends], ends)]  # noqa: B905


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of about ``SLICE_BYTES``; more texts at a time have fewer distinct words each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(upto):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE_BYTES)))
        yield lo, hi - lo
        lo = hi


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def frequent_pairs(codes: np.ndarray) -> tuple[np.ndarray, bool]:
    """The pair codes to replace next, ascending, and whether these are all that pay."""
    ordered = np.sort(codes)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(ordered)])
    best = np.flatnonzero(counts >= LEAST_COUNT)
    whole = len(best) <= PAIRS_A_ROUND
    if not whole:
        best = best[np.argsort(-counts[best], kind="stable")[:PAIRS_A_ROUND]]
    return np.sort(ordered[starts[best]]), whole


@dataclass
class Grammar:
    """A block: ``symbols`` below ``vocabulary`` are ids, those above are rules."""

    vocabulary: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    ends: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> Grammar:
        """Replace pairs round by round until no pair is left that pays."""
        s = ids.astype(np.uint32)
        last = np.zeros(len(s), bool)
        last[ends[np.diff(np.r_[0, ends]) > 0] - 1] = True
        lefts, rights = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        lengths = np.ones(vocabulary, np.uint32)
        # a round that replaces all pairs that pay leaves none of two symbols older than itself
        older = 0
        while len(s) > 1:
            # two symbols make one number, of 32 bits where all symbols stay below 2**16
            half = 16 if len(lengths) + PAIRS_A_ROUND <= 1 << 16 else 32
            kind = np.uint32 if half == 16 else np.uint64
            open_ = ~last[:-1]
            if older:
                fresh = s >= older
                open_ &= fresh[:-1] | fresh[1:]
            at = np.flatnonzero(open_)
            codes = s[at].astype(kind) << kind(half) | s[at + 1]
            chosen, whole = frequent_pairs(codes)
            if not len(chosen):
                break
            older = len(lengths) if whole else older
            a, b = (chosen >> kind(half)).astype(np.uint32), (chosen & kind((1 << half) - 1)).astype(np.uint32)
            # the chosen pairs' symbols are numbered on either side from 1, so that a small table tells a pair's number
            (of_a, rows), (of_b, columns) = (np.unique(x, return_inverse=True) for x in (a, b))
            row, column = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
            row[of_a], column[of_b] = np.arange(1, len(of_a) + 1), np.arange(1, len(of_b) + 1)
            number = np.full((len(of_a) + 1) * (len(of_b) + 1), -1, np.int16)
            number[(rows + 1) * (len(of_b) + 1) + columns + 1] = np.arange(len(chosen))
            which = number[row[s[at]] * np.int32(len(of_b) + 1) + column[s[at + 1]]]
            same = np.flatnonzero(which >= 0)
            hit, which = at[same], which[same].astype(np.uint32)
            # of overlapping pairs in a row, every second one is replaced
            starts = np.r_[True, np.diff(hit) > 1]
            first = hit[np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))]
            take = (hit - first) % 2 == 0
            hit, which = hit[take], which[take]
            s[hit] = np.uint32(len(lengths)) + which
            last[hit] = last[hit + 1]
            keep = np.ones(len(s), bool)
            keep[hit + 1] = False
            s, last = s[keep], last[keep]
            lefts.append(a)
            rights.append(b)
            lengths = np.r_[lengths, lengths[a] + lengths[b]]
        left, right = np.concatenate(lefts), np.concatenate(rights)
        return cls(vocabulary, left, right, lengths[vocabulary:], s, ends.astype(np.uint64))

    def to_bytes(self) -> bytes:
        width = 2 if self.vocabulary + len(self.left) <= 1 << 16 else 4
        total = int(self.ends[-1]) if len(self.ends) else 0
        head = HEAD.pack(b"RPR1", len(self.ends), len(self.left), len(self.symbols), total, self.vocabulary, width)
        parts = [self.ends.astype("<u8"), *(x.astype("<u4") for x in (self.left, self.right, self.lengths)), self.symbols.astype(f"<u{width}")]
        return head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Grammar:
        magic, docs, rules, symbols, _, vocabulary, width = HEAD.unpack_from(raw)
        if magic != b"RPR1":
            raise ValueError("not a token block")
        at = HEAD.size
        out = []
        for kind, n in (("<u8", docs), ("<u4", rules), ("<u4", rules), ("<u4", rules), (f"<u{width}", symbols)):
            out.append(np.frombuffer(raw, kind, n, at))
            at += out[-1].nbytes
        ends, left, right, lengths, s = out
        return cls(vocabulary, left, right, lengths, s.astype(np.uint32), ends)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that ``symbols`` stand for: lengths tell where each begins, and rules are opened level by level."""
        sizes = np.r_[np.ones(self.vocabulary, np.int64), self.lengths]
        s = symbols.astype(np.int64)
        ends = np.cumsum(sizes[s])
        at = ends - sizes[s]
        out = np.empty(int(ends[-1]) if len(s) else 0, np.uint32)
        while len(s):
            rule = s >= self.vocabulary
            out[at[~rule]] = s[~rule]
            at, r = at[rule], s[rule] - self.vocabulary
            left = self.left[r].astype(np.int64)
            s, at = np.concatenate([left, self.right[r]]), np.concatenate([at, at + sizes[left]])
        return out

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: only the symbols that cover them are expanded."""
        if not hasattr(self, "_upto"):
            sizes = np.r_[np.ones(self.vocabulary, np.uint32), self.lengths][self.symbols]
            self._upto = np.cumsum(sizes, dtype=np.int64)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self._upto, start, "right"))
        b = int(np.searchsorted(self._upto, stop, "left")) + 1
        before = int(self._upto[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


BLOCK_SCHEMA = "shard int, block int, n_docs long, n_ids long, doc_ids array<bigint>, payload binary"


def write_token_files(docs: DataFrame, to: str, path: str | None = None) -> None:
    """Encode all documents and write their blocks to the table ``to``.

    Rows are in ascending doc_id order, null first, equal ids in the order of
    their input partitions and texts; a row's input partition also splits an id
    that very many rows share over several shards.  A null text counts as
    empty; it still has its end id.  Columns besides doc_id and text are
    ignored, and an empty input writes an empty table.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    n = shuffle_partitions(docs.sparkSession) * SHARDS_PER_PARTITION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(path)
        shard = TaskContext.get().partitionId()
        block = 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
            raw = Grammar.build(np.concatenate(ids), ends, enc.vocabulary).to_bytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                    pa.array([int(ends[-1])], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([raw], pa.binary()),
                ],
                ["shard", "block", "n_docs", "n_ids", "doc_ids", "payload"],
            )

        end = np.array([END_ID], "<u4")
        for batch in batches:
            for lo, rows in text_slices(batch.column("text")):
                part = batch.slice(lo, rows)
                found = enc.encode(part.column("text"))
                for doc, own in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    ids.append(np.concatenate([own, end]))
                    doc_ids.append(doc)
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield flush()
                        block, held, ids, doc_ids = block + 1, 0, [], []
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("_part"))
    ordered = rows.repartitionByRange(n, "doc_id", "_part").sortWithinPartitions("doc_id", "_part", "text")
    ordered.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA).write.parquet(to)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, shard, block, ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar.from_bytes(row["payload"])
                ids = grammar.expand(grammar.symbols).astype("<u4")
                ends = grammar.ends.astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64()),
                    ],
                    ["shard", "block", "doc_id", "in_block", "n_tokens", "ids_crc32"],
                )

    docs = blocks.select("shard", "block", "doc_ids", "payload").mapInArrow(
        run, "shard int, block int, doc_id long, in_block long, n_tokens long, ids_crc32 long"
    )
    # one row per shard, and the shards are SHARDS_PER_PARTITION times the shuffle partitions at most
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_in_shard")).join(shards, "shard")
    start = F.col("_before") + F.col("_in_shard") + F.col("in_block")
    return docs.join(starts, ["shard", "block"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
