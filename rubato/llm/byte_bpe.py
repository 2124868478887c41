"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of code points, code points become classes (with one or two
characters of look-ahead folded in), and a small automaton says at which
characters a piece begins.  The automaton's state at every character is found
by a scan over transition functions, which compose associatively: blocks of
characters are composed side by side, the blocks' functions are chained, and
the blocks are replayed from their now known starts.  No regular expression
runs over the text.  The pieces' bytes go through pair merging behind a cache.

The pieces are those of
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces kept in a worker's cache; beyond it the cache starts anew.
CACHE_PIECES = 1 << 17
#: Longest piece, in bytes, that is merged side by side with others.
SHORT_PIECE = 48
ID = struct.Struct("<I")
#: Code points looked at together; bounds memory.  A longer text is a group of its own.
GROUP_CHARS = 1 << 18
#: Rows of a batch whose texts are held as Python strings at a time.
ROWS_AT_A_TIME = 256
#: Characters per block of the scan.
BLOCK = 64

# Character classes.  RESET stands for the start of a text.
LETTER, NUMBER, OTHER, BLANK_INNER, SPACE_LAST, BLANK_LAST, TWO, THREE, RESET = range(9)
# States: what the piece that the last character belongs to is.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, AFTER_SPACE, CLOSED, ONE_LEFT, TWO_LEFT = range(8)
N_STATES, N_CLASSES = 8, 9


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece begin here) by [state, class]."""
    step = np.zeros((N_STATES, N_CLASSES), np.uint8)
    begins = np.zeros((N_STATES, N_CLASSES), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    for state in range(N_STATES):
        for cls in range(N_CLASSES):
            if cls == RESET:
                to, new = CLOSED, False
            elif state == ONE_LEFT:  # the last letter of 's, 're, ...
                to, new = CLOSED, False
            elif state == TWO_LEFT:
                to, new = ONE_LEFT, False
            elif cls in runs:
                to = runs[cls]
                new = state not in (to, AFTER_SPACE)
            elif cls in (TWO, THREE):  # an apostrophe before s, t, m, d or before re, ve, ll
                if state in (IN_OTHER, AFTER_SPACE):
                    to, new = IN_OTHER, False
                else:
                    to, new = (ONE_LEFT if cls == TWO else TWO_LEFT), True
            elif cls == BLANK_INNER:
                to, new = IN_BLANKS, state != IN_BLANKS
            else:  # the last blank before something else stands alone or, a space, leads it
                to, new = (AFTER_SPACE if cls == SPACE_LAST else CLOSED), True
            step[state, cls], begins[state, cls] = to, new
    return step, begins


STEP, BEGINS = automaton()


def build_classes() -> np.ndarray:
    """Class of every code point without look-ahead; 3 for white space."""
    found = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK_INNER, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            if hi - lo + 1 == len(m[0]):
                found[lo : hi + 1] = cls
            else:  # the run crosses the surrogates
                found[list(map(ord, m[0]))] = cls
    return found


_CLASSES: list[np.ndarray] = []


def char_classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes with look-ahead.  ``first`` are the positions of the RESET marks."""
    if not _CLASSES:
        _CLASSES.append(build_classes())
    cls = _CLASSES[0][points]
    cls[first] = RESET
    n = len(points)
    after, after2 = np.zeros(n, points.dtype), np.zeros(n, points.dtype)
    after[:-1], after2[:-2] = points[1:], points[2:]
    next_cls = np.full(n, RESET, np.uint8)
    next_cls[:-1] = cls[1:]
    blank = cls == BLANK_INNER
    last = blank & (next_cls != BLANK_INNER) & (next_cls != RESET)
    quote = np.flatnonzero((points == ord("'")) & (cls == OTHER))
    cls[last] = np.where(points[last] == ord(" "), SPACE_LAST, BLANK_LAST)
    a, b = after[quote], after2[quote]
    one = (next_cls[quote] == LETTER) & np.isin(a, [ord(c) for c in "stmd"])
    two = (next_cls[quote] == LETTER) & np.isin(a * 256 + b, [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")]) & (b < 128)
    cls[quote[one]] = TWO
    cls[quote[two]] = THREE
    return cls


def scan_states(cls: np.ndarray) -> np.ndarray:
    """State before every character, by composing transition functions."""
    n = len(cls)
    n_blocks = -(-n // BLOCK)
    padded = np.full(n_blocks * BLOCK, RESET, np.uint8)
    padded[:n] = cls
    columns = np.ascontiguousarray(padded.reshape(n_blocks, BLOCK).T)
    flat = STEP.T.reshape(-1)  # index: class * N_STATES + state
    offsets = columns.astype(np.int16) * N_STATES
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.int16), (n_blocks, N_STATES))
    for j in range(BLOCK):  # every block's function, all blocks at once
        maps = flat[offsets[j][:, None] + maps]
    starts = np.empty(n_blocks, np.int16)
    state = CLOSED
    for i, row in enumerate(maps.tolist()):
        starts[i] = state
        state = row[state]
    states = np.empty((BLOCK, n_blocks), np.uint8)
    now = starts
    for j in range(BLOCK):
        states[j] = now
        now = flat[offsets[j] + now].astype(np.int16)
    return states.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, in code points."""
    cls = char_classes(points, first)
    return np.flatnonzero(BEGINS[scan_states(cls), cls])


class Encoder:
    """Ranks, decoding table and a bounded cache of encoded pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left.

        Pairs are kept in a heap over a linked list, so that a piece costs
        n log n.
        """
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        ends = list(range(1, n + 1))  # end of the part that begins here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if not alive[i] or ends[i] != mid or mid >= n or not alive[mid] or ends[mid] != end:
                continue
            alive[mid] = False
            ends[i] = end
            if end < n:
                prev[end] = i
                r = ranks.get(piece[i : ends[end]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end, ends[end]))
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:end])
                if r is not None:
                    heapq.heappush(heap, (r, p, i, end))
        return tuple(ranks[piece[i : ends[i]]] for i in range(n) if alive[i])

    def pair_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of tokens that make a token, as one number each and ascending, the ranks of what they make)."""
        if not hasattr(self, "_pairs"):
            get = self.ranks.get
            found = [(get(t[:i]), get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
            known = np.array([(a << 32 | b, r) for a, b, r in found if a is not None and b is not None], np.int64).reshape(-1, 2)
            self._pairs = tuple(np.ascontiguousarray(c) for c in known[np.argsort(known[:, 0])].T)
        return self._pairs

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` of many short pieces side by side, as packed ids: a round merges one pair of each piece that has one."""
        codes, ranks = self.pair_ranks()
        none = np.int64(1 << 62)

        def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            wanted = left << 32 | right
            at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            return np.where(codes[at] == wanted, ranks[at], none)

        of_byte = np.array([self.ranks[bytes([c])] for c in range(256)], np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        s, owner = of_byte[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), sizes)
        pairs = np.full(len(s), none)  # rank of what a symbol and the next one of its piece make
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs[inner] = rank(s[inner], s[inner + 1])
        done = []
        while len(s):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best, lengths = np.minimum.reduceat(pairs, starts), np.diff(np.r_[starts, len(s)])
            over = best == none
            if over.any():
                ended = np.repeat(over, lengths)
                done.append((owner[ended], s[ended]))
                s, owner, pairs, best, lengths = s[~ended], owner[~ended], pairs[~ended], best[~over], lengths[~over]
                if not len(s):
                    break
            hit = np.flatnonzero(pairs == np.repeat(best, lengths))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]  # the leftmost of each piece
            s[hit] = best
            stays = np.ones(len(s), bool)
            stays[hit + 1] = False
            s, owner, pairs = s[stays], owner[stays], pairs[stays]
            at = hit - np.arange(len(hit))
            pairs[at] = none
            followed = at[(at + 1 < len(s)) & (owner[np.minimum(at + 1, len(s) - 1)] == owner[at])]
            pairs[followed] = rank(s[followed], s[followed + 1])
            led = at[(at > 0) & (owner[at - 1] == owner[at])]
            pairs[led - 1] = rank(s[led - 1], s[led])
        if not done:
            return []
        owner, s = (np.concatenate(x) for x in zip(*done, strict=True))
        packed = s[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def learn(self, pieces: list[bytes]) -> None:
        """Put new pieces into the cache."""
        cache, get, pack = self.cache, self.ranks.get, ID.pack
        short = []
        for p in pieces:
            whole = get(p)
            if whole is not None:
                cache[p] = pack(whole)
            elif len(p) <= SHORT_PIECE:
                short.append(p)
            else:
                cache[p] = np.array(self.merge(p), "<u4").tobytes()
        cache.update(zip(short, self.merge_many(short), strict=True))

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, where each piece's begin and the last ends); the cache is asked once for each distinct piece."""
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn([p for p in distinct if p not in cache])
        found = pa.array(map(cache.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        _, offsets, values = found.buffers()
        at = np.frombuffer(offsets, np.int64, len(found) + 1) // 4
        return np.frombuffer(values, "<u4", int(at[-1])), at

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, byte offset at which each token begins) of every text."""
        points = np.frombuffer("".join("\0" + t for t in texts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(lengths) - lengths
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        width[first] = 0
        at_byte = np.cumsum(width) - width
        starts = piece_starts(points, first)
        raw = "".join(texts).encode()
        cuts = at_byte[starts]
        if not len(cuts):
            return [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * len(texts)
        bounds = np.append(cuts, len(raw)).astype(np.int64)  # a piece ends where the next begins
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        ids, at_piece = self.encode_pieces(pieces)
        sizes = self.sizes()[ids] if len(ids) else np.zeros(0, np.int64)
        offsets = np.cumsum(sizes) - sizes
        upto = at_piece[np.r_[np.searchsorted(starts, first), len(starts)]]
        bytes_before = at_byte[first]
        return [(ids[a:b], offsets[a:b] - o) for a, b, o in zip(upto[:-1].tolist(), upto[1:].tolist(), bytes_before.tolist(), strict=True)]

    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(max(self.tokens) + 1, np.int64)
            for i, t in self.tokens.items():
                self._sizes[i] = len(t)
        return self._sizes

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_all(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes of all ``ids`` in a row, where each one's begin and the last ends)."""
        if not len(ids):
            return memoryview(b""), np.zeros(1, np.int64)
        if not hasattr(self, "_table"):
            self._table = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_binary())
        found = self._table.take(pa.array(ids))
        if found.null_count:
            raise KeyError("an id without a token")
        _, offsets, values = found.buffers()
        return memoryview(values), np.frombuffer(offsets, np.int64, len(found) + 1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``GROUP_CHARS`` code points."""
    group: list[str] = []
    held = 0
    for t in texts:
        if group and held + len(t) > GROUP_CHARS:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of the columns ``keep``, ids and offsets from batches with a text."""
    enc = encoder(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_A_TIME):
            rows = batch.slice(lo, ROWS_AT_A_TIME)
            at = 0
            for group in grouped([t or "" for t in rows.column("text").to_pylist()]):
                found = enc.encode(group)
                bounds = np.r_[0, np.cumsum([len(i) for i, _ in found])].astype(np.int32)
                ids = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([i for i, _ in found]).astype(np.int32)))
                offsets = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([o for _, o in found]).astype(np.int32)))
                part = rows.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), ids, offsets], [*keep, "ids", "offsets"])


def digest_batches(batches: Iterator[pa.RecordBatch], path: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of the columns ``keep``, n_tokens and digests from batches with ids, which are decoded."""
    enc = encoder(path)
    for batch in batches:
        column = batch.column("ids")
        bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        base = int(bounds[0])
        text, at = enc.decode_all(values[base : bounds[-1]])
        n, of_ids, of_bytes = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids = values[a:b]
            n.append(b - a)
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(text[at[a - base] : at[b - base]]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
            [*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
        )


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``ids`` and ``offsets`` of every whole text.

    ``offsets`` holds the byte at which each token begins, so a span of tokens
    maps to a span of bytes of the text.  A null text counts as empty and has
    no ids.  Repeated rows are encoded alike; other columns are ignored, and an
    empty table gives an empty one.  ``path`` names a rank file that every
    executor has.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(lambda b: encode_batches(b, path, keep), f"{schema}, ids array<int>, offsets array<int>")


def decoded_digests(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, the digest of the ids and, after decoding, that of the bytes, from a table with ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep)
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(lambda b: digest_batches(b, path, keep), f"{schema}, {DIGESTS}")


def encoded_digests(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``decoded_digests`` of ``encode_documents``, and the ids if wanted, in one pass and one worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    also = (*keep, "ids") if with_ids else keep
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", ids array<int>" * with_ids
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    return rows.mapInArrow(lambda b: digest_batches(encode_batches(b, path, keep), path, also), f"{schema}, {DIGESTS}")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
