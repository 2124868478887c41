"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags.  A block
is described by the mean vector of its tag path (element names, class and id
words, hashed), the mean vector of its hashed words and a few numbers.  A
bidirectional LSTM, in numpy, reads the page's whole sequence of blocks in both
directions, so every block is classified with the document around it.  The
network is trained on the pages of ``page_templates`` by back-propagation
through time; the seed is fixed and the result the same in every run.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .page_templates import training_pages

PATH_BUCKETS, WORD_BUCKETS = 1 << 11, 1 << 12
PATH_VECTOR, WORD_VECTOR, HIDDEN, N_STATS = 12, 8, 16, 9
TRAINING_PAGES, EPOCHS, BATCH, RATE, SEED = 800, 7, 32, 0.01, 11
#: Outermost open elements whose names describe a block; deeper ones are followed as well, and their text is read like any other.
DEPTH = 200
#: Longest attributes whose hashes are remembered; longer ones are hashed anew.
REMEMBERED_CHARS = 1 << 10
#: Pages read together, and padded blocks that the network sees at once; bounds of memory.
GROUP_PAGES, GROUP_BLOCKS = 128, 1 << 15

#: Text and the markup after it: a tag whose quoted values, of any length, may hold ">", a comment, a tag cut at the
#: first ">" for want of another, a declaration, or a lone "<" or the end.  A quote opens a value only after "=".
TOKEN = re.compile(
    r"""([^<]*)(?:<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*+(?>"[^"]*"|'[^']*'|)|["'])*+)>|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(<)|\Z)""",
    re.S,
)
#: The same without regard to quotes, for the rest of a page whose quotes leave no ">" open.
UNQUOTED_TOKEN = re.compile(r"""([^<]*)(?:<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)\Z|<[!?/][^>]*(?:>|\Z)|(<)|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME_WORD = re.compile(r"[A-Za-z]+")
#: Scripts, styles, form fields and what stands for another page: their content is never text of the page.
HIDDEN_TAGS = frozenset("script style template title textarea iframe select".split())
#: Elements of other languages: what they hold is inline.  A slash before the ">" ends them, unless it is the end of an unquoted value.
FOREIGN = frozenset(("svg", "math"))
# The tags that end such an element, from the HTML standard's rules for foreign content, and the sectioning ones.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"
    " article aside footer form header html main nav section td th tr".split()
)
UNQUOTED_END = re.compile(r"""=\s*[^\s"'][^\s]*\Z""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of this kind ends where one of its family begins.
FAMILY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Characters that end a sentence.
ENDS = frozenset(".!?…\"”")
CLOSERS = {name: re.compile(rf"</{name}", re.I) for name in HIDDEN_TAGS}


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[int, ...]
    link_chars: int
    depth: int


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_BUCKETS


@lru_cache(4096)
def tag_buckets(tag: str) -> tuple[int, ...]:
    return (bucket(f"<{tag}"),)


@lru_cache(4096)
def element_buckets(tag: str, attrs: str) -> tuple[int, ...]:
    """Hashes of an element's name and of the words of its class, id and role."""
    words = {w.lower() for m in NAMED.finditer(attrs) for w in NAME_WORD.findall(m[1])}
    return (bucket(f"<{tag[:16]}"), *(bucket(f".{w}") for w in sorted(words)))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, white space made single, references decoded."""
    out: list[Block] = []
    # name, path, places of the innermost block-level element and of the innermost one that isn't inline; None once closed
    # below others.  The last one is open; the places of the open ones by name let an end tag find its own at once.
    stack: list[tuple[str, tuple[int, ...], int, int] | None] = []
    places: dict[str, list[int]] = {}
    n_open = 0
    parts: list[str] = []
    links = link_chars = 0
    root = -1  # place of the outermost open element of another language

    def flush() -> None:
        nonlocal link_chars
        joined = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(joined) if "&" in joined else joined).split())
        if text:
            block_tag = stack[stack[-1][2]][0] if stack and stack[-1][2] >= 0 else ""
            out.append(Block(text, (stack[-1][1] if stack else ()) + tag_buckets("leaf " + block_tag[:16]), link_chars, min(n_open, DEPTH)))
        link_chars = 0

    def cut(start: int) -> None:
        """Close all elements from ``start`` on, and drop what was closed before at the end."""
        nonlocal root, n_open
        if root >= start:
            root = -1
        while stack and (len(stack) > start or stack[-1] is None):
            gone = stack.pop()
            if gone:
                places[gone[0]].pop()
                n_open -= 1

    def close(tags: tuple[str, ...]) -> None:
        """End the innermost block-level element if it is one of ``tags``."""
        i = stack[-1][2] if stack else -1
        if i >= 0 and stack[i][0] in tags:
            cut(i)

    def end_tag(tag: str, within: bool) -> None:
        """Close ``tag``; an inline element only within its block, and alone."""
        nonlocal n_open
        own = places.get(tag)
        if not own:
            return
        if not within:
            cut(own[-1])
        elif own[-1] > stack[-1][3]:
            stack[own.pop()] = None
            n_open -= 1
            cut(len(stack))

    at, end = 0, len(page)
    match = TOKEN.match
    while at < end:
        m = match(page, at)
        at = m.end()
        text, shut, tag, attrs, odd_shut, odd_tag, odd_attrs, lone = m.groups()
        if text:
            parts.append(text)
            if links:
                link_chars += len(text)
        if tag is None:
            if lone:
                parts.append(lone)
            if odd_tag is None:
                continue
            shut, tag, attrs = odd_shut, odd_tag, odd_attrs
            match = UNQUOTED_TOKEN.match
        tag = tag.lower()
        if root >= 0 and tag not in HIDDEN_TAGS:
            if shut:
                own = places[tag][-1] if places.get(tag) else -1
                inner = own >= root
                cut(max(own, root))
                if inner:
                    continue
            elif tag in BREAKOUT:
                cut(root)
        inline = root >= 0 or tag in INLINE
        if shut:
            if inline:
                if tag == "a" and links:
                    links -= 1
                end_tag(tag, True)
            else:
                if parts:
                    flush()
                end_tag(tag, False)
                links = 0
            continue
        if tag in HIDDEN_TAGS:
            found = CLOSERS[tag].search(page, at)
            close_at = page.find(">", found.end()) if found else -1
            at = close_at + 1 if close_at >= 0 else end
            continue
        foreign = tag in FOREIGN
        if inline or foreign:
            if tag in VOID:
                if tag != "wbr":
                    parts.append(" ")
                continue
            if tag == "a":
                links += 1
        else:
            if parts:
                flush()
            links = 0
            close(FAMILY.get(tag, ("p",)))
        if tag not in VOID and not (attrs and attrs[-1] == "/" and not (foreign and UNQUOTED_END.search(attrs))):
            if n_open < DEPTH:
                if attrs and "=" in attrs:
                    own = (element_buckets if len(attrs) <= REMEMBERED_CHARS else element_buckets.__wrapped__)(tag, attrs)
                else:
                    own = tag_buckets(tag[:16])
                path = stack[-1][1] + own if stack else own
            else:
                path = stack[-1][1]
            if foreign and root < 0:
                root = len(stack)
            place, block, wall = len(stack), *(stack[-1][2:] if stack else (-1, -1))
            stack.append((tag, path, block if inline or foreign else place, wall if tag in INLINE else place))
            places.setdefault(tag, []).append(place)
            n_open += 1
    flush()
    return out


@dataclass
class Pages:
    """The blocks of several pages, laid end to end."""

    lengths: np.ndarray
    paths: np.ndarray
    path_starts: np.ndarray
    words: np.ndarray
    word_starts: np.ndarray
    stats: np.ndarray

    @classmethod
    def of(cls, pages: list[list[Block]]) -> Pages:
        blocks = [b for p in pages for b in p]
        split = [b.text.lower().encode().split() for b in blocks]
        ints = lambda x: np.array(x, np.int64)
        starts = lambda sizes: np.cumsum(sizes) - sizes
        n_words, n_path = ints([len(w) for w in split]), ints([len(b.path) for b in blocks])
        lengths = ints([len(p) for p in pages])
        chars, counts = ints([len(b.text) for b in blocks]), np.repeat(lengths, lengths)
        at = np.arange(len(blocks)) - np.repeat(starts(lengths), lengths)
        stats = [
            np.log1p(chars) / 7, np.log1p(n_words) / 5, np.minimum(1, ints([b.link_chars for b in blocks]) / np.maximum(chars, 1)),
            np.array([b.text[-1] in ENDS for b in blocks], float), np.minimum(1, ints([b.text.count(",") for b in blocks]) / np.maximum(n_words, 1)),
            np.array(["©" in b.text for b in blocks], float), at / np.maximum(counts, 1), np.log1p(counts) / 5, np.minimum(1, ints([b.depth for b in blocks]) / 10),
        ]
        words = np.fromiter(map(zlib.crc32, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        paths = np.fromiter(chain.from_iterable(b.path for b in blocks), np.int64, int(n_path.sum()))
        return cls(lengths, paths, starts(n_path), words % WORD_BUCKETS, starts(n_words), np.stack(stats, axis=1))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(time, page) of every block."""
        pages = np.repeat(np.arange(len(self.lengths)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        return np.arange(len(pages)) - starts[pages], pages


@dataclass
class Labeller:
    """Parameters; of the LSTMs' four gates in the order input, forget, output, candidate."""

    paths: np.ndarray
    words: np.ndarray
    wx: np.ndarray  # (2, inputs, 4 * hidden): forwards, backwards
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    skip: np.ndarray
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1))


def fresh_labeller() -> Labeller:
    rng = np.random.default_rng(SEED)
    d = PATH_VECTOR + WORD_VECTOR + N_STATS
    b = np.zeros((2, 4 * HIDDEN))
    b[:, HIDDEN : 2 * HIDDEN] = 1
    return Labeller(
        paths=rng.normal(size=(PATH_BUCKETS, PATH_VECTOR)) * 0.1, words=rng.normal(size=(WORD_BUCKETS, WORD_VECTOR)) * 0.01,
        wx=rng.normal(size=(2, d, 4 * HIDDEN)) / np.sqrt(d), wh=rng.normal(size=(2, HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN), b=b,
        out=rng.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN), skip=np.zeros(d),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def segment_means(vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean vector of each segment; every segment has an id."""
    if not len(starts):
        return np.zeros((0, vectors.shape[1]))
    return np.add.reduceat(vectors[ids], starts, axis=0) / np.diff(np.r_[starts, len(ids)])[:, None].astype(vectors.dtype)


def lstm(x: np.ndarray, wh: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states by (time, page) from the inputs' share of the gates; ``keep`` what training needs."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out, kept = np.empty((steps, n, HIDDEN), x.dtype), []
    for t in range(steps):
        z = x[t] + h @ wh
        s = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            kept.append((i, f, o, g, c, tc, h))
        h, c = o * tc, c_new
        out[t] = h
    return out, kept


def lstm_back(dout: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of ``wh``."""
    steps, n, _ = dout.shape
    dx, dwh = np.empty((steps, n, 4 * HIDDEN)), np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, tc, h = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dx[t] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dx, dwh


def forward(m: Labeller, x: Pages, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Probability that each block is main text, and what the backward pass needs."""
    at, page = x.places()
    kind = m.paths.dtype
    inputs = np.concatenate([segment_means(m.paths, x.paths, x.path_starts), segment_means(m.words, x.words, x.word_starts), x.stats.astype(kind)], axis=1)
    steps, n = int(x.lengths.max(initial=0)), len(x.lengths)
    times = (at, x.lengths[page] - 1 - at)  # either direction starts at time 0
    states, kept = [], []
    for d in (0, 1):
        gates = np.zeros((steps, n, 4 * HIDDEN), kind)
        gates[times[d], page] = inputs @ m.wx[d] + m.b[d]
        h, k = lstm(gates, m.wh[d], keep)
        states.append(h[times[d], page])
        kept.append(k)
    h = np.concatenate(states, axis=1)
    p = sigmoid(h @ m.out + inputs @ m.skip + m.bias[0])
    return p, {"inputs": inputs, "h": h, "kept": kept, "times": times, "page": page, "shape": (steps, n)}


def gradients(m: Labeller, x: Pages, y: np.ndarray) -> dict[str, np.ndarray]:
    p, c = forward(m, x, keep=True)
    ds = (p - y) / len(y)
    inputs, steps_n = c["inputs"], c["shape"]
    dh = ds[:, None] * m.out
    dinputs = ds[:, None] * m.skip
    grads = {"out": c["h"].T @ ds, "skip": inputs.T @ ds, "bias": np.array([ds.sum()]), "wx": np.zeros_like(m.wx), "wh": np.zeros_like(m.wh), "b": np.zeros_like(m.b)}
    for d in (0, 1):
        dout = np.zeros((*steps_n, HIDDEN))
        dout[c["times"][d], c["page"]] = dh[:, d * HIDDEN : (d + 1) * HIDDEN]
        dz, grads["wh"][d] = lstm_back(dout, c["kept"][d], m.wh[d])
        dz = dz[c["times"][d], c["page"]]
        grads["wx"][d], grads["b"][d] = inputs.T @ dz, dz.sum(axis=0)
        dinputs += dz @ m.wx[d].T
    for name, ids, starts, lo, hi in (("paths", x.paths, x.path_starts, 0, PATH_VECTOR), ("words", x.words, x.word_starts, PATH_VECTOR, PATH_VECTOR + WORD_VECTOR)):
        sizes = np.diff(np.r_[starts, len(ids)])
        each = np.repeat(dinputs[:, lo:hi] / sizes[:, None], sizes, axis=0)
        grads[name] = np.stack([np.bincount(ids, each[:, j], minlength=len(getattr(m, name))) for j in range(hi - lo)], axis=1)
    return grads


@cache
def trained_labeller() -> Labeller:
    """Train by Adam on made-up pages; the same in every process."""
    m = fresh_labeller()
    data = []
    for site in training_pages(TRAINING_PAGES, SEED):
        blocks = blocks_of(site.html)
        data.append((blocks, [float(b.text in site.main) for b in blocks]))
    rng = np.random.default_rng(SEED)
    names = list(vars(m))
    first = {k: np.zeros_like(getattr(m, k)) for k in names}
    second = {k: np.zeros_like(getattr(m, k)) for k in names}
    step = 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][0]))  # like lengths together
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in rng.permutation(range(0, len(order), BATCH)).tolist():
            part = [data[i] for i in order[lo : lo + BATCH]]
            grads = gradients(m, Pages.of([b for b, _ in part]), np.concatenate([y for _, y in part]))
            step += 1
            for k in names:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                setattr(m, k, getattr(m, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return Labeller(*(getattr(m, k).astype(np.float32) for k in names))


def label_pages(m: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Probabilities of all blocks, pages of like lengths together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        group, order = order[-max(1, GROUP_BLOCKS // longest) :], order[: -max(1, GROUP_BLOCKS // longest)]
        x = Pages.of([pages[i] for i in group])
        p, _ = forward(m, x)
        for i, part in zip(group, np.split(p, np.cumsum(x.lengths)[:-1]), strict=True):
            out[i] = part
    return out


def main_texts(m: Labeller, pages: list[str | None]) -> list[str]:
    blocks = [blocks_of(p or "") for p in pages]
    return ["\n\n".join(b.text for b, p in zip(own, scores, strict=True) if p >= 0.5) for own, scores in zip(blocks, label_pages(m, blocks), strict=True)]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page, from its whole html.

    A null or empty html, and a page without main text, give an empty text.
    Repeated rows are read alike, nulls in page_id and url are kept, and other
    columns are ignored.  An empty table gives an empty result.
    """
    labeller = trained_labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP_PAGES):
                part = batch.slice(lo, GROUP_PAGES)
                texts = main_texts(labeller, part.column("html").to_pylist())
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
