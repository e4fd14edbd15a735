"""Language-model scores from a log-frequency Bloom filter.

Tokens are a text's words (see kernels), then one end. Training rows are those whose crc32(doc_id as
text) modulo `folds` is not `held`. Counts of all their tokens and bigrams are quantised on a logarithmic
scale, level = 1 + floor(log(count) / log(BASE)), and for each level up to its own an n-gram is put into
a Bloom filter. A count comes back by membership probes for level 1, 2, ... until one fails, so it is
never too low by more than the quantisation, and too high only by a false positive (HASHES hash functions:
about one in 2**HASHES probes).

P(w | v) = (b(v, w) + K * P1(w)) / (c(v) + K),   P1(w) = (t(w) + 1) / (N + V + 1).

N counts the training tokens, V the different ones, c(v) the tokens that follow v (the count of v itself; a
text's start counts as often as there are texts). b and t are the filter's counts, scaled so that no mass is
lost or gained by quantising: within a fragment of the hash space, t sums to the exact count of the fragment's
tokens, and b to the exact count of the tokens that follow v and fall into it. So P sums to 1 over the known
words and one unknown word, for every v (contexts that agree in their upper 24 bits are scaled together). K, the weight of the lower order, is set so that over all training
tokens it takes the Good-Turing mass of unseen bigrams, the share of bigrams seen once.

The filter grows with the corpus, so it is not broadcast: each of its slices is made and probed in the task of
its fragment, and n-grams travel instead. Plan:

1. Each window of texts sends its distinct tokens and bigrams, with their training counts, to fragments
   of the hash space: one entry a window for an n-gram, however frequent or common to documents it is.
2. A fragment adds up the counts, makes its slice of the filter, probes it for all n-grams that came, and
   answers each window with counts in the order in which it asked.
3. Answers and texts meet by window, and each text's scores are summed from its tokens. A text longer
   than a window is cut between words; its windows are read one after the other.

Steps 1 and 3 read the rows twice and must see them in the same order, which a digest of each window checks;
input that comes from a shuffle is therefore written once to the shared folder. Memory of a task is that
of one window or one fragment. What reaches the driver are sums (a row for each of 100 levels).

Null text is empty: one token, the end. A null doc_id is a training row. Repeated rows count as often
as they occur. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kernels import SPACE, U, mix, raw, slices, text_column, word_hashes
from tidemill.llm.session import cut, read_alike

END, START = U(0x1D8AF066E4C3B2A5), U(0x7A5662C14DE0F93B)
#: Base of the quantised counts, hash functions of the filter, bits for each event (a share of 1/2 set).
BASE, HASHES = 1.5, 24
BITS = HASHES / np.log(2)
LEVELS = 100
#: Bytes of text in a window, and texts in it at most.
WINDOW_BYTES, WINDOW_DOCS = 6 << 20, 50_000
#: Text for each token fragment, bigram fragment, and task of the last step; tasks of the fragments at most.
TOKEN_FRAGMENT, BIGRAM_FRAGMENT, HOME_BYTES, TASKS = 48 << 20, 12 << 20, 16 << 20, 20_000


def representative_counts() -> np.ndarray:
    """The mean whole count of each level; 0 for level 0."""
    out = np.zeros(LEVELS + 1)
    for level in range(1, LEVELS + 1):
        low, high = BASE ** (level - 1), BASE**level
        first, last = int(np.ceil(low - 1e-9)), int(np.ceil(high - 1e-9)) - 1
        out[level] = (first + last) / 2 if last >= first else low
    return out


COUNTS = representative_counts()


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64) + 1)


def _places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), 21)
    return h & U(0xFFFFFFFF), (h >> U(32)) | U(1)


def _spot(at: np.ndarray, step: np.ndarray, k: int, size: np.uint64) -> np.ndarray:
    """The k-th bit of a key in an array of `size` (below 2**32) bits."""
    return ((at + U(k) * step & U(0xFFFFFFFF)) * size >> U(32)).astype(np.int64)


class Slice:
    """A slice of the log-frequency filter: each key stands in it at every level up to that of its count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        top = levels_of(counts)
        self.top = int(top.max(initial=0))
        self.size = U(max(64, int(np.ceil(int(top.sum()) * BITS))))
        bits = np.zeros(-(-int(self.size) // 8) * 8, bool)
        for level in range(1, self.top + 1):
            at, step = _places(keys[top >= level], level)
            for k in range(HASHES):
                bits[_spot(at, step, k, self.size)] = True
        self.packed = np.packbits(bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level up to which all probes succeed, for each key; 0 if none does."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for level in range(1, self.top + 1):
            if not len(alive):
                break
            at, step = _places(keys[alive], level)
            for k in range(HASHES):
                spot = _spot(at, step, k, self.size)
                hit = np.flatnonzero(self.packed[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1)
                if len(hit) < len(alive):
                    alive, at, step = alive[hit], at[hit], step[hit]
            out[alive] = level
        return out


class Window(NamedTuple):
    """Consecutive rows, or a part of one long text. home: the number of the window in which the first row begins."""

    home: int
    number: int
    rows: pa.RecordBatch  # doc, version, text
    before: int  # hash of the token before the first text
    last: bool  # whether the texts end here

    @property
    def texts(self) -> pa.Array:
        return text_column(self.rows)

    def mark(self) -> int:
        """A digest of what is in the window and in which order."""
        versions, sizes = self.rows.column("version").to_numpy(), np.diff(raw(self.texts)[1])
        return zlib.crc32(sizes.tobytes(), zlib.crc32(np.ascontiguousarray(versions).tobytes()))


def _long_text(row: pa.RecordBatch, home: int, limit: int) -> Iterator[Window]:
    data, _ = raw(text_column(row))
    at, number, before = 0, home, int(START)
    while True:
        to = at + limit
        while to < len(data) and not SPACE[data[to]]:
            blanks = np.flatnonzero(SPACE[data[to : to + limit]])
            to += int(blanks[0]) if len(blanks) else limit
        last = to >= len(data)
        text = pa.array([data[at:to].tobytes()], pa.binary()).cast(pa.string())
        part = pa.RecordBatch.from_arrays([row.column("doc"), row.column("version"), text], names=["doc", "version", "text"])
        yield Window(home, number, part, before, last)
        if last:
            return
        words, _ = word_hashes(text)
        before = int(words[-1]) if len(words) else before
        at, number = to, number + 1


def windows(batches: Iterator[pa.RecordBatch], first: int = 0, limit: int = WINDOW_BYTES) -> Iterator[Window]:
    """The rows (doc, version, text) in windows of about `limit` bytes; first: number of the first window."""
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def joined() -> Window:
        table = pa.Table.from_batches(held).combine_chunks()
        return Window(first, first, table.to_batches()[0], int(START), True)

    for b in slices(batches, "text", limit):
        own = int(np.diff(raw(text_column(b))[1]).sum())
        if held and (size + own > limit or rows + b.num_rows > WINDOW_DOCS):
            yield joined()
            first, held, size, rows = first + 1, [], 0, 0
        if own > limit:
            for w in _long_text(b, first, limit):
                yield w
                first = w.number + 1
            continue
        held.append(b)
        size, rows = size + own, rows + b.num_rows
    if held:
        yield joined()


def tokens(w: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end for each text, hashes of the tokens before them, tokens of each text)."""
    words, counts = word_hashes(w.texts)
    sizes = counts + w.last
    if w.last:
        last = np.cumsum(sizes) - 1
        out = np.full(int(sizes.sum()), END)
        is_word = np.ones(len(out), bool)
        is_word[last] = False
        out[is_word] = words
    else:
        out = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    if len(out):
        before[0] = U(w.before)
    return out, before, sizes


def is_held_out(doc: int | None, folds: int, held: int) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == held


def bigram_hashes(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(before * U(0xC2B2AE3D27D4EB4F) + words, 13)


def fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashes >> U(32)) * U(fragments) >> U(32)).astype(np.int64)


def _distinct(hashes: np.ndarray, train: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, how often each stands in training rows, for each the value of other)."""
    uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return uniq, np.bincount(inverse, weights=train, minlength=len(uniq)).astype(np.int64), uniq if other is None else other[first]


def _with_contexts(w: Window, words: np.ndarray) -> np.ndarray:
    """The tokens, then the contexts whose counts the window needs besides them: the end, which stands for a start, and what stands before the first text."""
    return np.concatenate([words, np.array([END] if w.before == int(START) else [END, U(w.before)], U)])


#: Bytes of a token's key, its whole hash, and of a bigram's within its fragment; half of the bigram's bits are its context's.
TOKEN_KEY, BIGRAM_KEY = 8, 6


def _bigram_keys(h: np.ndarray, context: np.ndarray) -> np.ndarray:
    half = U(4 * BIGRAM_KEY)
    return (context >> (U(64) - half) << half) | (h & ((U(1) << half) - U(1)))


def _packed(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The keys' low bytes, their counts in one byte each, and those from 255 on in full."""
    low = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<II", len(keys), width) + low.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpacked(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<II", blob)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :width] = np.frombuffer(blob, np.uint8, n * width, 8).reshape(-1, width)
    counts = np.frombuffer(blob, np.uint8, n, 8 + n * width).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(blob, "<i8", int(large.sum()), 8 + n * (width + 1))
    return keys.view("<u8").ravel(), counts


def _squeezed(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _spread(blob: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


_ASKED = "part int, home long, number long, mark long, entries binary"


def asked(w: Window, fragments: tuple[int, int], folds: int, held: int) -> pa.RecordBatch:
    """What a window sends to the token fragments (the first ones) and to the bigram fragments."""
    words, before, sizes = tokens(w)
    train = np.repeat([not is_held_out(d, folds, held) for d in w.rows.column("doc").to_pylist()], sizes).astype(np.int64)
    parts, blobs = [], []
    h, both, context = _distinct(bigram_hashes(words, before), train, before)
    keys = _bigram_keys(h, context)
    all_words = _with_contexts(w, words)
    uniq, single, _ = _distinct(all_words, np.pad(train, (0, len(all_words) - len(train))))
    for first, place, shown, counts, width in ((0, fragment_of(uniq, fragments[0]), uniq, single, TOKEN_KEY), (fragments[0], fragment_of(h, fragments[1]), keys, both, BIGRAM_KEY)):
        there, begin = np.unique(place, return_index=True)
        for f, s, e in zip(there.tolist(), begin.tolist(), [*begin[1:].tolist(), len(place)], strict=True):
            parts.append(first + f)
            blobs.append(_packed(shown[s:e], counts[s:e], width))
    same = [pa.array([x] * len(parts), pa.int64()) for x in (w.home, w.number, w.mark())]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *same, pa.array(blobs, pa.binary())], names=["part", "home", "number", "mark", "entries"])


def _first_window() -> int:
    return TaskContext.get().partitionId() << 32


def _ask(fragments: tuple[int, int], folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in windows(batches, _first_window()):
            yield asked(w, fragments, folds, held)

    return run


#: what = 0: an answer to a window; 1 and 2: sums of a token or bigram fragment; 3: tokens by the level of their count.
_ANSWER = "what int, home long, number long, part int, mark long, n long, total long, once long, a binary, b binary"
_NAMES = ["what", "home", "number", "part", "mark", "n", "total", "once", "a", "b"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=_NAMES)


def _scaled(counts: np.ndarray, quantised: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """quantised times the factor by which each class (ascending numbers) keeps its exact sum; 0 in a class without counts."""
    begin = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    exact = np.add.reduceat(counts, begin)
    seen = np.add.reduceat(np.where(counts > 0, quantised, 0), begin)
    return quantised * np.repeat(exact / np.maximum(seen, 1e-9), np.diff(np.append(begin, len(counts))))


def answers(part: int, questions: list[tuple[int, int, int, pa.Buffer]], token_fragments: int) -> Iterator[pa.RecordBatch]:
    """A fragment's answers to (home, number, mark, entries), and its sums."""
    read = [_unpacked(q[3]) for q in questions]
    keys, inverse = np.unique(np.concatenate([k for k, _ in read]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([c for _, c in read]), minlength=len(keys)).astype(np.int64)
    seen = counts > 0
    level = Slice(keys[seen], counts[seen]).levels(keys)
    single = part < token_fragments
    scaled = _scaled(counts, COUNTS[level], np.zeros(len(keys), np.int64) if single else keys >> U(4 * BIGRAM_KEY)).astype("<f4")
    sums = (int(seen.sum()), int(counts.sum()), int((counts == 1).sum()))
    stats = [(1 if single else 2, 0, 0, part, 0, *sums, None, None)]
    if single:
        own = levels_of(counts[seen])
        types, every = np.bincount(own, minlength=LEVELS + 1), np.bincount(own, weights=counts[seen], minlength=LEVELS + 1)
        stats += [(3, 0, 0, k, 0, int(types[k]), int(every[k]), 0, None, None) for k in np.flatnonzero(types).tolist()]
    yield _rows(stats)
    at = 0
    for (home, number, mark, _), (k, _) in zip(questions, read, strict=True):
        own = inverse[at : at + len(k)]
        at += len(k)
        yield _rows([(0, home, number, part, mark, len(k), 0, 0, _squeezed(scaled[own]), _squeezed(counts[own].astype("<i8")) if single else None)])


def _answer(token_fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, pa.Buffer]] = []
        at = None
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("part", "home", "number", "mark"))
            for part, home, number, mark, entries in zip(*columns, b.column("entries"), strict=True):
                if part != at and held:
                    yield from answers(at, held, token_fragments)
                    held = []
                at = part
                held.append((home, number, mark, entries.as_buffer()))
        if held:
            yield from answers(at, held, token_fragments)

    return run


_STREAM = pa.ipc.IpcWriteOptions(compression="zstd")


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window's texts as a row of the answers' kind, with part -1."""
    for w in windows(batches, _first_window()):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, w.rows.schema, options=_STREAM) as stream:
            stream.write_batch(w.rows)
        yield _rows([(0, w.home, w.number, -1, w.mark(), int(w.last), 0, 0, sink.getvalue().to_pybytes(), struct.pack("<Q", w.before))])


class Model(NamedTuple):
    """The constants of the formula."""

    total: int
    distinct: int
    weight: float
    token_fragments: int


def weight_of(levels: list[tuple[int, int]], once: int, total: int) -> float:
    """K for contexts given by (different ones, tokens after them) of each level of the count, so that it takes a share once / total of all tokens."""
    if not total:
        return 1.0
    types, every = np.array(levels, float).T
    mean = every / types
    low, high = 1e-3, 1e9
    for _ in range(100):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if (every * middle / (mean + middle)).sum() < once else (low, middle)
    return high


def bigram_logs(w: Window, found: dict[int, tuple[int, int, bytes, bytes | None]], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log10 P of each token, its exact count, its hash, tokens of each text) of a window. found: (mark, n, a, b) by fragment."""
    words, before, sizes = tokens(w)
    mark = w.mark()
    parts = sorted(found)
    if any(found[p][0] != mark for p in parts):
        raise RuntimeError("the rows came in another order when they were read again; write them to a table first")
    single = [p for p in parts if p < model.token_fragments]
    scaled, both = (np.concatenate([np.empty(0, "<f4"), *(_spread(found[p][2], "<f4", found[p][1]) for p in ps)]).astype(float) for ps in (single, [p for p in parts if p >= model.token_fragments]))
    counts = np.concatenate([np.empty(0, "<i8"), *(_spread(found[p][3], "<i8", found[p][1]) for p in single)])
    uniq, which = np.unique(_with_contexts(w, words), return_inverse=True)
    pairs, first, pair = np.unique(bigram_hashes(words, before), return_index=True, return_inverse=True)
    if len(uniq) != len(counts) or len(pairs) != len(both):
        raise RuntimeError("a window's answers are not complete")
    lower = (scaled[which[first]] + 1) / (model.total + model.distinct + 1)
    # A context is followed as often as it stands; a start as often as there are ends.
    follow = counts[np.searchsorted(uniq, np.where(before[first] == START, END, before[first]))]
    logs = np.log10((both + model.weight * lower) / (follow + model.weight))
    return logs[pair], counts[which[: len(words)]], words, sizes


_SCORES = "doc long, n_tokens long, n_known long, logs double, score double"


def _scores(model: Model):
    def window(held: tuple, found: dict) -> list[tuple]:
        home, number, mark, last, blob, before = held
        rows = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
        w = Window(home, number, rows, struct.unpack("<Q", before)[0], bool(last))
        logs, counts, _, sizes = bigram_logs(w, found, model)
        edges = np.cumsum(sizes) - sizes
        add = lambda x: np.array([x[s : s + n].sum() for s, n in zip(edges.tolist(), sizes.tolist(), strict=True)]) if (sizes == 0).any() else np.add.reduceat(x, edges)
        return list(zip(rows.column("doc").to_pylist(), sizes.tolist(), add((counts > 0).astype(np.int64)).tolist(), add(np.log10(counts + 1.0)).tolist(), add(logs).tolist(), strict=True))

    def shown(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc", "n_tokens", "n_known", "logs", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, {}
        kept: list[tuple] = []  # sums of a long text whose end has not come

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal kept
            rows = window(held, found)
            if kept:
                rows = [(rows[0][0], *(x + y for x, y in zip(kept[0][1:], rows[0][1:], strict=True)))]
            kept = [] if held[3] else rows
            if held[3]:
                yield shown(rows)

        for b in batches:
            for home, number, part, mark, n, x, y in zip(*(b.column(c).to_pylist() for c in ("home", "number", "part", "mark", "n", "a", "b")), strict=True):
                if part < 0:
                    if held:
                        yield from done()
                    held, found = (home, number, mark, n, x, y), {}
                else:
                    found[part] = (mark, n, x, y)
        if held:
            yield from done()

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row an input row; see the module's text.

    base_score: sum of log10((c + 1) / (N + V + 1)) with exact counts. score: log10 probability by the filter's model.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = read_alike(source)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(4, -(-size // TOKEN_FRAGMENT)), max(8, -(-size // BIGRAM_FRAGMENT))
    tasks = min(sum(fragments), TASKS)
    questions = source.mapInArrow(_ask(fragments, folds, held), _ASKED)
    dealt = questions.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part")
    found = cut(dealt.mapInArrow(_answer(fragments[0]), _ANSWER))

    stats = found.where("what > 0").groupBy("what", F.when(F.col("what") == 3, F.col("part")).alias("level")).agg(*(F.sum(c).alias(c) for c in ("n", "total", "once"))).collect()
    single = next((r for r in stats if r["what"] == 1), None)
    total, distinct = (single["total"], single["n"]) if single else (0, 0)
    once = sum(r["once"] for r in stats if r["what"] == 2)
    weight = weight_of([(r["n"], r["total"]) for r in stats if r["what"] == 3], once, total)
    model = Model(total, distinct, weight, fragments[0])

    homes = max(1, -(-size // HOME_BYTES))
    met = source.mapInArrow(_home, _ANSWER).unionAll(found.where("what = 0")).repartition(homes, "home").sortWithinPartitions("home", "number", "part")
    return met.mapInArrow(_scores(model), _SCORES).select(
        F.col("doc").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc").cast("string")) % folds == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        "score",
    )
