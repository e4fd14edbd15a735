"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph (a non-empty line, with the blanks at its ends stripped) hashes to a wide vector; a
document's vector is the sum over its paragraphs, each component modulo a power of two. So the order of
paragraphs does not matter, equal multisets have equal vectors, and a paragraph is inserted or deleted by
adding or subtracting its vector. The vector has two parts:

- EXACT components of 64 bits, modulo 2**64, together the paragraph's 512-bit BLAKE2b digest: equality;
- SIGNS components of 32 bits, modulo 2**32, each the sum of pseudo-random signs of the paragraph's
  word shingles (SPAN words): squared lengths of such vectors and of their difference estimate those of
  the documents' shingle counts, which gives the likeness. A text has fewer than 2**31 shingles, so the
  sums of single documents never wrap.

The fingerprint's string is the number of shingles and the hex of both parts. Null text is empty: no
paragraph, the zero vector. Two documents without paragraphs have likeness 1. Repeated rows and ids are documents of
their own, next to each other in the order; null ids come last. Only the id and the text are read, so other columns
may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kernels import U, mix, shingles, slices, text_column, word_hashes
from tidemill.llm.session import partitions, read_alike

EXACT = 8
SIGNS = 128
SPAN = 3
_PART = 1 << 15
LAST_ID = 2**63 - 1


def _sum_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of rows in runs of the given sizes, wrapping."""
    out = np.zeros((len(sizes), values.shape[1]), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], axis=0)
    return out


def _paragraphs(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(paragraphs of all texts, paragraphs of each text)."""
    each = [[p for line in t.encode().split(b"\n") if (p := line.strip(b" \t\r\x0b\x0c"))] for t in texts]
    return [p for ps in each for p in ps], np.array([len(ps) for ps in each], np.int64)


def fingerprint_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact uint64 x EXACT, signs uint32 x SIGNS, shingles) of each text."""
    paragraphs, counts = _paragraphs(texts)
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in paragraphs)
    exact = _sum_by(np.frombuffer(digests, "<u8").reshape(-1, EXACT).astype(U), counts)
    flat, per_paragraph = shingles(*word_hashes(pa.array(paragraphs, pa.binary()).cast(pa.string())), SPAN)
    edges = np.concatenate([[0], np.cumsum(per_paragraph)])[np.concatenate([[0], np.cumsum(counts)])]
    sizes = np.diff(edges)
    ones = np.zeros((len(texts), SIGNS), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for at in range(0, len(flat), _PART):
        part = flat[at : at + _PART]
        words = np.stack([part] + [mix(part, 31 + k) for k in range(SIGNS // 64 - 1)], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        own = owner[at : at + _PART]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.uint32)
    # Signs are 2 * bit - 1.
    signs = ones * np.uint32(2) - sizes.astype(np.uint32)[:, None]
    return exact, signs, sizes


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of a's paragraphs together with b's (sign 1) or without them (sign -1)."""
    (ea, sa, na), (eb, sb, nb) = parse(a), parse(b)
    with np.errstate(over="ignore"):
        return _shown(ea + eb if sign > 0 else ea - eb, sa + sb if sign > 0 else sa - sb, na + sign * nb)


def _shown(exact: np.ndarray, signs: np.ndarray, n: int) -> str:
    return f"{n:x}." + exact.astype(">u8").tobytes().hex() + signs.astype(">u4").tobytes().hex()


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray, int]:
    n, _, rest = fingerprint.partition(".")
    data = bytes.fromhex(rest)
    return np.frombuffer(data[: 8 * EXACT], ">u8").astype(U), np.frombuffer(data[8 * EXACT :], ">u4").astype(np.uint32), int(n, 16)


def likenesses(a: tuple, b: tuple) -> np.ndarray:
    """1 for equal vectors, else 1 - |a - b|**2 / (|a|**2 + |b|**2) of the shingle counts as estimated from the signs, between 0 and 1, row by row."""
    far, long_a, long_b = ((x.view(np.int32).astype(np.float64) ** 2).sum(axis=1) for x in (a[1] - b[1], a[1], b[1]))
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1) & (a[2] == b[2])
    return np.where(same, 1.0, np.clip(1 - far / np.maximum(long_a + long_b, 1), 0, 1))


def likeness(a: str, b: str) -> float:
    (ea, sa, na), (eb, sb, nb) = parse(a), parse(b)
    return float(likenesses((ea[None], sa[None], np.array([na])), (eb[None], sb[None], np.array([nb])))[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep and `fingerprint`."""
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 1 << 20):
            e, s, n = fingerprint_vectors(text_column(b, "__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([_shown(*x) for x in zip(e, s, n.tolist(), strict=True)], pa.string())], names=[*keep, "fingerprint"])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, fingerprint string")


#: Rows sampled for each range.
SAMPLED = 48


def _order_keys(b: pa.RecordBatch) -> np.ndarray:
    """The rows' (doc, version, tie) as byte strings of the same order."""
    columns = [b.column(c).to_numpy().astype(np.int64) for c in ("doc", "version", "tie")]
    return np.ascontiguousarray((np.stack(columns, axis=1).view(U) ^ U(1 << 63)).astype(">u8")).view("S24").ravel()


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, text, own): each partition holds a run of documents in order, then with own = false the next run's first document (after the last run: the first one of all).

    Order: doc_id, nulls last (as the largest long), then a hash of the text, then the row's place, so that a
    hot id or a row repeated without end spreads over ranges as well. The order is cut into ranges by a sample of
    SAMPLED keys a range, and each range goes to a partition of its own; its smallest row is also copied
    to the range before. Text crosses one exchange; the sample and one key a range reach the driver. The rows are read
    three times and must come alike each time: what is no plain scan of files is written first.
    """
    spark = docs.sparkSession
    rows = read_alike(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))).select(
        F.coalesce(F.col("id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("tie"), "text"
    )
    keys = rows.select("doc", "version", "tie")
    n = partitions(spark)
    cuts = np.empty(0, "S24")
    total = rows.count() if n > 1 else 0
    if total:
        # A share of the rows by their hash: about SAMPLED for each range, whatever the number of tasks.
        share = int(min(1.0, n * SAMPLED / total) * (1 << 32))
        sample = keys.where(F.pmod(F.xxhash64("tie", "version", "doc"), F.lit(1 << 32)) < share).toArrow()
        found = np.sort(np.concatenate([np.empty(0, "S24"), *(_order_keys(b) for b in sample.to_batches())]))
        cuts = np.unique(found[np.arange(1, n) * len(found) // n]) if len(found) else cuts

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, bytes] = {}
        for b in batches:
            key = _order_keys(b)
            order = np.argsort(key)
            there, first = np.unique(np.searchsorted(cuts, key[order], side="right"), return_index=True)
            for p, k in zip(there.tolist(), key[order][first].tolist(), strict=True):
                least[p] = min(least.get(p, b"\xff" * 24), k.ljust(24, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.binary())], names=["place", "key"])

    first = {r["place"]: bytes(r["key"]) for r in keys.mapInArrow(smallest, "place int, key binary").groupBy("place").agg(F.min("key").alias("key")).collect()}
    order = sorted(first)
    least = np.full(len(cuts) + 1, b"\xff" * 24, "S24")
    previous = np.zeros(len(cuts) + 1, np.int32)
    for k, p in enumerate(order):
        least[p], previous[p] = first[p], order[k - 1]
    names = ["doc", "version", "text", "own", "at"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _order_keys(b)
            place = np.searchsorted(cuts, key, side="right").astype(np.int32)
            b = b.select(["doc", "version", "text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ones(len(key), bool)), pa.array(place)], names=names)
            copied = np.flatnonzero(key == least[place])
            if len(copied):
                c = b.take(pa.array(copied))
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(np.zeros(len(copied), bool)), pa.array(previous[place[copied]])], names=names)

    dealt = rows.mapInArrow(deal, "doc long, version long, text string, own boolean, at int")
    return dealt.repartitionById(len(cuts) + 1, F.col("at")).sortWithinPartitions(F.desc("own"), "doc", "version").drop("at")


def edited(text: str, following: str) -> str:
    """The text's last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document; see in_order for the order."""

    def block(docs_: list, texts: list[str], following: str) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], following], strict=True)]
        own = fingerprint_vectors([*texts, following])
        new = fingerprint_vectors(changed)
        here, there = [x[:-1] for x in own], [x[1:] for x in own]
        show = [pa.array([_shown(*x) for x in zip(e, s, n.tolist(), strict=True)], pa.string()) for e, s, n in (here, new)]
        return pa.RecordBatch.from_arrays(
            [pa.array(docs_, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
             *show, pa.array(likenesses(here, new)), pa.array(likenesses(here, there))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list[str]] = ([], [])
        following = 0
        for b in slices(batches, "text", 1 << 20):
            own = np.array(b.column("own").to_pylist(), bool)
            texts, ids = text_column(b).to_pylist(), [None if d == LAST_ID else d for d in b.column("doc").to_pylist()]
            k = int(own.sum())
            if not following:
                if held[1]:
                    yield block(*held, texts[0])
                held = ids[:k], texts[:k]
                if 0 < k < len(texts):
                    yield block(*held, texts[k])
            following += len(texts) - k
        if held[1] and following != 1:
            raise RuntimeError(f"a range of documents is followed by {following} rows instead of the next one: the input came otherwise when it was read again")

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, doc_id, text).mapInArrow(run, schema)
