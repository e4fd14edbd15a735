"""Line deduplication across documents.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. Keys of at
least `min_chars` code points that occur in two or more documents lose all their lines except in the
smallest doc_id that holds them.

Plan: lines become (128-bit key hash, document, position); these rows are range-partitioned by all of
these columns and sorted, so a key that a third of the corpus holds spreads over many partitions. Each
partition streams its rows and passes on those after a key's first document. Only a partition's first
key may have begun in an earlier one: its rows wait for the smallest first document of that key, which
is a table of at most two rows a partition. Dropped positions then come together for each document as a
compressed keep bitmap; text never crosses the first exchange.

Null or empty text is one empty line. A null doc_id counts as one document after all others. Rows with
the same doc_id are the same document: none of them loses a line to another. Columns of the input that
are not named as parameters are passed through untouched by apply_bitmaps and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kernels import slices, text_column
from tidemill.llm.session import cut, partitions

BLANKS = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1


def line_key(line: str) -> bytes:
    return line.strip(BLANKS).encode().lower()


def _hashed(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _line_rows(min_chars: int):
    kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h1, h2, docs, versions, at = [], [], [], [], []
            ids, marks = batch.column("doc").to_pylist(), batch.column("version").to_pylist()
            for doc, mark, text in zip(ids, marks, text_column(batch).to_pylist(), strict=True):
                for pos, line in enumerate(text.split("\n")):
                    stripped = line.strip(BLANKS)
                    if len(stripped) >= min_chars:
                        a, b = _hashed(stripped.encode().lower())
                        h1.append(a)
                        h2.append(b)
                        docs.append(doc)
                        versions.append(mark)
                        at.append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((h1, h2, docs, versions, at), kind, strict=True)], schema=kind)

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of (h1, h2, doc): what = 0 dropped, 1 in doubt (the partition's first key), 2 a key's first document."""
    names = ["what", "h1", "h2", "doc", "version", "pos"]
    first = last = None  # (h1, h2, first document) of the partition's first key and of the key being read
    in_first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, version, pos = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc", "version", "pos"))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = (h1[0], h2[0]) != last[:2]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        owner = np.where(group >= 0, doc[begin[np.maximum(group, 0)]] if len(begin) else 0, last[2] if last else 0)
        if first is None:
            first = (int(h1[0]), int(h2[0]), int(doc[0]))
        doubt = np.zeros(len(h1), dtype=bool)
        if in_first:
            doubt = (h1 == first[0]) & (h2 == first[1])
            in_first = bool(doubt[-1])
        out = doubt | (doc != owner)
        last = (int(h1[-1]), int(h2[-1]), int(owner[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(doubt[out].astype(np.int32)), *(pa.array(x[out]) for x in (h1, h2, doc, version, pos))], names=names)
    ends = {x for x in (first, last) if x}
    yield pa.RecordBatch.from_arrays(
        [pa.array([2] * len(ends), pa.int32()), *(pa.array([e[k] for e in ends], pa.int64()) for k in range(3)), pa.array([0] * len(ends), pa.int64()), pa.array([0] * len(ends), pa.int32())], names=names
    )


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, version, pos): the lines to drop. doc is doc_id (null: the largest long), version a hash of the text."""
    spark = docs.sparkSession
    lines = cut(_keyed(docs, doc_id, text).mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc long, version long, pos int"))
    order = ["h1", "h2", "doc", "version", "pos"]
    ordered = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = cut(ordered.mapInArrow(_stream, "what int, h1 long, h2 long, doc long, version long, pos int"))
    # At most two rows a partition, so broadcast whatever the corpus: the rows in doubt of a common line stay where they are.
    keepers = found.where("what = 2").groupBy("h1", "h2").agg(F.min("doc").alias("keeper"))
    doubt = found.where("what = 1").join(F.broadcast(keepers), ["h1", "h2"]).where("doc <> keeper")
    return found.where("what = 0").unionByName(doubt.drop("keeper")).select("doc", "version", "pos")


def pack_bitmap(n: int, dropped: list[int]) -> bytes:
    """One keep bit a line for n lines, set in the padding after them."""
    keep = np.ones(-(-n // 8) * 8, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, version, bitmap binary) for each document that loses a line: a compressed keep bit for each of its lines up to the last dropped one."""
    lost = dropped_lines(docs, doc_id, text, min_chars).groupBy("doc", "version").agg(F.array_sort(F.collect_set("pos")).alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [pack_bitmap(x[-1] + 1, x) for x in b.column("lost").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("version"), pa.array(maps, pa.binary())], names=["doc", "version", "bitmap"])

    return lost.mapInArrow(run, "doc long, version long, bitmap binary")


def kept_lines(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """(kept text, lines, dropped lines)."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    bits = unpack_bitmap(bitmap)
    kept = [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


#: Parts into which the rows of one text are dealt when they meet its first document.
SALTS = 16


def whole_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version) of the documents whose whole text is that of a document with a smaller doc_id; 128 bits of hash stand for a text.

    First documents are found with map-side combine and meet the copies in SALTS parts, so the copies of one text spread.
    """
    texts = _keyed(docs, doc_id, text).select("doc", "version", F.xxhash64(F.lit(1), F.col("text")).alias("check"))
    owners = texts.groupBy("version", "check").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").drop("last")
    parts = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    return dealt.join(parts, ["version", "check", "salt"]).where("doc > owner").select("doc", "version").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, keep: tuple[str, ...] | None = None, drop_copies: bool = False) -> DataFrame:
    """The documents' columns (or those in keep) with `text` reduced to its kept lines, and n_lines and n_dropped (long).

    Null text comes back as empty. Input columns named n_lines or n_dropped are replaced. All documents stay;
    with drop_copies those go that lose lines and whose whole text is that of a smaller doc_id.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_dropped", text)]
    bitmaps = keep_bitmaps(docs, doc_id, text, min_chars)
    if drop_copies:
        bitmaps = bitmaps.join(whole_copies(docs, doc_id, text).withColumn("copy", F.lit(True)), ["doc", "version"], "left")
    keyed = docs.select(
        F.struct(*names).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("version")
    )
    joined = keyed.join(bitmaps, ["doc", "version"], "left")
    joined = (joined.where("copy is null") if drop_copies else joined).select("row", "text", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            done = [kept_lines(t, m) for t, m in zip(text_column(b).to_pylist(), b.column("bitmap").to_pylist(), strict=True)]
            cols = [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *cols], names=["row", "text", "n_lines", "n_dropped"])

    row_type = keyed.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"row {row_type}, text string, n_lines long, n_dropped long")
    order = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_dropped")]
    return out.select(*(F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in order), "n_lines", "n_dropped")
