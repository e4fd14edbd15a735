"""Posting lists as compressed blocks of bounded size.

Postings (word, doc, pos) are range-partitioned by all three columns and sorted, so a frequent word spreads over tasks, and
each task cuts its run of rows into blocks of at most BLOCK postings of one word. A block holds its count, its first and last
(doc, pos), and two streams of variable-length numbers: for each document the step from the one before and how many postings it
has, for each posting the step from the position before it in the document. Documents that are no whole numbers stand by name.

A block is one row, whatever the word's frequency. Blocks of one table don't overlap, so a word's list is read in order of
`first`; what lies outside a range of documents is skipped by the header.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemill.operators.spread import parts_of

#: Postings of a block at most.
BLOCK = 1024


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number begins, and the end) of whole numbers from 0: seven bits a byte, the lowest first, the top bit set where more follow."""
    numbers = numbers.astype(np.uint64)
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 10):
        size += numbers >= np.uint64(1) << np.uint64(7 * k)
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(begin[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        use = size > k
        out[begin[:-1][use] + k] = ((numbers[use] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[use] > k + 1, np.uint64(128), np.uint64(0))
    return out, begin


def from_varints(data: np.ndarray) -> np.ndarray:
    """The numbers of a stream of varints, as int64."""
    if not len(data):
        return np.empty(0, np.int64)
    begin = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin).astype(np.int64)


def _steps(values: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Differences to the value before; where fresh, the value itself."""
    out = values.copy()
    out[1:] -= np.where(fresh[1:], 0, values[:-1])
    return out


def _sums(steps: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """What _steps came from."""
    total = np.cumsum(steps)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(steps)), 0))
    return total - (total - steps)[begin]


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first one does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = column.slice(1).to_numpy(zero_copy_only=False) != column.slice(0, len(column) - 1).to_numpy(zero_copy_only=False)
    return out


def _cut(held: pa.Table, block: int, last: bool) -> tuple[np.ndarray, int]:
    """(where blocks begin, and the end of the last one) of sorted rows; unless these are the last rows, a word's incomplete block at their end is left for later."""
    new = _changes(held.column("word").combine_chunks())
    inside = np.arange(held.num_rows) - np.maximum.accumulate(np.where(new, np.arange(held.num_rows), 0))
    begin = np.flatnonzero(inside % block == 0)
    if last or inside[-1] % block == block - 1:
        return begin, held.num_rows
    return begin[:-1], int(begin[-1])


def _encoded(rows: pa.Table, begin: np.ndarray, numbered: bool) -> pa.RecordBatch:
    """One row a block."""
    n = rows.num_rows
    word, doc = (rows.column(c).combine_chunks() for c in ("word", "doc"))
    pos = rows.column("pos").to_numpy()
    end = np.append(begin[1:], n)
    top = np.zeros(n, bool)
    top[begin] = True
    run = top | _changes(doc)
    runs = np.flatnonzero(run)
    many = np.diff(np.append(runs, n))
    first_run = np.searchsorted(runs, begin)
    step = _steps(doc.to_numpy()[runs], np.zeros(len(runs), bool)) if numbered else np.ones(len(runs), np.int64)
    step[first_run] = 0
    docs, doc_at = varints(np.stack([step, many], axis=1).ravel())
    positions, pos_at = varints(_steps(pos, run))
    doc_edges, pos_edges = doc_at[2 * np.append(first_run, len(runs))], pos_at[np.append(begin, n)]
    binary = lambda data, edges: pa.array([data[a:z].tobytes() for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
    ends = lambda at: pa.StructArray.from_arrays([doc.take(pa.array(at)), pa.array(pos[at])], names=["doc", "pos"])
    columns = [word.take(pa.array(begin)), pa.array((end - begin).astype(np.int32)), ends(begin), ends(end - 1), binary(docs, doc_edges), binary(positions, pos_edges)]
    names = ["word", "n", "first", "last", "docs", "positions"]
    if not numbered:
        edges = np.append(first_run, len(runs)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(edges), doc.take(pa.array(runs))))
        names.append("names")
    return pa.RecordBatch.from_arrays(columns, names=names)


def posting_blocks(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n int, first, last struct(doc, pos), docs, positions binary, and names where doc is no whole number): blocks of the postings (word, doc, pos).

    One exchange, by ranges. pos: whole numbers from 0. Postings without a word, a document or a position are left out; repeated ones stay.
    """
    numbered = isinstance(found.schema["doc"].dataType, IntegralType)
    doc = F.col("doc").cast("long") if numbered else F.col("doc").cast("string")
    kind = "long" if numbered else "string"
    order = ["word", "doc", "pos"]
    whole = found.select("word", doc.alias("doc"), F.col("pos").cast("long").alias("pos")).dropna()
    rows = whole.repartitionByRange(parts_of(whole), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            begin, end = _cut(held, block, last=False)
            if end:
                yield _encoded(held.slice(0, end), begin, numbered)
                held = held.slice(end)
        if held is not None and held.num_rows:
            begin, _ = _cut(held, block, last=True)
            yield _encoded(held, begin, numbered)

    names = "" if numbered else ", names array<string>"
    return rows.mapInArrow(run, f"word string, n int, first struct<doc: {kind}, pos: long>, last struct<doc: {kind}, pos: long>, docs binary, positions binary{names}")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(word, doc, pos): the postings of the blocks, each block's in order."""
    numbered = "names" not in blocks.columns
    needed = blocks.select("word", "n", F.col("first.doc").alias("doc") if numbered else "names", "docs", "positions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Some hundred thousand postings at once.
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n = b.column("n").to_numpy()
                streams = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8) for c in ("docs", "positions")]
                pairs, steps = from_varints(streams[0]).reshape(-1, 2), from_varints(streams[1])
                many = pairs[:, 1]
                # Documents of a block follow one another until its postings are used up.
                first = np.searchsorted(np.cumsum(many) - many, np.cumsum(n) - n)
                top = np.zeros(len(many), bool)
                top[first] = True
                run_start = np.zeros(len(steps), bool)
                run_start[np.cumsum(many) - many] = True
                if numbered:
                    step = pairs[:, 0].copy()
                    step[first] = b.column("doc").to_numpy()
                    doc = pa.array(np.repeat(_sums(step, top), many))
                else:
                    doc = b.column("names").flatten().take(pa.array(np.repeat(np.arange(len(many)), many)))
                word = b.column("word").take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([word, doc, pa.array(_sums(steps, run_start))], names=["word", "doc", "pos"])

    return needed.mapInArrow(run, f"word string, doc {'long' if numbered else 'string'}, pos long")


def lookup(blocks: DataFrame, words: list[str], from_doc=None, to_doc=None) -> DataFrame:
    """(word, doc, pos) of some words, within a range of documents (both ends included): blocks outside are skipped by their headers."""
    near = blocks.where(F.col("word").isin(words))
    near = near if from_doc is None else near.where(F.col("last.doc") >= from_doc)
    near = near if to_doc is None else near.where(F.col("first.doc") <= to_doc)
    found = read_blocks(near)
    found = found if from_doc is None else found.where(F.col("doc") >= from_doc)
    return found if to_doc is None else found.where(F.col("doc") <= to_doc)


def merge_blocks(old: DataFrame, new: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of both tables' postings: words of one table only keep their blocks, the others' postings are merged and cut anew."""
    words = [b.select("word").distinct() for b in (old, new)]
    shared = words[0].join(words[1], "word")
    both = old.unionByName(new)
    again = posting_blocks(read_blocks(both.join(shared, "word", "left_semi")), block)
    return both.join(shared, "word", "left_anti").unionByName(again)
