"""Best-fit packing into bins of several permitted lengths.

Documents become pieces of at most the largest length (whole chunks, then the rest). Pieces are dealt to
shards by a hash of their document and packed shard by shard, longest first: a piece goes into the open
bin with the least room that still holds it. If none does, a bin is opened, at the length of least net
cost: its cost, less what its spare room is worth, which is the spare tokens that the shard's shorter
pieces can still fill, at a price. When all pieces are placed, each bin is downsized to the shortest
permitted length that holds its contents. The lengths are optimised jointly: a shard is packed once for each
plan (a price of spare room, and a largest length that is opened for pieces that fit below it), and the plan of
least total cost after downsizing is kept; ties go to the first plan.

A shard has SHARD_PIECES pieces on average, each a few numbers wide, so a task's memory is bounded
whatever the corpus; a bin never spans shards, which costs less than one open bin of each length a shard.
Pieces that are alike in id, text and number are counted before they are dealt, and the count is spread
evenly over the shards, so rows repeated without end fill no shard. The result depends only on the rows,
not on how they are partitioned.

Null and empty texts have one token (the end). Null ids and repeated rows are packed like any others. A long
text is counted in chunks and never copied. Other columns are ignored; an empty table gives no rows.

With with_text, each piece comes with its stretch of the text, from its first word (the first piece: from the beginning) up to the next
piece's first word, so the pieces of a document, joined, are its text, and those of a bin, in order of bin_offset, its sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kernels import raw, slices, text_column, word_counts, word_spans
from tidemill.llm.session import cut

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000


def default_costs(lengths: Sequence[int]) -> list[float]:
    """Cost of a bin: its tokens, with a surcharge for attention that grows with the length, and a fixed part."""
    return [n * (1 + n / 65_536) + 16 for n in lengths]


#: Prices of a spare token, as shares of the cheapest token's cost.
PRICES = (1.0, 0.75, 0.5)


def _packed(sizes: Sequence[int], lengths: Sequence[int], costs: Sequence[float], price: float, largest: int) -> tuple[list[int], list[int], list[int], float]:
    """(bin of each piece, its offset in the bin, final length of each bin, their cost) under one plan."""
    room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: some open bin has room r
    bins, offsets, used = [], [], []
    left = sum(sizes)
    for size in sizes:
        left -= size
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            at = len(used)
            r = min((c - price * min(n - size, left), n) for c, n in zip(costs, lengths, strict=True) if n >= size and (n <= largest or n == next(m for m in lengths if m >= size)))[1]
            used.append(0)
        bins.append(at)
        offsets.append(used[at])
        used[at] += size
        r -= size
        if r:
            room.setdefault(r, []).append(at)
            open_rooms |= 1 << r
    final = [next(n for n in lengths if n >= u) for u in used]
    cost = dict(zip(lengths, costs, strict=True))
    return bins, offsets, final, sum(map(cost.__getitem__, final))


def plans(lengths: Sequence[int]) -> list[tuple[float, int]]:
    """(price as a share, largest length that is opened by choice) of each plan that is tried."""
    return [(p, largest) for largest in sorted(lengths, reverse=True) for p in (PRICES if largest == max(lengths) else PRICES[:1])]


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, costs: Sequence[float] | None = None) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset in the bin, final length of each bin) by the cheapest plan. sizes: longest first, none above the largest length."""
    lengths = sorted(lengths)
    costs = default_costs(lengths) if costs is None else list(costs)
    cheapest = min(c / n for c, n in zip(costs, lengths, strict=True))
    best = min((_packed(sizes, lengths, costs, share * cheapest, largest) for share, largest in plans(lengths)), key=lambda found: found[3])
    return best[:3]


def _pieces(largest: int):
    names = ["doc_id", "version", "piece", "n_tokens", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = word_counts(text_column(b)) + 1
            pieces = -(-counts // largest)
            row = np.repeat(np.arange(len(counts)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(counts[row] - number * largest, largest)
            ids = b.select(["doc_id", "version"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.ones(len(row), np.int64))], names=names)

    return run


def stretches(text: str, largest: int) -> list[str]:
    """The text cut before each largest-th word; the last stretch may have no word."""
    data, offsets = raw(pa.array([text], pa.large_string()))
    starts, _ = word_spans(data, offsets)
    pieces = len(starts) // largest + 1
    at = [0, *(int(starts[k * largest]) if k * largest < len(starts) else len(data) for k in range(1, pieces)), len(data)]
    return [data[a:z].tobytes().decode() for a, z in zip(at[:-1], at[1:], strict=True)]


def _piece_texts(largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            few = word_counts(text_column(b)) < largest
            for doc, version, text, whole in zip(b.column("doc_id").to_pylist(), b.column("version").to_pylist(), text_column(b).to_pylist(), few.tolist(), strict=True):
                parts = [text] if whole else stretches(text, largest)
                columns = [pa.array([doc] * len(parts), pa.int64()), pa.array([version] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "piece", "text"])

    return run


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths: Sequence[int] = LENGTHS, costs: Sequence[float] | None = None, shard_pieces: int = SHARD_PIECES,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, piece int, start_token long, n_tokens int, bin_id string, bin_length int, bin_offset int), one row a piece; with_text: and its text.

    Tokens are words and one end. bin_id is `shard-number`; pieces of a bin lie side by side from offset 0.
    """
    lengths = sorted(lengths)
    largest = lengths[-1]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    pieces = source.mapInArrow(_pieces(largest), "doc_id long, version long, piece int, n_tokens int, copies long")
    counted = cut(pieces.groupBy("doc_id", "version", "piece", "n_tokens").agg(F.sum("copies").alias("copies")))
    total = counted.agg(F.sum("copies")).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    # Copies go to shards in turn, from the shard of the hash on.
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("copies"), F.lit(shards)) - 1))
    spread = counted.select("*", turn.alias("turn"))
    dealt = spread.select(
        F.pmod(F.pmod(F.xxhash64("doc_id", "version", "piece"), F.lit(shards)) + F.col("turn"), F.lit(shards)).cast("int").alias("shard"),
        *("doc_id", "version", "piece", "n_tokens"),
        (F.floor((F.col("copies") - 1 - F.col("turn")) / shards) + 1).alias("copies"),
    )

    def pack(table: pa.Table) -> pa.Table:
        size, doc, version, piece = (table.column(c).fill_null(2**63 - 1 if c == "doc_id" else 0).to_numpy() for c in ("n_tokens", "doc_id", "version", "piece"))
        order = np.lexsort((piece, version, doc, -size))
        order = np.repeat(order, table.column("copies").to_numpy()[order])
        table = table.take(pa.array(order))
        bins, offsets, final = best_fit(table.column("n_tokens").to_pylist(), lengths, costs)
        shard = table.column("shard")[0].as_py()
        start = table.column("piece").to_numpy().astype(np.int64) * largest
        new = {"bin_id": pa.array([f"{shard}-{b}" for b in bins]), "bin_length": pa.array([final[b] for b in bins], pa.int32()), "bin_offset": pa.array(offsets, pa.int32())}
        mark = {"version": table.column("version")} if with_text else {}
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "start_token": pa.array(start), "n_tokens": table.column("n_tokens")} | new | mark)

    mark = ", version long" if with_text else ""
    packed = dealt.groupBy("shard").applyInArrow(pack, f"doc_id long, piece int, start_token long, n_tokens int, bin_id string, bin_length int, bin_offset int{mark}")
    if not with_text:
        return packed
    # The text of alike rows once; placements are written, so that packing is not repeated for the join.
    texts = source.mapInArrow(_piece_texts(largest), "doc_id long, version long, piece int, text string").dropDuplicates(["doc_id", "version", "piece"])
    both = (F.col("p.doc_id").eqNullSafe(F.col("t.doc_id"))) & (F.col("p.version") == F.col("t.version")) & (F.col("p.piece") == F.col("t.piece"))
    return cut(packed).alias("p").join(texts.alias("t"), both).select("p.*", "t.text").drop("version")
