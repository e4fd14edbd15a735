"""SentencePiece encoding with source spans, and decoding.

Normalisation walks the model's compiled character map (a double-array trie over replacement strings):
at each byte the longest key in the map is replaced, else one character is copied; every byte written
remembers the source byte it came from. The normalised text is then cut before each run of word marks
(U+2581) that follows another character. No BPE piece of such a model spans that cut (checked when the
model is loaded; a model that has such pieces is segmented whole), so units are segmented one by one and
remembered by their bytes: a text's ids are the gathered ids of its units, and a piece's span in the source
is its normalised span sent through the alignment. Equal units of a batch are found by a hash and then
compared byte by byte; should different ones share a hash, the batch's units are told apart one by one.

Segmentation of a unit is the sentencepiece library's, with normalisation switched off. Null text is
empty and has no ids. Text that is not valid UTF-8 is read with replacement characters. Repeated rows and ids get a row
each, null ids are kept; only the named columns are read, so others may have any name. An empty table gives no rows. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kernels import group_index, same_spans, slices, span_hashes, text_column

MARK = "▁"
#: Units remembered by a worker, and their bytes, before it starts over.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
_ACROSS = re.compile(f"[^{MARK}]{MARK}")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _message(data: bytes) -> Iterator[tuple[int, int, int | bytes, int, int]]:
    """(field, wire type, value, start, end) of a protobuf message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, wire, value, start, at


class CharacterMap:
    """The compiled map: a little-endian size, a double-array trie of that many bytes, then zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest key that starts at `at`."""
        units = self.units
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] >> 6) & 8)
        found = None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit >> 6) & 8)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)]
        return found


class Normaliser:
    """The model's normalisation with alignment."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, remove_extra: bool, escape: bool) -> None:
        self.map, self.dummy_prefix, self.remove_extra, self.escape = CharacterMap(charsmap), dummy_prefix, remove_extra, escape

    @property
    def plain(self) -> bool:
        """No replacement and no removal: only word marks are added."""
        return not self.map.units and not self.remove_extra

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte of each normalised byte and of its end)."""
        space = MARK if self.escape else " "
        if self.plain:
            if not text:
                return "", np.zeros(1, np.int64)
            out = ((" " if self.dummy_prefix else "") + text).replace(" ", space)
            widths = np.ones(len(source := text.encode()), np.int64)
            if self.escape:
                widths[np.frombuffer(source, np.uint8) == 32] = 3
            align = np.repeat(np.arange(len(source)), widths)
            lead = len(space.encode()) if self.dummy_prefix else 0
            return out, np.concatenate([np.zeros(lead, np.int64), align, [len(source)]])
        return self._walk(text.encode(), space.encode())

    def _walk(self, source: bytes, space: bytes) -> tuple[str, np.ndarray]:
        steps, at = deque(), 0
        while at < len(source):
            hit = self.map.longest(source, at)
            if hit is None:
                head = source[at]
                n = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
                hit = n, source[at : at + n]
            steps.append((at, hit[1]))
            at += hit[0]
        if self.remove_extra:
            while steps and steps[0][1] == b" ":
                steps.popleft()
        if not steps:
            return "", np.array([at])
        out, align, after_space = bytearray(), [], False
        if self.dummy_prefix:
            out += space
            align += [steps[0][0]] * len(space)
            after_space = self.remove_extra
        for start, piece in steps:
            if self.remove_extra and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                shown = piece.replace(b" ", space)
                out += shown
                align += [start] * len(shown)
                after_space = piece.endswith(b" ")
        # Marks at the end go, those of the source as well as those that blanks became.
        while self.remove_extra and out.endswith(space):
            at = align[len(out) - len(space)]
            del out[len(out) - len(space) :], align[len(align) - len(space) :]
        return out.decode(), np.array([*align, at])


def _equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each kind, each span's kind): spans are of one kind if their bytes are equal."""
    _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if same_spans(data, starts, ends, first[inverse]).all():
        return first, inverse
    seen: dict[bytes, int] = {}
    inverse = np.array([seen.setdefault(joined[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.unique(inverse, return_index=True)[1], inverse


class Pieces:
    """A loaded model. Units are segmented once and remembered."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        pieces, kinds, model, norm, rest = [], [], 1, b"", bytearray()
        for field, _, value, start, end in _message(blob):
            if field == 1:
                parts = {f: v for f, _, v, _, _ in _message(value)}
                pieces.append(parts[1].decode())
                kinds.append(parts.get(3, NORMAL))
            elif field == 2:
                model = {f: v for f, _, v, _, _ in _message(value)}.get(3, 1)
            if field == 3:
                norm = value
            else:
                rest += blob[start:end]
        spec = {f: v for f, _, v, _, _ in _message(norm)}
        self.normalise = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        # The same model without normalisation: no map, prefix, removal or escaping.
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=bytes(rest) + b"\x1a\x06\x18\x00\x20\x00\x28\x00")
        self.by_unit = model == BPE and USER not in kinds and not any(_ACROSS.search(p) for p in pieces)
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.width = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(pieces, kinds, strict=True)], np.int64)
        self.source_width = self.width - [0 if k == BYTE else 2 * p.count(MARK) for p, k in zip(pieces, kinds, strict=True)]
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), -1)
        self.number = [str(i) for i in range(len(pieces))]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.starts, self.sizes, self.used = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def _learn(self, keys: list[bytes], units: list[str]) -> None:
        each = self.segmenter.encode(units, num_threads=1)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        slot, used = len(self.slots), self.used + int(sizes.sum())
        while slot + len(keys) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : used] = np.fromiter(chain.from_iterable(each), np.int32, used - self.used)
        self.starts[slot : slot + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[slot : slot + len(keys)] = sizes
        self.slots.update(zip(keys, range(slot, slot + len(keys)), strict=True))
        self.used = used
        self.bytes += sum(map(len, keys))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text, source byte where each piece starts, where it ends).

        Spans follow one another and cover the text; a piece made only of the added word mark is empty.
        """
        if self.by_unit and self.normalise.plain and self.normalise.escape and self.normalise.dummy_prefix:
            blobs = [t.encode() for t in texts]
            joined = b"".join([b" " + t for t in blobs if t])
            if MARK.encode() not in joined:
                return self._encode_plain(joined, np.array([len(t) for t in blobs], np.int64))
        done = [self.normalise(t) for t in texts]
        each = [np.array(ids, np.int32) for ids in self.segmenter.encode([n for n, _ in done], num_threads=1)]
        spans = [self._spans(ids, n, align) for ids, (n, align) in zip(each, done, strict=True)]
        counts = np.array([len(ids) for ids in each], np.int64)
        return np.concatenate([np.empty(0, np.int32), *each]), counts, *(np.concatenate([np.empty(0, np.int64), *(x[k] for x in spans)]) for k in (0, 1))

    def _encode_plain(self, joined: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """encode where normalisation only turns blanks into marks and adds one: units are the runs of bytes before a blank that follows another byte.

        The alignment is then arithmetic: a mark is one source byte, and the added one none.
        """
        counts = np.zeros(len(lengths), np.int64)
        if not joined:
            return np.empty(0, np.int32), counts, np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.slots) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        data = np.frombuffer(joined, np.uint8)
        full = np.flatnonzero(lengths)
        texts_at = np.cumsum(lengths[full] + 1) - lengths[full] - 1
        begins = data == 32
        begins[1:] &= ~begins[:-1]
        begins[texts_at] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        first, inverse = _equal_spans(data, starts, ends, joined)
        keys = [joined[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        slots = list(map(self.slots.get, keys))
        if None in slots:
            new = [k for k, slot in zip(keys, slots, strict=True) if slot is None]
            self._learn(new, [k.decode().replace(" ", MARK) for k in new])
            slots = list(map(self.slots.get, keys))
        slot = np.array(slots, np.int64)[inverse]
        sizes = self.sizes[slot]
        ids = self.ids[group_index(self.starts[slot], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = before[np.append(np.searchsorted(starts, texts_at), len(starts))]
        counts[full] = np.diff(at)
        reach = np.concatenate([[0], np.cumsum(self.source_width[ids])])
        # Each text's bytes start one after its added blank.
        origin = np.repeat(texts_at + 1, counts[full])
        return ids, counts, np.maximum(reach[:-1] - origin, 0), reach[1:] - origin

    def _spans(self, ids: np.ndarray, normalised: str, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self._unknown_widths(normalised) if (ids == self.unknown).any() else self.width[ids]
        edges = align[np.concatenate([[0], np.cumsum(width)])]
        return edges[:-1], edges[1:]

    def _unknown_widths(self, normalised: str) -> np.ndarray:
        """Widths of models without byte fallback, where an unknown piece has no fixed width."""
        return np.array([len(p.surface.encode()) for p in self.segmenter.encode(normalised, return_type="proto").pieces], np.int64)

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, word marks as blanks, without the added one; runs of bytes that are not UTF-8 as the library shows them."""
        if not self.normalise.plain:
            return self.library.decode(ids)
        joined = b"".join(map(self.surface.__getitem__, ids))
        if self.normalise.dummy_prefix and ids and self.surface[ids[0]][:1] == b" ":
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The model at a path that every worker can open."""
    return Pieces(path)


def encode_column(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep, `ids` array<int>, `starts` and `ends` array<int> (source bytes of each piece)."""

    def emit(b: pa.RecordBatch, done: tuple) -> list[pa.Array]:
        ids, counts, starts, ends = done
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return [*(b.column(c) for c in keep), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, starts, ends))]

    return encode_batches(docs, model, keep, text, emit, "ids array<int>, starts array<int>, ends array<int>", ["ids", "starts", "ends"])


def encode_batches(docs: DataFrame, model: str, keep: tuple[str, ...], text: str, emit: Callable, schema: str, names: list[str]) -> DataFrame:
    """Encodes whole texts slice by slice; emit turns (batch, what Pieces.encode returns) into the columns keep + names."""
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in slices(batches, "__text", 1 << 20):
            yield pa.RecordBatch.from_arrays(emit(b, pieces.encode(text_column(b, "__text").to_pylist())), names=[*keep, *names])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, {schema}")


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens, digests of the ids and of the decoded text, and the CRC of the piece ends in the source, for each document."""

    def emit(b: pa.RecordBatch, done: tuple) -> list[pa.Array]:
        pieces = load(model)
        ids, counts, _, ends = done
        number, edges, listed = pieces.number.__getitem__, np.concatenate([[0], np.cumsum(counts)]).tolist(), ids.tolist()
        own = [listed[s:e] for s, e in zip(edges, edges[1:], strict=False)]
        shown = [hashlib.sha256(",".join(map(number, x)).encode()).hexdigest() for x in own]
        decoded = [hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in own]
        crc = [zlib.crc32(ends[s:e]) for s, e in zip(edges, edges[1:], strict=False)]
        return [b.column("doc_id"), pa.array(counts), pa.array(shown, pa.string()), pa.array(decoded, pa.string()), pa.array(crc, pa.int64())]

    renamed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return encode_batches(renamed, model, ("doc_id",), "text", emit, "n_tokens long, ids_sha256 string, decoded_sha256 string, span_ends_crc32 long", ["n_tokens", "ids_sha256", "decoded_sha256", "span_ends_crc32"])
