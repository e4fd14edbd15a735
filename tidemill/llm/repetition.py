"""Quality rules on repetition within a text, by suffix arrays of its words.

Words are runs outside [\\x20\\x09-\\x0D], as they stand. The suffixes of all texts of a slice are sorted at once by prefix
doubling: words are numbered for each text by itself, so suffixes of different texts share nothing, and only suffixes that
still share their beginning with another one are sorted again. After WINDOW words, what is left are the suffixes whose
first WINDOW words come more than once; their longest common prefixes are found in the text's order, where each is at most one
shorter than the one before it. Intervals of the prefixes, closed by a stack, are the right-maximal repeats; those with different words
before them are maximal. A maximal repeat of SPAN words or more covers its occurrences; the union of these spans, as a share of the
code points in words, and the longest repeat are limited.

Every repeat lies within an occurrence of a maximal one, so the union is that of the longest repeat at each word. Occurrences may overlap: `a a a` repeats `a a`.

Null text is empty: no words, so it fails the base rule. Repeated rows and ids get a row each, null ids are kept. Extra columns are
ignored, whatever their names. Empty tables give no rows. Texts are never cut; a text longer than a slice is worked on alone,
in memory of some 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kernels import mix, raw, same_spans, slices, span_hashes, text_column, word_spans

#: Words of a window of the base rule; least words of a text; percent of words in repeated windows that the base rule allows.
WINDOW, LEAST_WORDS, BASE_SHARE = 5, 10, 20
#: The method's: least words of a repeat that counts, percent of the words' code points that such repeats may cover, most words of the longest one.
#: So a passage that comes twice fails a long text that the base rule lets pass, as do repeats of long words, and a sentence at the head and the foot of a short text does not.
SPAN, SHARE, LONGEST = 8, 25, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Text bytes handled at once.
_SLICE = 1 << 20


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words of one text only. Equal hashes are compared byte by byte."""
    hashes = mix(span_hashes(data, starts, ends) ^ mix(doc.astype(np.uint64), 3), 7)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    same = (doc[first[number]] == doc) & same_spans(data, starts, ends, first[number])
    if same.all():
        return number.astype(np.int64)
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault((d, data[a:z].tobytes()), len(seen)) for d, a, z in zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True)], np.int64)


class Suffixes:
    """Suffixes of WINDOW or more words in order; of those alone in their first WINDOW words only their place.

    array: the others' positions in order; prefix: words shared with the suffix before, 0 where fewer than WINDOW are.
    """

    def __init__(self, numbers: np.ndarray, edges: np.ndarray) -> None:
        """numbers: of the words of all texts; edges: where each text begins, and the end."""
        self.numbers, n = numbers, len(numbers)
        end = np.repeat(edges[1:], np.diff(edges))
        order = np.argsort(numbers, kind="stable")
        self.rank = np.empty(n, np.int64)
        self._settle(order, numbers[order], np.zeros(n, np.int64))
        for h, step in ((1, 1), (2, 2), (4, 1)):
            self._double(h, step, end)
        # Here suffixes share their first WINDOW words or are settled.
        self.window = self.active
        h = WINDOW
        self.groups = self.rank[self.window]
        while len(self.active):
            self._double(h, h, end)
            h *= 2
        at = np.argsort(self.rank[self.window])
        self.array = self.window[at]
        self._prefixes(self.groups[at], end)

    def _settle(self, ordered: np.ndarray, keys: np.ndarray, base: np.ndarray) -> None:
        """Ranks of suffixes in order, of which equal keys share one: base, that of the group they were in, and their place in it. Those that share one stay active."""
        n = len(ordered)
        fresh = np.ones(n, bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (base[1:] != base[:-1])
        outer = np.ones(n, bool)
        outer[1:] = base[1:] != base[:-1]
        place = np.arange(n)
        begin = np.maximum.accumulate(np.where(outer, place, 0))
        head = np.maximum.accumulate(np.where(fresh, place, 0))
        self.rank[ordered] = base + head - begin
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        self.active = ordered[~alone]

    def _double(self, h: int, step: int, end: np.ndarray) -> None:
        """From suffixes told apart by their first h words to h + step, with step <= h."""
        here = self.active
        if not len(here):
            return
        # What follows; a suffix that ends before comes first.
        there = here + step
        after = np.where(there < end[here], self.rank[np.minimum(there, len(self.rank) - 1)] + 1, 0)
        base = self.rank[here]
        keys = base * (len(self.rank) + 1) + after
        order = np.argsort(keys)
        self._settle(here[order], keys[order], base[order])

    def _prefixes(self, groups: np.ndarray, end: np.ndarray) -> None:
        """prefix, by the text's order of the suffixes: the words that one shares with the one before it in the array are at most one fewer than its predecessor in the text shares."""
        n = len(self.array)
        self.prefix = np.zeros(n, np.int64)
        if not n:
            return
        before = np.full(n, -1, np.int64)
        before[1:] = np.where(groups[1:] == groups[:-1], self.array[:-1], -1)
        by_text = np.argsort(self.array)
        numbers, last, shared, found = memoryview(np.ascontiguousarray(self.numbers)), -2, 0, [0] * n
        for k, (i, j, stop) in enumerate(zip(self.array[by_text].tolist(), before[by_text].tolist(), end[self.array[by_text]].tolist(), strict=True)):
            if j < 0:
                last = -2
                continue
            m = max(shared - 1, WINDOW) if last == i - 1 else WINDOW
            room = stop - max(i, j)
            while m < room and numbers[i + m] == numbers[j + m]:
                m += 1
            found[k], shared, last = m, m, i
        self.prefix[by_text] = found

    def longest_at(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, words of the longest repeat that begins there) of suffixes that share WINDOW words with another."""
        best = self.prefix.copy()
        if len(best):
            best[:-1] = np.maximum(best[:-1], self.prefix[1:])
        return self.array, best

    def maximal(self, least: int, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(position in the array, occurrences, words) of each maximal repeat of `least` words or more. first: whether a word begins its text."""
        use = self.prefix >= least
        if not use.any():
            return []
        left = np.where(first[self.array], -1 - self.array, self.numbers[self.array - 1] if len(self.numbers) else 0)
        out: list[tuple[int, int, int]] = []
        prefix, before = np.append(np.where(use, self.prefix, 0), 0).tolist(), left.tolist()
        # What stands on the stack: words of the interval, its begin, and the word before all of its suffixes (None: different ones).
        stack: list[list] = []
        for k in np.flatnonzero(use | np.append(use[1:], False)).tolist():
            here, begin, common = prefix[k + 1], k, before[k]
            while stack and stack[-1][0] > here:
                size, begin, word = stack.pop()
                common = word if word == common else None
                if common is None:
                    out.append((begin, k + 1 - begin, size))
                if stack and stack[-1][0] >= here:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == common else None
                    common = stack[-1][2]
            if here:
                if stack and stack[-1][0] == here:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == common else None
                else:
                    stack.append([here, begin, common])
        return out


def covered(positions: np.ndarray, sizes: np.ndarray, edges: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Words of each text, or the sum of their weights, that lie in position .. position + size - 1 for some entry."""
    marks = np.zeros(edges[-1] + 1, np.int64)
    np.add.at(marks, positions, 1)
    np.add.at(marks, positions + sizes, -1)
    inside = np.concatenate([[0], np.cumsum((np.cumsum(marks[:-1]) > 0) * (1 if weights is None else weights))])
    return inside[edges[1:]] - inside[edges[:-1]]


@dataclass
class Measures:
    """Figures of each text, by name."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_covered: np.ndarray
    covered_chars: np.ndarray
    longest: np.ndarray
    n_repeats: np.ndarray

    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > BASE_SHARE * self.n_words)

    def kept(self) -> np.ndarray:
        return ~self.base_failed() & (100 * self.covered_chars <= SHARE * self.word_chars) & (self.longest <= LONGEST)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measures(texts: pa.Array) -> Measures:
    """Figures of texts without nulls."""
    data, offsets = raw(texts)
    starts, ends = word_spans(data, offsets)
    edges = np.searchsorted(starts, offsets)
    n_words = np.diff(edges)
    doc = np.repeat(np.arange(len(texts)), n_words)
    # Code points: bytes that don't continue one; blanks are of one byte.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    sizes = np.concatenate([[0], np.cumsum(chars)])
    symbols = _per_text(_SYMBOL[data], offsets)
    found = Suffixes(word_numbers(data, starts, ends, doc), edges)
    at, longest = found.longest_at()
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc[at], longest)
    enough = longest >= SPAN
    first = np.zeros(len(starts), bool)
    first[edges[:-1][n_words > 0]] = True
    repeats = np.zeros(len(texts), np.int64)
    for k, _, _ in found.maximal(SPAN, first):
        repeats[doc[found.array[k]]] += 1
    lines = np.array([dup_lines(t) for t in texts.to_pylist()], np.int64)
    return Measures(
        n_words, np.diff(sizes[edges]), symbols, lines, covered(at, np.full(len(at), WINDOW), edges), covered(at[enough], longest[enough], edges), covered(at[enough], longest[enough], edges, chars),
        np.where(top >= SPAN, top, 0), repeats,
    )


def maximal_repeats(text: str, least: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """(words, occurrences, first words of the occurrences) of the maximal repeats of one text, longest first; least: WINDOW or more."""
    texts = pa.array([text])
    data, offsets = raw(texts)
    starts, ends = word_spans(data, offsets)
    found = Suffixes(word_numbers(data, starts, ends, np.zeros(len(starts), np.int64)), np.array([0, len(starts)]))
    first = np.arange(len(starts)) == 0
    out = [(size, n, sorted(found.array[k : k + n].tolist())) for k, n, size in found.maximal(max(least, WINDOW), first)]
    return sorted(out, key=lambda r: (-r[0], r[2]))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep with the base figures, base_failed, kept, and of repeats of SPAN words or more the words and code points covered, the longest and their number."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_covered", "covered_chars", "longest", "n_repeats"]
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", _SLICE):
            m = measures(text_column(b, "__text"))
            long = lambda name: pa.array(getattr(m, name).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), *map(long, names), pa.array(m.base_failed()), pa.array(m.kept()), *map(long, more)], names=[*keep, *names, "base_failed", "kept", *more]
            )

    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep]
    fields += [f"{c} long" for c in names] + ["base_failed boolean", "kept boolean"] + [f"{c} long" for c in more]
    return source.mapInArrow(run, ", ".join(fields))


def drop_repetitive(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, _SLICE):
            yield b.filter(pa.array(measures(text_column(b, text)).kept()))

    return docs.mapInArrow(run, docs.schema)
