"""Toxicity by weak supervision.

Many voters look at a text: one for each stem mined from labelled rows (a word, or the first letters of
words, much more frequent in toxic texts), one for each seed lexicon, and pattern voters (shouting,
runs of exclamation marks, masked words, insults aimed at the reader, several different stems, no hit at
all). A voter says toxic, clean or nothing. A generative label model estimates, by expectation-maximisation
over all texts outside the held-out fold, labelled or not, and from the votes alone, each voter's accuracy and the
correlations of voters given the label; voters that copy each other have one voice together. Known labels only choose
the stems: they neither start the estimation nor vote. Its posterior labels train a linear (logistic) classifier on the
voters' counts, which scores texts.

The estimation covers every row: texts with the same votes are one pattern with a count, and each round sums over the
patterns, on the executors, or here if they are few (see Tally). Stems are mined from, and the classifier is trained on,
at most TRAIN_ROWS labelled rows, those with the smallest hash of doc_id outside the held-out fold. They are read, compared
and counted on the executors; the driver receives their minimum hashes, the stems that pass, and the hits of the voters.

Scoring reads every whole text, and only the text. A repeated doc_id counts once in the sample, with its text of the smallest
hash, and in the estimation as often as it comes; a null one is scored, not fitted on. Null or empty text gets the score of a
text without any hit. Without labelled rows of both classes the seed lexicons decide alone. Other columns are not read, so
they may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import Forest
from tidemill.llm.kernels import mix, shingles, slices, text_column, word_hashes
from tidemill.llm.session import cut

#: Labelled rows that stems are mined from and the classifier is trained on, and the shortest stem of several words.
TRAIN_ROWS, STEM_LETTERS = 6_000, 4
#: Stems must have this log-odds and this log-likelihood ratio between toxic and clean texts (six chances in 100,000; chosen by cross-validation on training rows).
LOG_ODDS, LEAST_RATIO = 2.5, 16.0

SEEDS = {
    "insults": "idiot moron loser clown scum worthless pathetic stupid trash disgusting imbecile jerk dumb fool".split(),
    "German": "idiot dummkopf trottel arschloch abschaum widerlich erbärmlich versager blödmann".split(),
    "French": "idiot crétin imbécile connard débile ordure minable abruti dégoûtant".split(),
    "Spanish": "idiota imbécil estúpido basura asqueroso patético tonto inútil escoria".split(),
}
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}")
#: Part of every word of three or more capitals; no such word is missed.
_CAPITALS = re.compile(r"[A-Z\u0080-\U0010ffff]{3}")
_MASKED = re.compile(r"[A-Za-z][*@#$]{1,4}[A-Za-z]")
_AIMED = re.compile(r"\b(?:you|your|du|dein|tu|vous|usted|eres)\b(?:\W+\w+){0,3}?\W+([^\W\d_]+)", re.I)
PATTERNS = ("exclaiming", "shouting", "masked", "aimed", "several", "dense", "no hit")


@dataclass
class Model:
    """What scoring needs; of bounded size. stems: by name, with the voter's number; words count under the longest stem."""

    stems: dict[str, int]
    weights: list[float]
    bias: float
    accuracy: dict[str, float]
    correlated: list[list[int]]

    def dumps(self) -> str:
        return json.dumps(asdict(self))


def _stems_of(word: str) -> Iterator[str]:
    """Candidate stems of a lower-cased word: itself (marked) and its first letters."""
    yield "=" + word
    for k in range(STEM_LETTERS, STEM_LETTERS + 3):
        if len(word) >= k:
            yield word[:k]


def held_out(doc_id: str, of: int = 5) -> bool:
    return zlib.crc32(doc_id.encode()) % of == 0


#: Bands, and minimum hashes in each, by which near copies among the training texts are told.
BANDS, ROWS_IN_BAND = 8, 3


def signatures(texts: pa.Array) -> list[bytes]:
    """Minimum hashes of each text's three-word shingles; empty for a text without words."""
    flat, sizes = shingles(*word_hashes(texts), 3)
    out = [b""] * len(texts)
    full = np.flatnonzero(sizes)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        least = np.stack([np.minimum.reduceat(mix(flat, 50 + k), begin) for k in range(BANDS * ROWS_IN_BAND)], axis=1)
        for d, row in zip(full.tolist(), least, strict=True):
            out[d] = row.tobytes()
    return out


def near_copy_groups(marks: list[bytes]) -> list[int]:
    """A number for each signature, mostly the same for near copies: those that agree in a band."""
    forest, seen, width = Forest(), {}, 8 * ROWS_IN_BAND
    for d, mark in enumerate(marks):
        for k in range(len(mark) // width):
            forest.union(d, seen.setdefault((k, mark[k * width : (k + 1) * width]), d))
    return [forest.root(d) for d in range(len(marks))]


def text_stems(text: str) -> set[str]:
    return {s for w in set(_WORD.findall(text.lower())) for s in _stems_of(w)}


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def likelihood_ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Twice the log ratio of the stem's share of toxic texts against that of all texts."""
    expected = (toxic + clean) * n_toxic / (n_toxic + n_clean)
    return 2 * sum(n * float(np.log(n / e)) for n, e in ((toxic, expected), (clean, toxic + clean - expected)) if n)


def chosen_stems(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Of (stem, toxic texts, clean texts) those that LOG_ODDS and LEAST_RATIO let pass, in order of log-odds; a stem is dropped where a kept one is its beginning or is its word."""
    odds = {s: v for s, *n in counts if (v := log_odds(*n, n_toxic, n_clean)) >= LOG_ODDS and likelihood_ratio(*n, n_toxic, n_clean) >= LEAST_RATIO}
    kept: dict[str, None] = {}
    for s in sorted(odds, key=lambda s: (-odds[s], len(s), s)):
        word = s.lstrip("=")
        if not any(word[:k] in kept for k in range(STEM_LETTERS, min(len(word), STEM_LETTERS + 2) + 1)):
            kept[s] = None
    return list(kept)


def voters_of(stems: list[str]) -> list[str]:
    return [*stems, *(f"seed:{name}" for name in SEEDS), *(f"pattern:{p}" for p in PATTERNS)]


_SEED_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(SEEDS.values()):
    for _w in _words:
        _SEED_OF.setdefault(_w, []).append(_k)


#: Words whose stem a worker remembers before it starts over.
REMEMBERED = 60_000


class Lookup(dict):
    """Lower-cased word: (stem's voter or None, seed voters), or None for a word without either; filled as words come."""

    def __init__(self, stems: dict[str, int]) -> None:
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> tuple | None:
        at = next((v for s in _stems_of(word) if (v := self.stems.get(s)) is not None), None)
        seeds = _SEED_OF.get(word, ())
        found = (at, seeds, word if at is None else at) if at is not None or seeds else None
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def hit_counts(text: str, lookup: Lookup) -> np.ndarray:
    """Hits of each voter: stems and seeds count words, patterns count what they look for."""
    n_stems = len(lookup.stems)
    out = np.zeros(n_stems + len(SEEDS) + len(PATTERNS))
    words = _WORD.findall(text.lower())
    hits = [h for h in map(lookup.__getitem__, words) if h]
    for at, seeds, _ in hits:
        if at is not None:
            out[at] += 1
        for s in seeds:
            out[n_stems + s] += 1
    p = n_stems + len(SEEDS)
    if "!!" in text:
        out[p] = sum(1 for _ in _SHOUT.finditer(text))
    if _CAPITALS.search(text):
        out[p + 1] = sum(1 for w in _WORD.findall(text) if len(w) > 2 and w.isupper()) / max(1, len(words))
    if "*" in text or "@" in text or "#" in text or "$" in text:
        out[p + 2] = sum(1 for _ in _MASKED.finditer(text))
    if hits:
        out[p + 3] = sum(1 for m in _AIMED.finditer(text) if lookup[m[1].lower()])
    out[p + 4] = len({h[2] for h in hits})
    out[p + 5] = len(hits) / max(20, len(words))
    out[p + 6] = not hits
    return out


def votes_of(counts: np.ndarray) -> np.ndarray:
    """+1 toxic, -1 clean, 0 nothing, for rows of hit counts."""
    votes = (counts > 0).astype(np.int8)
    p = counts.shape[1] - len(PATTERNS)
    votes[:, p] = counts[:, p] >= 3
    votes[:, p + 1] = counts[:, p + 1] > 0.3
    votes[:, p + 4] = counts[:, p + 4] >= 2
    votes[:, p + 5] = counts[:, p + 5] > 0.01
    votes[:, p + 6] = np.where(counts[:, p + 6] > 0, -1, 0)
    return votes


@dataclass
class LabelModel:
    """P(vote | label) of each voter, the prior, and the groups of correlated voters with their mean correlation."""

    table: np.ndarray
    prior: float
    groups: list[list[int]]
    shared: list[float]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes). n voters of a group with mean correlation r count as n / (1 + (n - 1) * r) independent ones, so copies have one voice."""
        ratio = np.log(self.table[:, 1, :]) - np.log(self.table[:, 0, :])
        weight = np.ones(len(ratio))
        for g, r in zip(self.groups, self.shared, strict=True):
            weight[g] = 1 / (1 + (len(g) - 1) * r)
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, w in enumerate(weight.tolist()):
            logit += w * ratio[j][votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def majority(votes: np.ndarray) -> np.ndarray:
    """Where the estimation starts: each toxic vote halves the distance to certainty; without any, 0.02."""
    toxic = (votes > 0).sum(axis=1)
    return np.where(toxic > 0, 1 - 0.5 ** np.minimum(toxic, 5.0), 0.02)


def vote_sums(votes: np.ndarray, n: np.ndarray, now: LabelModel | None, before: LabelModel | None) -> np.ndarray:
    """Over patterns of votes that come n times: for clean, then toxic, the weight of the label and of each voter's three votes under it, as the model now says (None: the start); last the largest change since the model before."""
    p = majority(votes) if now is None else now.posterior(votes)
    change = 0.0 if now is None or not len(p) else np.abs(p - (majority(votes) if before is None else before.posterior(votes))).max()
    out = []
    for w in ((1 - p) * n, p * n):
        out += [[w.sum()], *((w @ (votes == v)) for v in (-1, 0, 1))]
    return np.concatenate([*out, [change]])


def vote_moments(votes: np.ndarray, n: np.ndarray, now: LabelModel) -> np.ndarray:
    """For toxic, then clean: weight, weighted sums of the votes and of their products."""
    p, x = now.posterior(votes), votes.astype(float)
    return np.concatenate([part for w in (p * n, (1 - p) * n) for part in ([w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel())])


#: Patterns up to which they are summed up on the driver.
HERE = 20_000


class Tally:
    """Distinct patterns of votes with their counts: arrays here, or a table of (votes binary, n long) on the executors."""

    def __init__(self, votes: np.ndarray | None = None, n: np.ndarray | None = None, table: DataFrame | None = None, voters: int = 0) -> None:
        self.votes, self.n, self.table = votes, n, table
        self.voters = voters or votes.shape[1]

    @classmethod
    def of(cls, table: DataFrame, voters: int, here: int = HERE) -> Tally:
        if table.count() > here:
            return cls(table=table, voters=voters)
        rows = table.collect()
        return cls(np.array([np.frombuffer(r["votes"], np.int8) for r in rows], np.int8).reshape(-1, voters), np.array([r["n"] for r in rows], float), voters=voters)

    def _added(self, sums) -> np.ndarray:
        """Sums of sums(votes, n) over all patterns; of the last one the largest."""
        if self.table is None:
            return sums(self.votes, self.n)
        voters = self.voters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                votes = np.array([np.frombuffer(v, np.int8) for v in b.column("votes").to_pylist()], np.int8).reshape(-1, voters)
                found = sums(votes, b.column("n").to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["at", "v"])

        rows = sorted(self.table.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"), F.max("v").alias("most")).collect(), key=lambda r: r["at"])
        return np.array([r["v"] for r in rows[:-1]] + [r["most"] for r in rows[-1:]])

    def sums(self, now: LabelModel | None, before: LabelModel | None) -> np.ndarray:
        return self._added(lambda votes, n: vote_sums(votes, n, now, before))

    def moments(self, now: LabelModel) -> np.ndarray:
        return self._added(lambda votes, n: np.append(vote_moments(votes, n, now), 0.0))[:-1]


def estimated(tally: Tally, rounds: int = 40, strong: float = 0.7) -> LabelModel:
    """EM on the votes alone. A voter is never worse than chance: what it says toxic of is at least as likely toxic.

    First each voter stands alone; then those whose votes correlate by `strong` or more given the label, as far as
    it is known by now, form groups, and the estimation goes on.
    """
    m = tally.voters
    model, groups, shared = None, [[k] for k in range(m)], [0.0] * m
    sums = tally.sums(None, None)
    for phase in (0, 1):
        if phase:
            groups, shared = _groups(tally.moments(model), m, strong)
        for _ in range(rounds // 2):
            table, weights = np.empty((m, 2, 3)), sums[:-1].reshape(2, 1 + 3 * m)
            for y in (0, 1):
                table[:, y, :] = (weights[y, 1:].reshape(3, m).T + 0.5) / (weights[y, 0] + 1.5)
            table[:, 1, 2] = np.maximum(table[:, 1, 2], table[:, 0, 2])
            table[:, 0, 0] = np.maximum(table[:, 0, 0], table[:, 1, 0])
            prior = weights[1, 0] / max(weights[:, 0].sum(), 1e-9)
            before, model = model, LabelModel(table, float(np.clip(prior, 0.01, 0.99)), groups, shared)
            sums = tally.sums(model, before)
            if sums[-1] < 1e-4:
                break
    return model


def fit_label_model(votes: np.ndarray, rounds: int = 40, strong: float = 0.7) -> LabelModel:
    """estimated() of rows of votes."""
    return estimated(Tally(votes, np.ones(len(votes))), rounds, strong)


def _groups(moments: np.ndarray, m: int, strong: float) -> tuple[list[list[int]], list[float]]:
    """(connected groups of voters by correlation within the labels, weighted by the posterior; mean correlation of each group)."""
    cov = np.zeros((m, m))
    for part in moments.reshape(2, -1):
        cov += part[1 + m :].reshape(m, m) - np.outer(part[1 : 1 + m], part[1 : 1 + m]) / max(part[0], 1e-9)
    size = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    near = np.abs(cov / np.outer(size, size))
    left, groups, shared = set(range(len(near))), [], []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            more = [j for j in np.flatnonzero(near[i] >= strong).tolist() if j in left]
            left -= set(more)
            todo += more
        groups.append(sorted(group))
        own, n = near[np.ix_(group, group)], len(group)
        shared.append(float((own.sum() - np.trace(own)) / (n * (n - 1))) if n > 1 else 0.0)
    return groups, shared


def _design(counts: np.ndarray, merged: list[list[int]]) -> np.ndarray:
    """Classifier inputs: damped counts, those of correlated stems and seeds added up under the first; shares as they are."""
    x = counts.copy()
    p = counts.shape[1] - len(PATTERNS)
    for g in merged:
        x[:, g[0]] = counts[:, g].sum(axis=1)
        x[:, g[1:]] = 0
    x = np.log1p(x)
    for k in (p + 1, p + 6):
        x[:, k] = counts[:, k]
    x[:, p + 5] = np.minimum(counts[:, p + 5] * 20, 2)
    return x


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; the bias is not penalised."""
    full = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(full.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(full.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (q - target) + ridge * w
        hess = (full * (q * (1 - q))[:, None]).T @ full + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def seeds_only(names: list[str]) -> Model:
    """The model without labelled rows: any seed word makes a text toxic."""
    return Model({}, [4.0 if n.startswith("seed:") else 0.0 for n in names], -3.0, {}, [])


def fit(stems: list[str], counts: np.ndarray, tally: Tally) -> Model:
    """The model of the voters' patterns, with the classifier trained on the hits of the sample's texts, one row a text."""
    names = voters_of(stems)
    model = estimated(tally)
    merged = [own for g in model.groups if len(own := [k for k in g if k < len(names) - len(PATTERNS)]) > 1]
    weights, bias = fit_linear(_design(counts, merged), model.posterior(votes_of(counts)))
    right = {name: float(model.table[k, 1, 2] / (model.table[k, 1, 2] + model.table[k, 0, 2])) for k, name in enumerate(names)}
    return Model({s: k for k, s in enumerate(stems)}, weights.tolist(), bias, right, merged)


def scores_of(counts: np.ndarray, model: Model) -> np.ndarray:
    """The scores of rows of hit counts."""
    return 1 / (1 + np.exp(-np.clip(_design(counts, model.correlated) @ np.array(model.weights) + model.bias, -30, 30)))


def scores(texts: list[str], model: Model, lookup: Lookup | None = None) -> np.ndarray:
    if not texts:
        return np.empty(0)
    lookup = Lookup(model.stems) if lookup is None else lookup
    return scores_of(np.stack([hit_counts(t, lookup) for t in texts]), model)


def fits(doc_id: str = "doc_id") -> Column:
    """Whether a row is outside the held-out fold: crc32(doc_id as text) mod 5 is not 0. Null ids are not fitted on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, toxic): at most `rows` labelled documents, of those outside the held-out fold the ones of the smallest id hash, so a fixed choice."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(fits())
    known = labels.where(F.col("toxic").isin(0, 1)).where(fits()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Of documents only: labels of rows that are not there would take the others' place.
    ids = texts.select("doc_id").join(known, "doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("best")).select("doc_id", "best.text", "toxic")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(signatures(text_column(b)), pa.binary())], names=["doc_id", "toxic", "mark"])


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, toxic texts, clean texts), counted within the slice."""
    for b in slices(batches):
        toxic, clean = Counter(), Counter()
        for text, label in zip(text_column(b).to_pylist(), b.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(text_stems(text))
        stems = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([c[s] for s in stems], pa.int64()) for c in (toxic, clean))], names=["stem", "toxic", "clean"])


def mined_stems(sample: DataFrame) -> list[str]:
    """Stems of the rows of sample; of near copies with one label the text of the smallest id counts. None without both classes."""
    marks = sorted(sample.mapInArrow(_marked, "doc_id long, toxic int, mark binary").collect(), key=lambda r: r["doc_id"])
    groups = near_copy_groups([bytes(r["mark"]) for r in marks])
    first: dict[tuple[int, int], int] = {}
    for r, g in zip(marks, groups, strict=True):
        first.setdefault((r["toxic"], g), r["doc_id"])
    n_toxic = sum(label for label, _ in first)
    n_clean = len(first) - n_toxic
    if not n_toxic or not n_clean:
        return []
    chosen = sample.sparkSession.createDataFrame([(d,) for d in first.values()], "doc_id long")
    counts = sample.join(F.broadcast(chosen), "doc_id").mapInArrow(_stem_rows, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    enough = counts.where(F.ln((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) >= LOG_ODDS + float(np.log((n_toxic + 1) / (n_clean + 1))) - 1e-9)
    return chosen_stems([(r["stem"], r["toxic"], r["clean"]) for r in enough.collect()], n_toxic, n_clean)


def hits_of(rows: DataFrame, stems: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and the hits of each voter on `text`, sparse: (at array<int>, n array<double>)."""
    source = rows.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup({s: k for k, s in enumerate(stems)})
        for b in slices(batches, "__text"):
            found = [hit_counts(t, lookup) for t in text_column(b, "__text").to_pylist()]
            at = [np.flatnonzero(r) for r in found]
            lists = (pa.array([k.tolist() for k in at], pa.list_(pa.int32())), pa.array([r[k].tolist() for r, k in zip(found, at, strict=True)], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *lists], names=[*keep, "at", "n"])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, at array<int>, n array<double>")


#: Rows of hits made dense at once.
_DENSE = 2048


def _dense(hits: pa.RecordBatch, voters: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(slice, its hits as rows of numbers)."""
    for k in range(0, hits.num_rows, _DENSE):
        b = hits.slice(k, _DENSE)
        counts = np.zeros((b.num_rows, voters))
        at, n = b.column("at"), b.column("n")
        row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
        counts[row, at.flatten().to_numpy(zero_copy_only=False)] = n.flatten().to_numpy(zero_copy_only=False)
        yield b, counts


def vote_patterns(hits: DataFrame, voters: int) -> DataFrame:
    """(votes binary, n long): the distinct patterns of votes, a byte a voter, and how many rows have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, counts in _dense(batch, voters):
                found = Counter(v.tobytes() for v in votes_of(counts))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["votes", "n"])

    return hits.select("at", "n").mapInArrow(run, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def _fitted(sample: DataFrame, stems: list[str], hits: DataFrame) -> Model:
    """The model of the sample and of the hits of all texts that are fitted on."""
    names = voters_of(stems)
    if not stems:
        return seeds_only(names)
    found = sorted(hits_of(sample, stems).collect(), key=lambda r: r["doc_id"])
    counts = np.zeros((len(found), len(names)))
    for k, r in enumerate(found):
        counts[k, r["at"]] = r["n"]
    return fit(stems, counts, Tally.of(cut(vote_patterns(hits, len(names))), len(names)))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model; reads all texts once for the votes."""
    sample = cut(training_rows(docs, labels, rows))
    stems = mined_stems(sample)
    return _fitted(sample, stems, hits_of(docs.select("doc_id", "text").where(fits()), stems))


def fit_and_score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score double): the model fitted on docs and the scores of all its rows, by one reading of the texts for both; the hits are written between."""
    sample = cut(training_rows(docs, labels, rows))
    stems = mined_stems(sample)
    hits = cut(hits_of(docs.select("doc_id", "text", (~fits() & F.col("doc_id").isNotNull()).alias("held_out")), stems, ("doc_id", "held_out")))
    model = _fitted(sample, stems, hits.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    voters = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, counts in _dense(batch, voters):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores_of(counts, model))], names=["doc_id", "held_out", "score"])

    return hits.mapInArrow(run, f"doc_id {hits.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in keep and `score` double. The model travels in the task; its size is bounded by the sample that it is fitted on."""
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.stems)
        for b in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores(text_column(b, "__text").to_pylist(), model, lookup))], names=[*keep, "score"])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, score double")


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.stems)
        for b in slices(batches, text):
            yield b.filter(pa.array(scores(text_column(b, text).to_pylist(), model, lookup) < threshold))

    return docs.mapInArrow(run, docs.schema)
