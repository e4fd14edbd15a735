"""Operators that learn from or compare the whole corpus, against brute force."""

import math
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same, duck

from tidemill.llm import components, jaccard_join, kernels, lm_scoring, packing, registry, toxicity, url_filter

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n", "a", "one two", "One TWO", "a b c d e", "é ß 日本 x y z", "w " * 4000, None]


@pytest.fixture(scope="module")
def texts():
    return dict(duck(SF).execute("select doc_id, text from documents").fetchall())


def odd_docs(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id here", 2)], "doc_id long, text string, score int")


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def slow_components(rows, percent=75):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], math.inf if d is None else d)
    return sorted((-1 if d is None else d, len(s), -1 if least[root(i)] == math.inf else least[root(i)]) for i, (d, s) in enumerate(sets))


def found_components(df):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def near_copies(seed, groups, each, words=60, edits=3):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(each):
            t = list(base)
            for _ in range(rng.randrange(edits)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(t))
    passage = [f"p{k}" for k in range(55)]
    out += [" ".join([*passage, *(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))]) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_jaccard_matches_sql(spark):
    assert_same(registry.op2_ngram_jaccard(spark, SF), SF, registry.QUERIES["op2_ngram_jaccard"][1])


def test_jaccard_of_near_copies(spark):
    rows = near_copies(1, 12, 8)
    assert found_components(jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_components(rows)


def test_jaccard_with_crowded_shingles(spark):
    """Small limits, so that frequent shingles, crowded buckets and several blocks occur."""
    rows = near_copies(2, 2, 130, edits=9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_components(rows)
    for limits in (jaccard_join.Limits(in_window=2, hot_from=5, pairs_up_to=6, block=16), jaccard_join.Limits(hot_from=10**9, pairs_up_to=3, block=8, window=500)):
        assert found_components(jaccard_join.similar_documents(docs, limits=limits)) == want


def test_jaccard_tells_structured_words_apart(spark):
    word = "a"
    rows = []
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 1024:
            rows += [(len(rows), word), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    assert found_components(jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == [(k, 1, k) for k in range(len(rows))]


def test_jaccard_holds_few_pairs_at_once(spark):
    rows = near_copies(5, 3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_components(jaccard_join.similar_documents(docs, limits=jaccard_join.Limits(pairs_held=50))) == slow_components(rows)


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_jaccard_moves_sets_a_few_times_only(spark):
    """What is shuffled follows the documents, not the pairs of near copies: six times as many in each group make six times as many documents, but 37 times as many pairs."""
    moved = {}
    for each in (20, 120):
        rows = [(d, t) for d, t in near_copies(5, 4, each, words=800, edits=8) if " p54" not in t]
        docs, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(8), shuffled(spark)
        found = jaccard_join.similar_documents(docs).select("component_id").distinct().count()
        assert found == 4
        moved[each] = shuffled(spark) - before
    assert moved[120] < 9 * moved[20], moved


def test_jaccard_reports_a_pair_once():
    """Near copies meet in all fragments, but a pair is about one row; no pair of links is left out."""
    rows = [(d, t) for d, t in near_copies(5, 4, 12, words=800, edits=4) if " p54" not in t]
    cuts, bins = 64, 1 << 14
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    held = defaultdict(list)
    for b in jaccard_join._prefix_entries(5, 75, (np.arange(bins) * cuts // bins).astype(np.int32), 1, np.empty(0, np.uint64))([batch]):
        for part, blob in zip(b.column("part").to_pylist(), b.column("entries").to_pylist(), strict=True):
            held[part].append(blob)
    met = Counter()
    for part, blobs in held.items():
        entries = pa.RecordBatch.from_pydict({"part": pa.array([part] * len(blobs), pa.int32()), "entries": pa.array(blobs, pa.binary())})
        for b in jaccard_join._meet(75, cuts, jaccard_join.Limits())([entries]):
            met.update(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
    sets = {}
    for d, t in rows:
        flat, sizes = kernels.shingle_sets(pa.array([t]), 5)
        sets[int(jaccard_join._nodes(flat, sizes).view(np.int64)[0])] = shingle_set(t)
    linked = {frozenset((a, b)) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(held) > 16 and len(linked) > 100
    assert linked <= {frozenset(x) for x in met}
    assert sum(met.values()) < 3 * len(linked), (sum(met.values()), len(linked))


def test_jaccard_compares_small_groups_by_rounds(spark):
    """Groups of six have three pairs for each node with a smaller one; a round takes one of them."""
    pairs = [(10 * g + a, 10 * g + b, 50, 50, True) for g in range(3) for a in range(6) for b in range(a + 1, 6)]
    now = jaccard_join._one_each(spark.createDataFrame(pairs, "a long, b long, na long, nb long, sure boolean"))
    assert sorted((r["a"], r["b"]) for r in now.collect()) == [(10 * g, 10 * g + b) for g in range(3) for b in range(1, 6)]


def test_jaccard_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert found_components(jaccard_join.similar_documents(docs)) == slow_components([(r[0], r[1]) for r in docs.collect()])
    assert jaccard_join.similar_documents(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 2000 + k) for k in range(200)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    forest = components.Forest()
    for a, b in edges:
        if a is not None and a != b:
            forest.union(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for one_task in (components.ONE_TASK, 0):
        got = {r["node"]: r["root"] for r in components.components(df, one_task).collect()}
        assert got == {x: forest.root(x) for x in forest.parent}
    assert components.components(df.limit(0)).collect() == []


def slow_base(rows):
    docs = [(d, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    counts = Counter(w for (_, ws), h in zip(docs, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((-1 if d is None else d, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, ws), h in zip(docs, held))


def found_base(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_base_scores(spark, texts):
    rows = registry.op3_lm_scoring(spark, SF).collect()
    assert found_base(rows) == slow_base(list(texts.items()))
    assert all(r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = lm_scoring.score_documents(docs).collect()
    assert found_base(rows) == slow_base([(r[0], r[1]) for r in docs.collect()])
    assert lm_scoring.score_documents(docs.limit(0)).collect() == []
    assert found_base(lm_scoring.score_documents(docs.repartition(3)).collect()) == found_base(rows)


def local_model(rows, limit=400, fragments=(3, 5)):
    """The operator's steps without Spark: (constants, windows, answers by window) over (doc, text) rows."""
    batch = pa.record_batch({"doc": pa.array([d for d, _ in rows], pa.int64()), "version": pa.array(list(range(len(rows)))), "text": pa.array([t for _, t in rows], pa.string())})
    parts, windows = defaultdict(list), list(lm_scoring.windows([batch], 0, limit))
    for w in windows:
        for r in lm_scoring.asked(w, fragments, 7, 2).to_pylist():
            parts[r["part"]].append((r["home"], r["number"], r["mark"], pa.py_buffer(r["entries"])))
    found, stats = defaultdict(dict), []
    for part, questions in parts.items():
        for b in lm_scoring.answers(part, questions, fragments[0]):
            for r in b.to_pylist():
                if r["what"]:
                    stats.append(r)
                else:
                    found[r["number"]][part] = (r["mark"], r["n"], r["a"], r["b"])
    add = lambda what, c: sum(r[c] for r in stats if r["what"] == what)
    levels = defaultdict(lambda: [0, 0])
    for r in stats:
        if r["what"] == 3:
            levels[r["part"]][0] += r["n"]
            levels[r["part"]][1] += r["total"]
    total, distinct = add(1, "total"), add(1, "n")
    model = lm_scoring.Model(total, distinct, lm_scoring.weight_of([tuple(v) for v in levels.values()], add(2, "once"), total), fragments[0])
    return model, windows, found


def slow_lm(rows, model, fragments=(3, 5)):
    """log10 P(w | v) by dictionaries of exact counts, quantised and scaled class by class. Words are bytes, START and END None."""
    single, pairs, seen = Counter(), Counter(), {}
    for d, t in rows:
        ws = [*(t or "").encode().lower().split(), None]
        if not lm_scoring.is_held_out(d, 7, 2):
            single.update(ws)
            pairs.update(zip([None, *ws], ws))

    def word_hash(w, end):
        if w is None:
            return lm_scoring.END if end else lm_scoring.START
        if w not in seen:
            seen[w] = kernels.word_hashes(pa.array([w], pa.binary()).cast(pa.string()))[0][0]
        return seen[w]

    def fragment(h, n):
        return int(lm_scoring.fragment_of(np.array([h], np.uint64), n)[0])

    def pair_fragment(v, w):
        return fragment(lm_scoring.bigram_hashes(np.array([word_hash(w, True)]), np.array([word_hash(v, False)]))[0], fragments[1])

    q = lambda c: lm_scoring.COUNTS[int(lm_scoring.levels_of(np.array([c]))[0])] if c else 0.0
    exact, rough = Counter(), Counter()
    for w, c in single.items():
        exact[fragment(word_hash(w, True), fragments[0])] += c
        rough[fragment(word_hash(w, True), fragments[0])] += q(c)
    for (v, w), c in pairs.items():
        exact[v, pair_fragment(v, w), "pair"] += c
        rough[v, pair_fragment(v, w), "pair"] += q(c)

    def p(w, v):
        f, k = fragment(word_hash(w, True), fragments[0]), (v, pair_fragment(v, w), "pair")
        lower = (q(single[w]) * exact[f] / (rough[f] or 1) + 1) / (model.total + model.distinct + 1)
        both = q(pairs[v, w]) * exact[k] / (rough[k] or 1)
        return (both + model.weight * lower) / (single[v] + model.weight)

    return p, single


def test_lm_scores_match_a_slow_model(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(40)))) for k in range(150)] + [(None, "W1 w2"), (3, None), (500, " ".join(vocabulary * 20))]
    model, windows, found = local_model(rows)
    p, single = slow_lm(rows, model)
    assert model.total == sum(single.values()) and model.distinct == len(single) and any(w.home != w.number for w in windows)
    got = defaultdict(float)
    for w in windows:
        logs, _, _, sizes = lm_scoring.bigram_logs(w, found[w.number], model)
        at = 0
        for d, v, n in zip(w.rows.column("doc").to_pylist(), w.rows.column("version").to_pylist(), sizes.tolist()):
            got[d, v] += logs[at : at + n].sum()
            at += n
    for k, (d, t) in enumerate(rows):
        ws = [*(t or "").encode().lower().split(), None]
        assert abs(got[d, k] - sum(math.log10(p(w, v)) for v, w in zip([None, *ws], ws))) < 1e-4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = sorted(r["score"] for r in lm_scoring.score_documents(docs).collect())
    assert len(scores) == len(got) and np.allclose(scores, sorted(got.values()), rtol=0.05)


def test_lm_probabilities_sum_to_one():
    """Held-out texts that set every word of the vocabulary, and an unknown one, after each of 100 contexts."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 200)))) for k in range(600)]
    out = next(d for d in range(1000, 2000) if lm_scoring.is_held_out(d, 7, 2))
    seen = sorted({w for d, t in rows if not lm_scoring.is_held_out(d, 7, 2) for w in t.split()})
    contexts = [*seen[:60], *rng.sample(seen, 39), "never"]
    asked = [(out, " ".join(f"{v} {w}" for w in [*seen, "unknown"])) for v in contexts]
    model, windows, found = local_model([*rows, *asked, *((out, v) for v in contexts)], limit=10**9)
    (w,) = windows
    logs, _, words, sizes = lm_scoring.bigram_logs(w, found[0], model)
    at = int(sizes[: len(rows)].sum())
    for k in range(len(contexts)):
        n = int(sizes[len(rows) + k])
        own = (10 ** logs[at : at + n])[1:-1:2].sum()
        end = 10 ** logs[int(sizes[: len(rows) + len(contexts) + k].sum()) + 1]
        assert abs(own + end - 1) < 1e-3
        at += n


def test_filter_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    counts = (rng.pareto(1, len(keys)) + 1).astype(np.int64)
    level = (one := lm_scoring.Slice(keys, counts)).levels(keys)
    want = lm_scoring.levels_of(counts)
    assert (level >= want).all() and (level == want).mean() > 0.9999
    assert (one.levels(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) > 0).mean() < 1e-3
    assert (lm_scoring.Slice(keys[:0], counts[:0]).levels(keys) == 0).all()
    assert [lm_scoring.COUNTS[k] for k in (1, 2, 3)] == [1, 2, 3]


def slow_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def slow_codes(url):
    out = []
    for c in (url or "").lower():
        c = "0" if c in "123456789" else c
        out.append(url_filter.SHOWN.index(c) + 1 if c in url_filter.SHOWN else url_filter.OTHER)
    return [0] * 3 + out + [0]


def slow_model(examples):
    """log ratio of a cell by the interpolated models of (codes, accepted) examples."""
    grams = {True: [Counter() for _ in range(4)], False: [Counter() for _ in range(4)]}
    for code, accepted in examples:
        for i in range(3, len(code)):
            for k in range(4):
                grams[accepted][k][tuple(code[i - k : i + 1])] += 1
    stats = {a: [(defaultdict(int), defaultdict(int)) for _ in range(4)] for a in grams}
    for a in grams:
        for k in range(4):
            for g, n in grams[a][k].items():
                stats[a][k][0][g[:-1]] += n
                stats[a][k][1][g[:-1]] += 1

    def logp(a, g):
        p = 1 / url_filter.SIZE
        for k in range(4):
            tail = g[3 - k :]
            n, kinds = stats[a][k][0][tail[:-1]], stats[a][k][1][tail[:-1]]
            if n:
                p = (grams[a][k][tail] + kinds * p) / (n + kinds)
        return math.log(p)

    return lambda g: logp(True, g) - logp(False, g)


def check_urls(spark, urls, rows):
    """The rows against slow models over urls (by id); returns (scores of those without a rule, threshold)."""
    folds = {r["page_id"]: r["f"] for r in spark.createDataFrame(list(urls.items()), "page_id long, url string").selectExpr("page_id", "pmod(xxhash64(url), 5) as f").collect()}
    ruled = {k: slow_rule(u) for k, u in urls.items()}
    examples = {k: r[3] == "allow" for k, r in ruled.items() if r[3]}
    models = [slow_model([(slow_codes(urls[k]), y) for k, y in examples.items() if folds[k] != f]) for f in range(url_filter.FOLDS + 1)]

    def score(u, model):
        c = slow_codes(u)
        return sum(model(tuple(c[i - 3 : i + 1])) for i in range(3, len(c))) / (len(c) - 3)

    out = {y: np.array([score(urls[k], models[folds[k]]) for k, own in examples.items() if own == y]) for y in (True, False)}
    pooled = sum(((x - x.mean()) ** 2).sum() for x in out.values()) / len(examples)
    dev = {y: max(url_filter.LEAST_DEVIATION, math.sqrt((((x - x.mean()) ** 2).sum() + url_filter.POOLED * pooled) / (len(x) + url_filter.POOLED))) for y, x in out.items()}
    threshold = (out[True].mean() * dev[False] + out[False].mean() * dev[True]) / (dev[True] + dev[False])
    free = {}
    for r in rows:
        host, path, rule, verdict = ruled[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if verdict is None:
            s = free[r["page_id"]] = score(urls[r["page_id"]], models[-1])
            assert abs(s - r["score"]) < 1e-4
            verdict = ("allow" if s >= threshold else "block") if abs(s - threshold) > 1e-4 else r["verdict"]
        assert r["verdict"] == verdict
    return free, threshold, {k: score(urls[k], models[-1]) for k, y in examples.items() if y}


def test_url_filter(spark):
    urls = dict(duck(SF).execute("select page_id, url from pages").fetchall())
    rows = registry.op4_url_filter(spark, SF).collect()
    assert len(rows) == len(urls) and check_urls(spark, urls, rows)[0]


@pytest.mark.parametrize("blocked", [1, 2, 3])
def test_url_filter_with_few_examples_of_a_class(spark, blocked):
    rng = random.Random(blocked)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(4, 9)))
    urls = [f"https://www.{word()}.com/{word()}/{word()}.html" for _ in range(80)]
    urls += [f"http://casino{k}-xxx-777.net/es/free_spins_{word()}?id=99{k}" for k in range(blocked)]
    urls += ["http://casino9-xxx-777.org/free_spins_now?id=998", f"https://www.{word()}.org/{word()}/{word()}.html"]
    table = dict(enumerate(urls))
    rows = url_filter.judge(spark.createDataFrame(list(table.items()), "page_id long, url string")).collect()
    free, threshold, accepted = check_urls(spark, table, rows)
    by = {r["page_id"]: r["verdict"] for r in rows}
    worst, fine = len(urls) - 2, len(urls) - 1
    assert free[worst] < min(accepted.values()) and by[worst] == "block" and by[fine] == "allow"


def test_url_threshold_is_pooled():
    assert url_filter.between({True: (1.0, 2.0, 4.0)}) is None
    assert url_filter.between({True: (1.0, 2.0, 4.0), False: (1.0, -2.0, 4.0)}) == 0.0
    assert -2 < url_filter.between({True: (100.0, 200.0, 500.0), False: (1.0, -2.0, 4.0)}) < 2


def test_url_filter_of_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://A.Com/x?y#z", "x://net/fr/", "http://sub.net/es/1#a/b", "http://u@www.example.com/en/", "http://example.com/en/\n😀" + "q" * 5000, "a://b://c.com/d"]
    df = spark.createDataFrame([(k, u, "s", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, score double")
    rows = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = slow_rule(u)
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == (host, path, rule) and rows[k]["verdict"] == (verdict or rows[k]["verdict"])
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id < 4")).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    rows = registry.op9_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = dict(duck("/root/testdata/sf0.1").execute("select doc_id, toxic from labels").fetchall())
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    seen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = sum(p for p, y in seen if y) / sum(y for _, y in seen)
    wrong = sum(p for p, y in seen if not y) / sum(1 - y for _, y in seen)
    # A few rows that the table marks as toxic are mangled texts without any toxic word left, so not all can be caught.
    assert caught >= 0.9 and wrong <= 0.01


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    docs = odd_docs(spark)
    model = toxicity.fit_on(docs, labels)
    assert len(toxicity.score_documents(docs, model).collect()) == len(ODD) + 2
    assert sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in toxicity.fit_and_score(docs, labels).collect()) == sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in toxicity.score_documents(docs, model).collect())
    assert toxicity.fit_and_score(docs.limit(0), labels).collect() == []
    assert toxicity.score_documents(docs.limit(0), model).collect() == []
    seeds_only = toxicity.fit_on(docs, labels.limit(0))
    low, high = toxicity.scores(["a kind word", "you worthless idiot"], seeds_only)
    assert low < 0.5 < high
    assert [r["doc_id"] for r in toxicity.reject(spark.createDataFrame([(1, "you worthless idiot", None), (2, "hello", "x"), (3, None, "y")], "doc_id long, text string, labels string"), seeds_only).collect()] == [2, 3]


def slow_label_model(votes, groups_of, rounds=40):
    """EM by loops over rows and voters; groups_of: the groups and correlations for each phase."""
    n, m = votes.shape
    p = [1 - 0.5 ** min(5, t) if (t := sum(v > 0 for v in row)) else 0.02 for row in votes.tolist()]
    for phase in (0, 1):
        weight = [1.0] * m
        for g, r in zip(*groups_of[phase]):
            for j in g:
                weight[j] = 1 / (1 + (len(g) - 1) * r)
        for _ in range(rounds // 2):
            table = [[[(sum(w for w, row in zip(q, votes) if row[j] == v) + 0.5) / (sum(q) + 1.5) for v in (-1, 0, 1)] for q in ([1 - x for x in p], p)] for j in range(m)]
            for t in table:
                t[1][2], t[0][0] = max(t[1][2], t[0][2]), max(t[0][0], t[1][0])
            prior = min(0.99, max(0.01, sum(p) / n))
            new = [1 / (1 + math.exp(-max(-40, min(40, math.log(prior / (1 - prior)) + sum(weight[j] * math.log(table[j][1][v + 1] / table[j][0][v + 1]) for j, v in enumerate(row)))))) for row in votes.tolist()]
            still = max(abs(a - b) for a, b in zip(new, p)) < 1e-4
            p = new
            if still:
                break
    return p


def voted(n=400, seed=0):
    """(labels, votes): three copies of one voter, one better, one that knows nothing, one that says clean."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    said = lambda right, wrong, what=1: np.where(rng.random(n) < np.where(y, right, wrong), what, 0)
    first = said(0.7, 0.05)
    return y, np.stack([first, first, first, said(0.8, 0.03), said(0.6, 0.02), said(0.2, 0.2), said(0.05, 0.6, -1)], axis=1).astype(np.int8)


def test_label_model_matches_a_slow_estimation():
    y, votes = voted()
    model = toxicity.fit_label_model(votes)
    alone = ([[k] for k in range(votes.shape[1])], [0.0] * votes.shape[1])
    np.testing.assert_allclose(model.posterior(votes), slow_label_model(votes, (alone, (model.groups, model.shared))), atol=1e-3)


def test_label_model_without_any_label():
    """From votes alone: labels, accuracies and the copies are found."""
    y, votes = voted(4000, 1)
    model = toxicity.fit_label_model(votes)
    assert [0, 1, 2] in model.groups and model.shared[model.groups.index([0, 1, 2])] > 0.99
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95
    assert abs(model.table[3, 1, 2] - 0.8) < 0.1 and model.table[3, 0, 2] < 0.06 and abs(model.table[5, 1, 2] - model.table[5, 0, 2]) < 0.05


def test_toxicity_sample_of_repeated_ids(spark):
    """A repeated id counts once with the text of the smallest hash, whatever the partitioning; held-out rows never."""
    texts = [f"text {k} of all" for k in range(60)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(1, "another text under one", 0), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(1, 0), (999, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["text"], r["toxic"]) for r in toxicity.training_rows(docs.repartition(7), labels).collect()}
    assert got == {r["doc_id"]: (r["text"], r["toxic"]) for r in toxicity.training_rows(docs, labels).collect()}
    assert sorted(got) == [k for k in range(20) if zlib.crc32(str(k).encode()) % 5] and all(y == k % 2 for k, (_, y) in got.items())
    assert len(toxicity.training_rows(docs, labels, 5).collect()) == 5


def test_all_rows_vote(spark):
    """The patterns of votes cover every row outside the held-out fold, and sums over them are those over rows, on the driver as on the executors."""
    stems, rng = ["scum", "=awful"], random.Random(4)
    rows = [(k, " ".join(rng.choice(["scum", "awful", "fine", "IDIOT", "day!!"]) for _ in range(rng.randint(0, 6)))) for k in range(500)] + [(None, "scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    voters = len(toxicity.voters_of(stems))
    table = toxicity.vote_patterns(toxicity.hits_of(docs.where(toxicity.fits()), stems), voters).cache()
    fold = [t for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 5]
    lookup = toxicity.Lookup({s: k for k, s in enumerate(stems)})
    votes = toxicity.votes_of(np.stack([toxicity.hit_counts(t, lookup) for t in fold]))
    here, there = toxicity.Tally.of(table, voters), toxicity.Tally.of(table, voters, here=1)
    assert here.table is None and there.votes is None and here.n.sum() == len(fold) and len(here.n) == len({v.tobytes() for v in votes}) < len(fold)
    plain, model = toxicity.Tally(votes, np.ones(len(votes))), toxicity.fit_label_model(votes)
    for tally in (here, there):
        for now in (None, model):
            np.testing.assert_allclose(tally.sums(now, None), plain.sums(now, None), atol=1e-9)
        np.testing.assert_allclose(tally.moments(model), plain.moments(model), atol=1e-9)
    np.testing.assert_allclose(toxicity.estimated(there, rounds=4).table, toxicity.fit_label_model(votes, rounds=4).table, atol=1e-9)


def test_packing(spark, texts):
    rows = registry.op1_best_fit_packing(spark, SF).collect()
    tokens = {d: len(t.split()) + 1 for d, t in texts.items()}
    assert Counter({d: sum(r["n_tokens"] for r in rows if r["doc_id"] == d) for d in tokens}) == Counter(tokens)
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
        assert r["start_token"] == r["piece"] * max(packing.LENGTHS)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        ends = np.cumsum([r["n_tokens"] for r in own]).tolist()
        assert [r["bin_offset"] for r in own] == [0, *ends[:-1]]
        assert {r["bin_length"] for r in own} == {next(n for n in packing.LENGTHS if n >= ends[-1])}
    assert sum(tokens.values()) / sum(own[0]["bin_length"] for own in bins.values()) > 0.9
    again = registry.op1_best_fit_packing(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def slow_best_fit(sizes, lengths, costs):
    """(used tokens of each bin, bin of each piece) of the cheapest plan, with plain lists."""
    cheapest, best = min(c / n for c, n in zip(costs, lengths)), None
    for share, largest in packing.plans(lengths):
        left, bins, own = sum(sizes), [], []
        for s in sizes:
            left -= s
            fits = [(room, k) for k, (room, _) in enumerate(bins) if room >= s]
            if fits:
                least = min(fits)[0]
                k = next(k for k in reversed(stack[least]) if bins[k][0] == least)
                stack[least].remove(k)
            else:
                allowed = [n for n in lengths if n >= s and (n <= largest or n == min(m for m in lengths if m >= s))]
                n = min(allowed, key=lambda n: (costs[lengths.index(n)] - share * cheapest * min(n - s, left), n))
                k = len(bins)
                bins.append((n, 0))
                if k == 0:
                    stack = defaultdict(list)
            bins[k] = (bins[k][0] - s, bins[k][1] + s)
            stack[bins[k][0]].append(k)
            own.append(k)
        final = [min(n for n in lengths if n >= used) for _, used in bins]
        cost = sum(costs[lengths.index(n)] for n in final)
        if best is None or cost < best[0]:
            best = cost, own, final
    return best[1:]


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(8)
    for _ in range(60):
        lengths = sorted(rng.sample(range(8, 64), 3))
        costs = [n * rng.uniform(0.8, 1.2) for n in lengths]
        sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randrange(40))), reverse=True)
        bins, offsets, final = packing.best_fit(sizes, lengths, costs)
        if sizes:
            assert (bins, final) == slow_best_fit(sizes, lengths, costs)
        at = Counter()
        for b, o, s in zip(bins, offsets, sizes):
            assert at[b] == o
            at[b] += s


def test_packing_matches_a_slow_version(spark):
    lengths, costs = [8, 32, 64], packing.default_costs([8, 32, 64])
    rng = random.Random(9)
    rows = [(k, " ".join("w" * rng.randrange(150))) for k in range(400)] + [(7, "a b"), (7, "a b"), (None, ""), (None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {(r[0], r[1], r[2]): (r[3], r[4]) for r in docs.selectExpr("doc_id", "text", "explode(sequence(0, 3)) as piece").selectExpr("doc_id", "text", "piece", "xxhash64(text)", "xxhash64(doc_id, xxhash64(text), piece)").collect()}
    pieces = Counter()
    for d, t in rows:
        n = len((t or "").split()) + 1
        pieces.update((d, hashes[d, t, p][0], p, min(64, n - 64 * p), hashes[d, t, p][1]) for p in range(-(-n // 64)))
    shards = -(-sum(pieces.values()) // 50)
    dealt = defaultdict(list)
    for (d, version, p, size, h), copies in pieces.items():
        for c in range(copies):
            dealt[(h % shards + c) % shards].append((-size, 2**63 - 1 if d is None else d, version, p, d))
    want = Counter()
    for shard, own in dealt.items():
        own.sort()
        bins, final = slow_best_fit([-x[0] for x in own], lengths, costs)
        at = Counter()
        for b, (size, _, _, p, d) in zip(bins, own):
            want[d, p, 64 * p, -size, f"{shard}-{b}", final[b], at[b]] += 1
            at[b] -= size
    got = packing.pack_documents(docs, lengths=lengths, shard_pieces=50)
    assert Counter(map(tuple, got.collect())) == want and max(map(len, dealt.values())) < 100


def test_packing_spreads_identical_rows(spark):
    docs = spark.range(60_000).selectExpr("cast(null as long) as doc_id", "'' as text")
    shards = Counter(r["bin_id"].split("-")[0] for r in packing.pack_documents(docs).collect())
    assert list(shards.values()) == [20_000] * 3


def test_pieces_of_a_very_long_text():
    code = """
import re
import pyarrow as pa
from tidemill.llm import packing
batch = pa.record_batch({"doc_id": pa.array([1]), "version": pa.array([2]), "text": pa.array(["word and " * 5_000_000], pa.large_string())})
rows = sum(b.num_rows for b in packing._pieces(8192)([batch]))
assert rows == -(-10_000_001 // 8192)
print(int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout) < 1000


def test_packing_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = packing.pack_documents(docs, lengths=(8, 32)).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((r["text"] or "").split()) + 1 for r in docs.collect())
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_shouting_is_a_voter_of_its_own():
    lookup, at = toxicity.Lookup({}), len(toxicity.SEEDS) + toxicity.PATTERNS.index("shouting")
    texts = ["PLEASE LEAVE NOW", "ÄRGER ÉTÉ ÑANDÚ", "please leave NOW", "Please Leave Us", "AB 123 CD", ""]
    counts = np.stack([toxicity.hit_counts(t, lookup) for t in texts])
    assert counts[:, at].tolist() == [1, 1, 1 / 3, 0, 0, 0]
    assert toxicity.votes_of(counts)[:, at].tolist() == [1, 1, 1, 0, 0, 0]


def test_pieces_of_a_bin_come_with_their_text(spark):
    rng = random.Random(6)
    texts = ["", " \n", None, "é" * 10, " ".join("ab" for _ in range(10)), *("".join(rng.choice(["x", "yé", "z ", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(40))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id " * 9), (4, texts[4]), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, lengths=(2, 5), with_text=True).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, map(tuple, packing.pack_documents(docs, lengths=(2, 5)).collect())))
    for r in got:
        assert len(r["text"].split()) == r["n_tokens"] - (r["n_tokens"] < 5 or r["text"] == "" or len(r["text"].split()) < 5)
    whole = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        whole.setdefault(r["doc_id"], {})[r["piece"]] = r["text"]
    assert all("".join(whole[d].values()) == (t or "") for d, t in rows)
    assert packing.stretches("a b  c d", 2) == ["a b  ", "c d", ""] and packing.stretches("", 2) == [""]
