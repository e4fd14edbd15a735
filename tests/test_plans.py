"""Operators with a plan or a data structure of their own: posting blocks, tiles, tagged scans and joins, parallel sinks, converging ranks."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.chain import Stage, run_chain
from tidemill.operators import cluster, graph, joins, maintained, matrix, postings, spread, text
from tidemill.plans import reference_queries
from tidemill.sources import sinks
from tidemill.sources import text as sources


def executed(df):
    """Nodes of the final plan, after the rows were made; what is used again counts once, scalar subqueries not at all."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind != "ReusedExchangeExec":
            found.append(node)
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def named(found, pattern):
    return [node for node in found if re.match(pattern, node.nodeName())]


# Lists


def test_lists_are_joined_from_pieces(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice(["x", "y", None]), rng.randrange(100)) for _ in range(500)] + [("d", None, 3), ("e", "x", 7)]
    found = spark.createDataFrame(rows, "word string, doc string, pos long")
    want = {w: " ".join(f"{d}: {p}" for d, p in sorted((d, p) for v, d, p in rows if v == w and d)) for w in "abcde"}
    for lists in (text.listed(found), text.listed(found, piece=7)):
        assert {r["word"]: r["postings"] for r in lists.collect()} == want
    # What a word's last task gathers is one entry a piece: two documents (and none) here, not 500 postings.
    gathered = [n for n in named(executed(text.listed(found)), "ObjectHashAggregate|SortAggregate") if "collect_list" in n.toString()]
    by_doc = [n for n in gathered if "keys=[word#" in n.toString() and "doc#" in n.toString().split("functions=")[0]]
    assert len(by_doc) == 2 and min(n.metrics().apply("numOutputRows").value() for n in by_doc) == len({r[:2] for r in rows})


# TF-IDF


@pytest.mark.parametrize("ask", [text.tf_idf, lambda df: text.with_doc_freq(text.term_counts(df)), lambda df: text.with_doc_total(text.term_counts(df))])
def test_texts_are_tokenised_once(spark, ask):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(k, f"a b{k % 3} c{k}") for k in range(100)], "doc_id long, text string")
        plan = executed(ask(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(named(plan, "Generate")) == 1


def test_counts_and_totals_share_one_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(k % 50, f"a b{k % 3} c{k} A") for k in range(100)] + [(None, "x y"), (None, "x"), (7, None)], "doc_id long, text string")
        plan = executed(text.with_doc_total(text.term_counts(df)))
        # An id of many rows is counted where its rows are; the counts are the same.
        many = [sorted(map(str, text.with_doc_total(text.term_counts(df, many_rows=m)).collect())) for m in (1, 1000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(named(plan, "Exchange")) == 1 and not named(plan, ".*Join")
    assert many[0] == many[1]
    assert {(r["word"], r["n"], r["doc_total"]) for r in text.with_doc_total(text.term_counts(df)).where("doc is null").collect()} == {("x", 2, 3), ("y", 1, 3)}


# Posting blocks


def test_partitions_of_postings_grow_with_the_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "some words\nof text " * 5) for k in range(3000)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(spread, "PART_BYTES", spread.estimated_bytes(docs) // 40)
    assert spread.parts_of(docs) >= 40
    found = text.postings(docs)
    # The parts that adaptive execution would merge into a few stay as they are.
    assert found.rdd.getNumPartitions() >= 40 and found.count() == 3000 * 20
    blocks = postings.posting_blocks(found)
    assert blocks.rdd.getNumPartitions() >= 20 and blocks.agg(F.sum("n")).first()[0] == 3000 * 20


def test_lines_are_dealt_before_their_tokens_are_exploded(spark):
    lines = spark.createDataFrame([("a.txt", 0, "x yy  z"), ("a.txt", 8, "x")], "doc string, start long, value string")
    found = text.postings_of_lines(lines)
    assert sorted(map(tuple, found.collect())) == [("x", "a.txt", 0), ("x", "a.txt", 8), ("yy", "a.txt", 2), ("z", "a.txt", 5)]
    exchanges = named(executed(found), "Exchange")
    assert len(exchanges) == 1 and "value" in exchanges[0].output().toString()


def some_postings(seed, n, doc=lambda k: k):
    rng = random.Random(seed)
    return [(rng.choice(["the"] * 8 + ["a", "é", "zz"]), doc(rng.randint(-5, 400)), rng.randint(0, 10**6)) for _ in range(n)]


@pytest.mark.parametrize("numbers", [[], [0], [0, 1, 127, 128, 300, 2**31, 2**62, 2**63 - 1]])
def test_varints(numbers):
    data, begin = postings.varints(np.array(numbers, np.int64))
    assert postings.from_varints(data).tolist() == numbers and len(begin) == len(numbers) + 1 and begin[-1] == len(data)


@pytest.mark.parametrize("doc, kind", [(lambda k: k, "long"), (lambda k: f"d{k}.txt", "string")])
def test_blocks_hold_all_postings_and_are_bounded(spark, doc, kind):
    rows = some_postings(1, 6000, doc)
    df = spark.createDataFrame([*rows, (None, rows[0][1], 1), ("a", None, 1), ("a", rows[0][1], None)], f"word string, doc {kind}, pos long").repartition(5)
    blocks = postings.posting_blocks(df, 100).cache()
    assert sorted(map(tuple, postings.read_blocks(blocks).collect())) == sorted(rows)
    heads = blocks.select("word", "n", "first", "last", F.spark_partition_id().alias("task")).collect()
    assert max(r["n"] for r in heads) <= 100 and sum(r["word"] == "the" for r in heads) >= 40
    assert len({r["task"] for r in heads if r["word"] == "the"}) > 1
    # Blocks of a word don't overlap, and are full but for the ends of its ranges.
    for word in ("the", "a"):
        own = sorted((tuple(r["first"]), tuple(r["last"]), r["n"], r["task"]) for r in heads if r["word"] == word)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:])) and sum(n < 100 for *_, n, _ in own) <= len({t for *_, t in own})
    assert postings.posting_blocks(df.limit(0)).count() == 0 and postings.read_blocks(blocks.limit(0)).count() == 0


def test_blocks_are_small_and_skipped_by_their_headers(spark):
    rows = some_postings(2, 20_000)
    df = spark.createDataFrame(rows, "word string, doc long, pos long")
    blocks = postings.posting_blocks(df, 64).cache()
    held = blocks.agg(F.sum(F.octet_length("docs") + F.octet_length("positions"))).first()[0]
    assert held < 4 * len(rows)
    assert sorted(map(tuple, postings.lookup(blocks, ["the", "a"], 10, 20).collect())) == sorted(r for r in rows if r[0] in ("the", "a") and 10 <= r[1] <= 20)
    near = blocks.where("word = 'the' and last.doc >= 10 and first.doc <= 20").count()
    assert near < blocks.where("word = 'the'").count() / 10


def test_blocks_merge(spark):
    rows = some_postings(3, 4000)
    old, new = ([r for r in rows if r[0] != "zz" and r[1] < 300], [r for r in rows if r[0] in ("zz", "a") and r[1] >= 300])
    blocks = [postings.posting_blocks(spark.createDataFrame(part, "word string, doc long, pos long"), 50).cache() for part in (old, new)]
    both = postings.merge_blocks(*blocks, 50).cache()
    assert sorted(map(tuple, postings.read_blocks(both).collect())) == sorted(old + new) and both.agg(F.max("n")).first()[0] == 50
    plain = lambda df: sorted(map(tuple, df.where("word = 'the'").select("n", "docs", "positions").collect()))
    assert plain(both) == plain(blocks[0])


# Tiles


def cells(spark, m):
    i, j = np.nonzero(m != 0)
    return spark.createDataFrame([(int(a), int(b), int(m[a, b])) for a, b in zip(i, j)], "i int, j int, v long")


def found(df):
    rows = df.collect()
    assert len({(r["i"], r["j"]) for r in rows}) == len(rows)
    return {(r["i"], r["j"]): r["v"] for r in rows}


@pytest.mark.parametrize("grid", [None, matrix.Grid(1, 1, 1), matrix.Grid(2, 3, 2), matrix.Grid(3, 1, 4)])
@pytest.mark.parametrize("share", [0.003, 0.05, 0.6])
def test_tiled_product_is_the_join_s(spark, monkeypatch, grid, share):
    rng = np.random.default_rng(5)
    a, b = (np.where(rng.random(s) < share, rng.integers(-9, 10, s), 0) for s in ((300, 530), (530, 270)))
    left, right = cells(spark, a), cells(spark, b)
    assert found(matrix.matrix_multiply_tiled(left, right, grid)) == found(matrix.matrix_multiply(left, right))


def test_tiled_product_of_odd_cells(spark):
    make = lambda rows: spark.createDataFrame(rows, "i int, j int, v long")
    a = make([(0, 0, 2), (0, 0, 3), (5, 1000, 7), (None, 1, 1), (1, 1, 0), (2, 7, 1), (2, 8, -1)])
    b = make([(0, 4, 10), (1000, 700, -1), (1000, 700, -1), (1, 1, 6), (7, 0, 5), (8, 0, 5), (9, 9, 9)])
    # Repeated cells add up; a sum of 0 has a cell, an absent product none.
    assert found(matrix.matrix_multiply_tiled(a, b)) == {(0, 4): 50, (5, 700): -14, (1, 1): 0, (2, 0): 0} == found(matrix.matrix_multiply(a.dropna(), b))
    assert matrix.matrix_multiply_tiled(a, b.limit(0)).count() == 0
    big = make([(0, k, 3_000_000_000) for k in range(3)])
    turned = big.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    with pytest.raises(Exception, match="(?i)overflow"):
        matrix.matrix_multiply_tiled(big, turned).collect()
    assert found(matrix.matrix_multiply_tiled(big.where("j = 0"), turned)) == {(0, 0): 9 * 10**18}
    near = make([(0, k, (-1) ** k * 2**31) for k in range(600)])
    assert found(matrix.matrix_multiply_tiled(near, make([(k, 0, 2**31) for k in range(600)]))) == {(0, 0): 0}


def test_a_hot_inner_index_is_spread(spark):
    """All products run over one inner index: its tiles lie at all places of the grid."""
    a = spark.createDataFrame([(i, 3, 1) for i in range(2000)], "i int, j int, v long")
    b = spark.createDataFrame([(3, j, 2) for j in range(1500)], "i int, j int, v long")
    grid = matrix.grid_for(2000, 1500, 8, 6, 1, place_cells=500)
    assert grid.rows * grid.columns >= 8 and max(grid.rows, grid.columns) <= matrix.MOST_SENT
    out = matrix.matrix_multiply_tiled(a, b, grid)
    assert out.agg(F.count("*"), F.sum("v")).first()[:] == (3_000_000, 6_000_000)
    plan = executed(out.limit(1))
    # Tiles once, sums once.
    assert len(named(plan, "Exchange")) == 2 and not named(plan, ".*Join")


def test_grid():
    assert matrix.grid_for(100, 100, 4, 4, 9, tasks=8) == matrix.Grid(1, 1, 8)
    for left, right, rows, columns, inner in ((10**9, 10**9, 50, 60, 7), (10**12, 10, 1000, 1, 3), (5, 5, 1, 1, 1)):
        g = matrix.grid_for(left, right, rows, columns, inner)
        assert g.rows <= min(rows, matrix.MOST_SENT) and g.columns <= min(columns, matrix.MOST_SENT) and g.inner <= inner


# Tagged scans and joins


def mixed(folder):
    for name, body in (("fileA.txt", "1|10|x\n2|20|y\n"), ("more-fileA-2.txt", "3|30|z\n4|40|x\n"), ("fileB.txt", "x|first\ny|why\nx|last\n"), ("stray.txt", "not|read\n" * 50), ("other.log", "1|1|1\n")):
        (folder / name).write_text(body)
    return str(folder)


def files_read(df):
    return sum(node.metrics().apply("numFiles").value() for node in named(executed(df), "Scan text"))


RULES = [sources.Named("fact", "fileA"), sources.Named("dimension", "fileB")]


def test_one_scan_is_routed_by_name_and_leaves_stray_files_alone(spark, tmp_path):
    rows = sources.read_tagged(spark, mixed(tmp_path), RULES)
    assert Counter((r["tag"], r["file"]) for r in rows.collect()) == {("fact", "fileA.txt"): 2, ("fact", "more-fileA-2.txt"): 2, ("dimension", "fileB.txt"): 3}
    assert files_read(rows.select("tag", "value")) == 3
    assert files_read(rows.where("tag = 'dimension'").select("value")) == 1
    exact = sources.read_tagged(spark, str(tmp_path), [sources.Named("a", "fileA.txt", equals=True)])
    assert {r["file"] for r in exact.collect()} == {"fileA.txt"} and files_read(exact.select("value")) == 1
    rest = sources.read_tagged(spark, str(tmp_path), RULES[:1], otherwise="rest")
    assert Counter(r["tag"] for r in rest.collect()) == {"fact": 4, "rest": 54}


def test_one_scan_feeds_a_join(spark, tmp_path):
    rows = sources.tagged_records(sources.read_tagged(spark, mixed(tmp_path), RULES))
    joined = joins.carried_join(rows, "category", F.col("tag") == "fact", "line", ("category_name",)).select("id", "price", "category_name")
    assert {tuple(r) for r in joined.collect()} == {("1", "10", "last"), ("2", "20", "why"), ("3", "30", None), ("4", "40", "last")}
    plan = executed(joined)
    assert len(named(plan, "Exchange")) == len(named(plan, "Scan text")) == 1 and files_read(joined) == 3


def test_one_scan_feeds_a_product(spark, tmp_path):
    for name, body in (("matrix_a.txt", "0 0 1\n0 1 2\n1 0 3\n1 1 4\n"), ("matrix_b.txt", "0 0 5\n0 1 6\n1 0 7\n1 1 8\n"), ("matrix_b.txt.bak", "9 9 9\n")):
        (tmp_path / name).write_text(body)
    rows = sources.read_tagged(spark, str(tmp_path), [sources.Named(k, f"matrix_{k}.txt", equals=True) for k in "ab"])
    a, b = (sources.cells(rows.where(F.col("tag") == k)) for k in "ab")
    assert found(matrix.matrix_multiply_tiled(a, b)) == {(0, 0): 19, (0, 1): 22, (1, 0): 43, (1, 1): 50}
    assert files_read(a) == files_read(b) == 1


def test_tagged_join_is_the_left_join_with_one_exchange(spark):
    rng = random.Random(7)
    fact = spark.createDataFrame([(k, rng.choice(["hot"] * 6 + list("abcdef") + [None])) for k in range(2000)], "id int, k string")
    dim = spark.createDataFrame([(rng.choice(["hot", "a", "b", "c", "never", None]), f"n{n}", n) for n in range(60)] + [("d", None, 0)], "k string, name string, line int")
    want = sorted(map(repr, joins.left_join(fact, dim, "k", "merge", order="line").select("id", "k", "name").collect()))
    for part_rows in (10**6, 100):
        got = joins.tagged_join(fact, dim, "k", order="line", part_rows=part_rows)
        assert got.columns == ["id", "k", "name"] and sorted(map(repr, got.collect())) == want
        plan = executed(got)
        assert len(named(plan, "Exchange")) == 1 and not named(plan, ".*Aggregate|SortMergeJoin")
    split = joins.split_keys(fact, "k", 100).collect()
    parts = {r["__key"]: r["__parts"] for r in split}
    assert parts["hot"] >= 5 and set(parts) >= {"hot", None}
    tasks = joins.tagged_join(fact, dim, "k", order="line", part_rows=100).where("k = 'hot'").select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 700
    plain = joins.tagged_join(fact, dim.drop("line").dropDuplicates(["k"]), "k")
    assert plain.count() == 2000 and joins.tagged_join(fact, dim.limit(0), "k", "line").where("name is null").count() == 2000
    with pytest.raises(ValueError):
        joins.tagged_join(fact, dim.withColumn("id", F.lit(1)), "k", "line")


# Named files


def test_named_files_are_written_in_parts_and_read_as_one(spark, tmp_path):
    rng = random.Random(9)
    rows = [(name, k, "é" * rng.randint(0, 5) + "x" * rng.randint(0, 30)) for name, n in (("big.txt", 4000), ("a b.txt", 3), ("none.txt", 1)) for k in range(n)]
    lines = spark.createDataFrame(rows, "file string, order int, value string").repartition(7)
    folder = f"{tmp_path}/files"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_named_files(lines, folder)
        placed = {(r["file"], r["order"]): r["offset"] for r in sinks.placed_lines(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "files" / "file=big.txt").glob("part-*"))
    assert len(parts) > 3 and max(p.stat().st_size for p in parts) < 0.5 * sum(p.stat().st_size for p in parts)
    assert b"".join(p.read_bytes() for p in parts).decode() == "".join(v + "\n" for f, _, v in rows if f == "big.txt")
    at, want = Counter(), {}
    for f, k, v in rows:
        want[f, k] = at[f]
        at[f] += len(v.encode()) + 1
    assert placed == want
    read = sorted((r["file"], r["offset"], r["value"]) for r in sources.read_lines_with_offset(spark, folder).collect())
    assert read == sorted((f, want[f, k], v) for f, k, v in rows)


def test_empty_and_null_lines_are_lines(spark, tmp_path):
    lines = spark.createDataFrame([("f", 1, ""), ("f", 2, None), ("f", 3, "x")], "file string, order int, value string")
    sinks.write_named_files(lines, f"{tmp_path}/files")
    assert sorted(map(tuple, sources.read_lines_with_offset(spark, f"{tmp_path}/files").collect())) == [("f", 0, ""), ("f", 1, ""), ("f", 2, "x")]
    assert [r["offset"] for r in sinks.placed_lines(lines).orderBy("order").collect()] == [0, 1, 2]


# Ranks to convergence


def test_hub_edges_in_parts_give_the_same_ranks(spark):
    pages, edges = some_graph(spark)
    for rank in (graph.page_rank, graph.page_rank_textbook):
        plain, parts = ({r["page"]: r["rank"] for r in rank(pages, edges, 40, iterations=4, hub_edges=h).collect()} for h in (10**6, 3))
        assert plain.keys() == parts.keys() and all(abs(plain[p] - parts[p]) < 1e-8 for p in plain)
    links = graph._in_parts(edges, graph._hubs(edges, 3))
    assert len({r["part"] for r in links.where("src = 7").collect()}) > 5 and graph._hubs(edges, 10**6) is None


def test_edges_are_dealt_once_for_all_rounds(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages, edges = some_graph(spark)
        for rank in (graph.page_rank, graph.page_rank_textbook):
            moved = [n.output().toString() for n in named(executed(rank(pages, edges, 40)), "Exchange")]
            assert moved and not any("out_degree" in columns for columns in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def some_graph(spark, seed=11, n=40):
    rng = random.Random(seed)
    pairs = sorted({(rng.randint(0, n - 1), rng.randint(5, n - 1)) for _ in range(3 * n)} | {(7, k) for k in range(n - 10)})
    degree = Counter(a for a, _ in pairs)
    edges = spark.createDataFrame([(a, b, degree[a]) for a, b in pairs], "src int, dst int, out_degree int")
    return spark.createDataFrame([(k,) for k in range(n)], "page int"), edges


@pytest.mark.parametrize("hub_edges", [10**6, 4])
def test_converged_ranks_are_those_of_the_fixed_loop(spark, hub_edges):
    pages, edges = some_graph(spark)
    sent = []
    got = graph.page_rank_converged(pages, edges, 40, bound=1e-9, damping=0.5, base=0.5, hub_edges=hub_edges, progress=lambda *x: sent.append(x))
    want = {r["page"]: r["rank"] for r in graph.page_rank_textbook(pages, edges, 40, iterations=30, damping=0.5, base=0.5).collect()}
    found = {r["page"]: r["rank"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 40e-9 for p in want)
    # In the first round all pages with out-links send, then fewer do; what a page kept back may make it send again.
    messages = [m for _, _, m in sent]
    third = len(messages) // 3
    early, middle, late = (sum(messages[k * third : (k + 1) * third]) for k in range(3))
    assert messages[0] == edges.count() == max(messages) and early >= middle > late and messages[-1] < messages[0] / 4 and [k for k, *_ in sent] == list(range(1, len(sent) + 1))


def test_converged_ranks_without_in_links_stay(spark):
    pages, edges = some_graph(spark, n=20)
    stray = edges.unionAll(spark.createDataFrame([(99, 6, 1), (6, 77, 9)], edges.schema))
    got = {r["page"]: r["rank"] for r in graph.page_rank_converged(pages, stray, 20, bound=1e-9, damping=0.5, base=0.5, textbook=False).collect()}
    want = {r["page"]: r["rank"] for r in graph.page_rank(pages, edges, 20, iterations=30, damping=0.5, base=0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    assert graph.page_rank_converged(pages, edges, 20, bound=1e-9, max_rounds=0).orderBy("page").collect() == spark.createDataFrame([(k, 0.15 / 20) for k in range(20)], "page int, rank double").collect()


# Many centres


@pytest.mark.parametrize("k", [1, 300, 10_000])
def test_a_grid_of_centres_is_the_full_scan(spark, k):
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 10, (k, 2))
    centres[k // 2] = centres[0]
    at = np.concatenate([rng.normal(0, 10, (3000, 2)), rng.uniform(-60, 60, (500, 2)), centres[:100]])
    points = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(at)], "n int, x double, y double")
    away = np.sqrt((at[:, None, 0] - centres[:, 0]) ** 2 + (at[:, None, 1] - centres[:, 1]) ** 2)
    got = cluster.kmeans_assign(points, [tuple(map(float, c)) for c in centres], literals=0, indexed=1)
    assert {r["n"]: r["cluster"] for r in got.collect()} == dict(enumerate(away.argmin(axis=1).tolist()))
    assert not named(executed(got), ".*(Python|Arrow|Pandas)")
    grid = cluster.centre_grid(centres.tolist(), -60, -60, 60, 60)
    # Distances that a point is compared by, for points like the centres.
    cell = np.clip((at[:3000] + 60) // [grid.width, grid.height], 0, grid.side - 1).astype(int)
    looked_at = np.mean([len(grid.near[r * grid.side + c]) for c, r in cell])
    assert looked_at < max(2, k / 50, min(40, k / 5))


def test_a_grid_of_centres_with_odd_points(spark):
    centres = [(float(k), float(-k)) for k in range(400)]
    odd = [(1, None, 1.0), (2, float("nan"), 0.0), (3, float("inf"), 0.0), (4, 5.2, -5.1), (5, 1e9, -1e9)]
    points = spark.createDataFrame(odd, "n int, x double, y double")
    plain, grid = ({r["n"]: r["cluster"] for r in cluster.kmeans_assign(points, centres, literals=0, indexed=k).collect()} for k in (10**6, 1))
    assert plain == grid and plain[1] is None and plain[4] == 5 and plain[5] == 399
    nothing = cluster.kmeans_assign(points.where("n = 1"), centres, indexed=1)
    assert [r["cluster"] for r in nothing.collect()] == [None]
    assert [r["cluster"] for r in cluster.kmeans_assign(points.where("n = 5"), centres, cutoff=1e5, indexed=1).collect()] == [0]


# Maintained TF-IDF


def test_maintained_tf_idf_is_that_of_the_texts_now(spark, tmp_path):
    rng = random.Random(13)
    make = lambda ids: spark.createDataFrame([(k, " ".join(rng.choices("a b c d E f".split(), k=rng.randint(0, 9)))) for k in ids], "doc_id long, text string").cache()
    first, second, again = make(range(30)), make(range(30, 50)), make([3, 3, 7, 60])
    exact = lambda df: sorted((*tuple(r)[:-1], round(r["score"], 9)) for r in df.collect())
    tables = maintained.term_tables(first).written(f"{tmp_path}/0")
    tables = maintained.added(maintained.added(tables, second), again).written(f"{tmp_path}/1")
    now = first.unionAll(second).unionAll(again)
    assert exact(maintained.scores(tables)) == exact(text.tf_idf(now))
    gone = spark.createDataFrame([(3,), (44,), (44,), (999,), (None,)], "doc_id long")
    left = maintained.removed(tables, gone)
    assert exact(maintained.scores(left)) == exact(text.tf_idf(now.join(gone, "doc_id", "left_anti")))
    assert exact(maintained.scores(maintained.removed(tables, now))) == []
    # Old texts are not read again: only the tables and the new texts stand in the plan.
    scanned = named(executed(maintained.scores(maintained.added(maintained.read_tables(spark, f"{tmp_path}/1"), again))), "Scan|InMemoryTableScan")
    assert {n.nodeName().split()[0] for n in scanned} <= {"Scan", "InMemoryTableScan"} and sum(n.nodeName().startswith("Generate") for n in scanned) == 0


def test_counts_of_new_documents_are_not_merged_with_old_ones(spark, tmp_path):
    make = lambda ids: spark.createDataFrame([(k, f"a b{k % 3} A") for k in ids], "doc_id long, text string")
    old = maintained.term_tables(make(range(20))).written(f"{tmp_path}/0")
    more = maintained.added(old, make(range(20, 30)))
    assert not named(executed(more.counts), ".*Join") and len(named(executed(more.counts), "Exchange")) == 1
    assert sorted(map(tuple, more.counts.collect())) == sorted(map(tuple, text.term_counts(make(range(30))).collect()))
    assert sorted(map(tuple, more.freqs.collect())) == sorted(map(tuple, text.doc_freqs(text.term_counts(make(range(30)))).collect()))
    again = maintained.added(old, make([3, 40]))
    assert {tuple(r) for r in again.counts.where("doc = 3").collect()} == {("a", 3, 4), ("b0", 3, 2)} and again.freqs.where("word = 'a'").first()["m"] == 21


def test_maintained_tf_idf_holds_the_tables_of_one_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reference_queries, "new_folder", lambda _, name: f"{tmp_path}/{name}")
    found = reference_queries.QUERIES["tf_idf_maintained"][0](spark, "/root/testdata/sf0.001")
    held = {str(p.relative_to(tmp_path / "tables").parent) for p in (tmp_path / "tables").rglob("*.parquet")}
    assert held == {"3/freqs", "3/rows", "scores/totals"}
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, reference_queries.QUERIES["tf_idf"][0](spark, "/root/testdata/sf0.001").collect()))


# Chains


def test_a_chain_goes_on_after_a_failure(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/in")
    ran, broken = [], [True]

    def stage(name, change):
        def run(_, df, **parameters):
            ran.append(name)
            if name == "c" and broken[0]:
                raise RuntimeError("lost")
            return change(df, **parameters)

        return run

    def chain(times=2):
        return [Stage("a", stage("a", lambda df: df.where("k > 2")), ["in"]), Stage("b", stage("b", lambda df, times: df.selectExpr(f"k * {times} as k")), ["a"], {"times": times}), Stage("c", stage("c", lambda df: df.selectExpr("sum(k) as k")), ["b"])]

    run = lambda *of, **more: run_chain(spark, f"{tmp_path}/out", {"in": f"{tmp_path}/in"}, chain(*of), **more).collect()[0][0]
    with pytest.raises(RuntimeError):
        run()
    assert ran == ["a", "b", "c"]
    broken[0], there = False, []
    ran.clear()
    # The table of b is read, not made again: it still holds what was changed by hand.
    kept = next((tmp_path / "out").glob("b-*")) / "table"
    spark.createDataFrame([(100,), (1,)], "k long").write.mode("overwrite").parquet(str(kept))
    assert run(progress=lambda *x: there.append(x)) == 101 and ran == ["c"] and there == [("a", True), ("b", True), ("c", False)]
    ran.clear()
    assert run() == 101 and ran == []
    # Other parameters, then another input: from there on all is made anew.
    assert run(3) == 3 * sum(range(3, 10)) and ran == ["b", "c"]
    ran.clear()
    spark.range(12).withColumnRenamed("id", "k").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 2 * (sum(range(3, 10)) + sum(range(3, 12))) and ran == ["a", "b", "c"]
    with pytest.raises(ValueError):
        run_chain(spark, f"{tmp_path}/out", {"in": f"{tmp_path}/in"}, [Stage("in", lambda _, df: df, ["in"])])
