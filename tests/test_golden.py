"""Hand-made inputs with known results (FIXTURES.md part B), through the file parsers where there is one."""

import pytest

from tidemill import folders
from tidemill.operators import cluster, graph, joins, matrix, text, topk
from tidemill.sources import sinks
from tidemill.sources import text as sources


@pytest.fixture
def lines(spark, tmp_path):
    """Writes text to a file of its own folder and reads it as lines."""

    def make(content: str, name: str = "in.txt"):
        folder = tmp_path / f"d{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        (folder / name).write_text(content)
        return sources.read_lines(spark, str(folder))

    return make


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_word_count(lines):
    assert {tuple(r) for r in text.word_count(lines("The cat the\nCat sat.\n"), "value").collect()} == {("cat", 2), ("sat.", 1), ("the", 2)}


def test_word_count_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",)], "text string")
    assert text.word_count(df).collect() == []


def test_inverted_index(spark):
    df = docs(spark, {"f.txt": "to be or not\nto be\n", "g.txt": "é b\nc"})
    got = {(r["word"], r["doc"], r["pos"]) for r in text.postings(df).collect()}
    assert got == {("be", "f.txt", 3), ("be", "f.txt", 16), ("not", "f.txt", 9), ("or", "f.txt", 6), ("to", "f.txt", 0), ("to", "f.txt", 13), ("é", "g.txt", 0), ("b", "g.txt", 2), ("c", "g.txt", 5)}
    lists = {r["word"]: r["postings"] for r in text.inverted_index(df).collect()}
    assert lists["be"] == "f.txt: 3 f.txt: 16" and lists["é"] == "g.txt: 0"


def test_line_offsets(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é b\n\nc\r\nd".encode())
    (tmp_path / "b.txt").write_bytes(b"x\ry\r\n\r\rz\n")
    rows = sources.read_lines_with_offset(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [tuple(r) for r in rows] == [("a.txt", 0, "é b"), ("a.txt", 5, ""), ("a.txt", 6, "c"), ("a.txt", 9, "d"), *(("b.txt", o, v) for o, v in ((0, "x"), (2, "y"), (5, ""), (6, ""), (7, "z")))]


def test_line_offsets_of_split_files(spark, tmp_path):
    """Blocks much smaller than the files."""
    import random

    rng = random.Random(1)
    want = []
    for name in ("one.txt", "two.txt"):
        lines = ["é" * rng.randrange(9) + "x" * rng.randrange(200) for _ in range(500)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        offset = 0
        for line in lines:
            want.append((name, offset, line))
            offset += len(line.encode()) + 1
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert sorted(tuple(r) for r in sources.read_lines_with_offset(spark, str(tmp_path)).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_postings_of_files_and_of_repeated_ids(spark, tmp_path):
    (tmp_path / "f.txt").write_text("to be or not\nto be\n")
    (tmp_path / "g.txt").write_text("é b\nc")
    lines = sources.read_lines_with_offset(spark, str(tmp_path)).selectExpr("file as doc", "offset as start", "value")
    assert {r["word"]: r["postings"] for r in text.listed(text.postings_of_lines(lines)).collect()} == {"be": "f.txt: 3 f.txt: 16", "not": "f.txt: 9", "or": "f.txt: 6", "to": "f.txt: 0 f.txt: 13", "é": "g.txt: 0", "b": "g.txt: 2", "c": "g.txt: 5"}
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None)], "doc_id long, text string")
    assert sorted(((r["doc"] or 0, r["word"], r["pos"]) for r in text.postings(twice).collect())) == [(0, "a", 0), (1, "a", 0), (1, "a", 0), (1, "b", 2), (1, "b", 2)]


def test_postings_of_long_lines(spark):
    words = [f"w{k}😀" if k % 7 == 0 else f"w{k}" for k in range(3000)]
    long = "\n".join(["x"] * 1500) + "\n" + " ".join(words)
    found = {r["word"]: r["pos"] for r in text.postings(spark.createDataFrame([(1, long)], "doc_id long, text string")).where("word <> 'x'").collect()}
    at = 3000
    for w in words:
        assert found[w] == at
        at += len(w.encode("utf-16-le")) // 2 + 1


def test_ordered_output_and_named_files(spark, tmp_path):
    df = spark.createDataFrame([(w, k) for k, w in enumerate("B a b ä A".split())], "k string, v int").repartition(3)
    sinks.write_key_value(df, f"{tmp_path}/out", "k", "v", ordered=True)
    files = sorted(tmp_path.glob("out/part-*"))
    assert [x.split("\t")[0] for f in files for x in f.read_text().splitlines()] == ["A", "B", "a", "b", "ä"]
    lines = spark.createDataFrame([("x y.txt", 2, "two"), ("x y.txt", 1, "one"), ("z.txt", 1, "only")], "file string, order int, value string")
    for _ in range(2):
        sinks.write_named_files(lines, f"{tmp_path}/named")
    got = {tuple(r) for r in sources.read_lines_with_offset(spark, f"{tmp_path}/named").collect()}
    assert got == {("x y.txt", 0, "one"), ("x y.txt", 4, "two"), ("z.txt", 0, "only")}
    assert {tuple(r) for r in sources.read_lines(spark, f"{tmp_path}/named/file=x y.txt").collect()} == {("x y.txt", "one"), ("x y.txt", "two")}
    kept = folders.settled(sources.read_lines(spark, f"{tmp_path}/named"), f"{tmp_path}/named")
    assert kept.count() == 3 and spark.read.text(f"{tmp_path}/named").count() == 0 and not list(tmp_path.glob("named/file=*"))


EMPLOYEES = "1|D1|300|kim\n2|D2|500|lee\n3|D1|500|park\n4|D3|100|choi\n5|D2|400|jung\nbad|row\n6||900|han\n7|D4|450|yoon|extra\n"


def test_top_k(lines):
    rows = topk.top_k(sources.employees(lines(EMPLOYEES)))
    assert [tuple(r) for r in rows.collect()] == [(2, "D2", 500, "lee"), (3, "D1", 500, "park"), (7, "D4", 450, "yoon")]


def test_top_k_with_repeated_rows(lines):
    rows = sources.employees(lines("1|D|9|a\n1|D|9|a\n2|D|5|b\n"))
    assert [r["id"] for r in topk.top_k(rows, 2).collect()] == [1, 1]
    assert [r["id"] for r in topk.top_k_distinct(rows, 2).collect()] == [1, 2]
    again = rows.repartition(5)
    assert topk.top_k(again, 2).collect() == topk.top_k(rows, 2).collect()


@pytest.mark.parametrize("strategy,plan", [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("hash", "ShuffledHashJoin")])
def test_joins(spark, lines, strategy, plan):
    fact = sources.facts(lines("1|1000|c1\n2|2500|c2\n\n3|700|c9\n4|1200|c1\n"))
    dim = sources.dimension(lines("c1|food\nc2|toys\nc3|books\n"))
    joined = joins.left_join(fact, dim, "category", strategy)
    assert {(r["id"], r["price"], r["category_name"]) for r in joined.collect()} == {("1", "1000", "food"), ("2", "2500", "toys"), ("3", "700", None), ("4", "1200", "food")}
    assert plan in joined._jdf.queryExecution().toString()


def test_joins_keep_fact_rows_when_the_dimension_repeats(spark):
    fact = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    dim = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y")], "k string, name string")
    for strategy in ("broadcast", "merge", "hash"):
        assert {tuple(r) for r in joins.left_join(fact, dim, "k", strategy).select("id", "name").collect()} == {(1, "x"), (2, None)}
    assert "BroadcastHashJoin" not in joins.left_join(fact, dim.hint("merge"), "k", "broadcast", limit=0)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        joins.left_join(fact, dim, "k", "other")


def test_join_takes_the_last_row_of_a_key(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id int, k string")
    dim = spark.createDataFrame([("a", "first", 1), ("a", "last", 3), ("a", "middle", 2), ("b", None, 1), (None, "none", 9)], "k string, name string, line int").repartition(4)
    for strategy in ("broadcast", "merge", "hash"):
        joined = joins.left_join(fact, dim, "k", strategy, order="line")
        assert joined.columns == ["k", "id", "name"] and {tuple(r) for r in joined.select("id", "name").collect()} == {(1, "last"), (2, None), (3, None), (4, None)}
    assert {tuple(r) for r in joins.left_join(fact, dim.drop("line"), "k").select("id", "name").collect()} == {(1, "middle"), (2, None), (3, None), (4, None)}
    with pytest.raises(ValueError, match="rename"):
        joins.left_join(fact, dim.withColumnRenamed("name", "id"), "k")


def test_rendered_joins(spark, lines, tmp_path):
    from pyspark.sql import functions as F

    fact, dim = sources.facts(lines("2|2500|c2\n3|700|c9\n")), sources.dimension(lines("c2|toys\n"))
    for strategy, separator, missing, want in (("broadcast", " ", "null", ["2\t2500 toys", "3\t700 null"]), ("hash", "\t", "", ["2\t2500\ttoys", "3\t700\t"]), ("merge", " ", "", ["2\t2500 toys", "3\t700 "])):
        out = joins.left_join(fact, dim, "category", strategy).select("id", joins.rendered(F.col("price"), F.col("category_name"), separator, missing).alias("v"))
        sinks.write_key_value(out, f"{tmp_path}/{strategy}", "id", "v")
        assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/{strategy}").collect()) == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    path = f"{tmp_path}/out"
    sinks.write_key_value(df, path, "k", "v", overwrite=False)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_key_value(df, path, "k", "v", overwrite=False)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["a\t1", "b\tnull"]
    sinks.write_key_value(df, path, "k")
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["a", "b"]


def test_short_records_fail(spark, lines):
    with pytest.raises(Exception, match="short fact record"):
        sources.facts(lines("1|2\n")).collect()


TF = {"d1.txt": "the cat sat", "d2.txt": "The dog sat sat", "d3.txt": "a cat", "d4.txt": "the end"}
SCORES = {
    ("a", "d3.txt"): (1, 2, 1, 0.6931471805599453), ("cat", "d1.txt"): (1, 3, 2, 0.23104906018664842), ("cat", "d3.txt"): (1, 2, 2, 0.34657359027997264),
    ("dog", "d2.txt"): (1, 4, 1, 0.34657359027997264), ("end", "d4.txt"): (1, 2, 1, 0.6931471805599453), ("sat", "d1.txt"): (1, 3, 2, 0.23104906018664842),
    ("sat", "d2.txt"): (2, 4, 2, 0.34657359027997264), ("the", "d1.txt"): (1, 3, 3, 0.09589402415059362), ("the", "d2.txt"): (1, 4, 3, 0.07192051811294521),
    ("the", "d4.txt"): (1, 2, 3, 0.14384103622589042),
}


@pytest.mark.parametrize("n_docs", [None, 4])
def test_tf_idf(spark, n_docs):
    got = {(r["word"], r["doc"]): (r["n"], r["doc_total"], r["m"], r["score"]) for r in text.tf_idf(docs(spark, TF), n_docs=n_docs).collect()}
    assert got.keys() == SCORES.keys()
    for k, (*whole, score) in SCORES.items():
        assert list(got[k][:3]) == whole and got[k][3] == pytest.approx(score, rel=1e-12)


def pages(spark, n):
    return spark.range(n).selectExpr("cast(id as int) as page")


@pytest.mark.parametrize(
    "iterations,want",
    [(1, [0.25, 0.14375, 0.56875]), (2, [0.5209375202655793, 0.14375, 0.4784374974668026]), (3, [0.4441718608140945, 0.25889843851327893, 0.5935859359800815])],
)
def test_page_rank(spark, lines, iterations, want):
    edges = sources.adjacency(lines("0 1 2\n1 2\n2 0\n3 2\n"))
    got = {r["page"]: r["rank"] for r in graph.page_rank(pages(spark, 4), edges, 4, iterations).collect()}
    assert got == pytest.approx(dict(enumerate(want)), rel=1e-7)


def test_page_rank_textbook(spark, lines):
    edges = sources.adjacency(lines("0 1 2\n1 2\n2 0\n3 2\n"))
    got = {r["page"]: r["rank"] for r in graph.page_rank_textbook(pages(spark, 4), edges, 4).collect()}
    assert got == pytest.approx({0: 0.29064062499999993, 1: 0.25889843749999997, 2: 0.4129609374999999, 3: 0.0375})


def test_page_rank_with_a_dangling_page(spark, lines):
    edges = sources.adjacency(lines("0 1\n1\n"))
    assert [tuple(r) for r in graph.page_rank(pages(spark, 2), edges, 2, 1).collect()] == [(1, pytest.approx(0.5))]
    assert {r["page"]: r["rank"] for r in graph.page_rank_textbook(pages(spark, 2), edges, 2, 1).collect()} == pytest.approx({0: 0.075, 1: 0.5})


def test_many_iterations_are_cut(spark, lines):
    edges = sources.adjacency(lines("0 1\n1 0\n"))
    assert {r["page"]: r["rank"] for r in graph.page_rank(pages(spark, 2), edges, 2, 7).collect()} == pytest.approx({0: 0.5, 1: 0.5}, rel=1e-6)


def test_kmeans(lines):
    points = sources.points(lines("1,1\n2,1\n1,2\n4,3\n5,5\n8,8\n9,8\n8,9\nbad\n"))
    assigned = {(r["x"], r["y"]): r["cluster"] for r in cluster.kmeans_assign(points, cluster.SEEDS).collect()}
    assert assigned[(4.0, 3.0)] == 0 and assigned[(5.0, 5.0)] == 1
    step, centres = cluster.kmeans(points)
    assert centres == [(2.0, 1.75), (7.5, 7.5)]
    assert {tuple(r) for r in step.collect()} == {(0, 2.0, 1.75, 4), (1, 7.5, 7.5, 4)}


def test_kmeans_keeps_a_centre_without_points(lines):
    step, centres = cluster.kmeans(sources.points(lines("1,1\n")), [(0.0, 0.0), (50.0, 50.0)])
    assert centres == [(1.0, 1.0), (50.0, 50.0)] and step.count() == 1


def test_kmeans_options(spark, lines):
    points = sources.points(lines("1,1\n200000,3\n200000,4\n"))
    assert cluster.kmeans_assign(points, []).collect() == [] and cluster.kmeans(points, [])[0].collect() == []
    centres = [(0.0, 0.0), (50.0, 50.0)]
    assert [r["cluster"] for r in cluster.kmeans_assign(points, centres).orderBy("y").collect()] == [0, 1, 1]
    assert [r["cluster"] for r in cluster.kmeans_assign(points, centres, cutoff=100_000.0).collect()] == [0, 0, 0]
    seen = []
    cluster.kmeans(points, centres, progress=lambda k, c: seen.append((k, c)))
    assert [k for k, _ in seen] == list(range(1, len(seen) + 1)) and seen[-1][1] == seen[-2][1]
    many = [(float(k * 37 % 101), float(k * 53 % 97)) for k in range(200)]
    grid = spark.range(400).selectExpr("cast(id % 20 * 5 as double) as x", "cast(id div 20 * 5 as double) as y")
    one, other = (cluster.kmeans_assign(grid, many, literals=n) for n in (1000, 1))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert "Join" not in other._jdf.queryExecution().toString()


def test_page_rank_has_one_join_an_iteration(spark, lines):
    edges = sources.adjacency(lines("0 1 2\n1 2\n2 0\n3 2\n"))
    plans = [graph.page_rank(pages(spark, 4), edges, 4, k)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") for k in (2, 3, 4, 5)]
    assert plans == [1, 2, 3, 4]


A, B = "0 0 1\n0 1 2\n1 0 3\n1 1 4\n", "0 0 5\n0 1 6\n1 0 7\n1 1 8\n"


def cells(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect()}


def test_matrices(lines):
    a, b = sources.cells(lines(A)), sources.cells(lines(B))
    assert cells(matrix.matrix_add(a, b)) == {(0, 0): 6, (0, 1): 8, (1, 0): 10, (1, 1): 12}
    assert cells(matrix.matrix_multiply(a, b)) == {(0, 0): 19, (0, 1): 22, (1, 0): 43, (1, 1): 50}
    sparse = sources.cells(lines("0 0 1\n1 1 4\n"))
    assert cells(matrix.matrix_multiply(sparse, b)) == {(0, 0): 5, (0, 1): 6, (1, 0): 28, (1, 1): 32}


def test_products_do_not_wrap(spark):
    big = spark.createDataFrame([(0, 0, 2**31 - 1)], "i int, j int, v int")
    assert cells(matrix.matrix_multiply(big, big)) == {(0, 0): (2**31 - 1) ** 2} and cells(matrix.matrix_add(big, big)) == {(0, 0): 2**32 - 2}
