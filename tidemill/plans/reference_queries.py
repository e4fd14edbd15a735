"""Queries for the inventory's operators over the test tables, and the DuckDB SQL that checks each.

Doubles are rounded to six places on both sides: their sums depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.chain import Stage, run_chain
from tidemill.folders import forget, new_folder, settled, tidy
from tidemill.operators import cluster, graph, joins, maintained, matrix, postings, text, topk
from tidemill.operators.spread import parts_of, spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Text

_TOKENS = "select doc_id as doc, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')) as word from documents"
_COUNTS = f"counts as (select word, doc, count(*) as n from ({_TOKENS}) where word <> '' group by all)"
_FULL = f"""with {_COUNTS}, full_ as (
  select word, doc, n, cast(sum(n) over (partition by doc) as bigint) as doc_total, count(*) over (partition by word) as m from counts)"""

_TF_IDF = f"{_FULL} select word, doc, n, doc_total, m, round(n / doc_total * ln((select count(*) from documents)::double / m), 6) as score from full_"

_POSTINGS = """lines as (
  select doc_id as doc, generate_subscripts(ls, 1) as line, unnest(ls) as value
  from (select doc_id, string_split(text, chr(10)) as ls from documents)),
starts as (
  select doc, line, value, coalesce(sum(strlen(value) + 1) over (partition by doc order by line rows between unbounded preceding and 1 preceding), 0) as start from lines),
toks as (
  select doc, line, start, generate_subscripts(ts, 1) as k, unnest(ts) as word
  from (select doc, line, start, list_filter(regexp_split_to_array(value, '[ \\t\\r\\f]+'), lambda t: t <> '') as ts from starts)),
posts as (
  select word, doc, cast(start + coalesce(sum(length(word) + 1) over (partition by doc, line order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from toks)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _tf_count(spark, sf_dir):
    return text.term_counts(_docs(spark, sf_dir))


def _tf_idf(spark, sf_dir):
    return text.tf_idf(_docs(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _tf_idf_chain(spark, sf_dir):
    """Counts with their totals, frequencies and scores as stages of a chain, each written and marked. Frequencies have a row a word; they meet the counts where scores are made."""
    stages = [
        Stage("totals", lambda _, docs: text.with_doc_total(text.term_counts(docs)), ["documents"]),
        Stage("freqs", lambda _, totals: text.doc_freqs(totals), ["totals"]),
        Stage("scores", lambda _, totals, freqs, docs: totals.join(freqs, "word").select("word", "doc", "n", "doc_total", "m", text.tf_idf_score(docs.agg(F.count("*")).scalar()).alias("score")), ["totals", "freqs", "documents"]),
    ]
    folder = new_folder(spark, "chain")
    scores = run_chain(spark, folder, {"documents": f"{sf_dir}/documents.parquet"}, stages)
    return settled(scores.select("word", "doc", "n", "doc_total", "m", F.round("score", 6).alias("score")))


def _tf_idf_maintained(spark, sf_dir):
    """Documents without labels first; then the labelled ones are added, removed, and added again.

    A step's tables are emptied when the next ones stand. The result is made from the last ones when it is read, as written rows of it are many times as large.
    """
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id").distinct()
    folder = new_folder(spark, "tables")
    more = docs.join(labels, "doc_id", "left_semi")
    new = lambda k: f"{folder}/new-{k}"
    tables = maintained.term_tables(docs.join(labels, "doc_id", "left_anti"), folder=new(0)).written(f"{folder}/0")
    forget(spark, new(0))
    tables = maintained.added(tables, more, folder=new(1)).written(f"{folder}/1")
    forget(spark, f"{folder}/0", new(1))
    tables = maintained.removed(tables, labels).written(f"{folder}/2")
    forget(spark, f"{folder}/1")
    tables = maintained.added(tables, more, folder=new(3)).written(f"{folder}/3")
    forget(spark, f"{folder}/2", new(3))
    scores = maintained.scores(tables, f"{folder}/scores")
    forget(spark, f"{folder}/3/counts")
    tidy(spark)
    return scores.withColumn("score", F.round("score", 6))


# Posting lists as blocks, written and read back


def _blocks(spark, sf_dir):
    folder = new_folder(spark, "blocks")
    postings.posting_blocks(text.postings(_docs(spark, sf_dir))).write.parquet(folder)
    return spark.read.parquet(folder), folder


def _index_blocks(spark, sf_dir):
    """Of each word, from the blocks' headers alone: postings, and the first and the last one."""
    blocks, folder = _blocks(spark, sf_dir)
    ends = blocks.groupBy("word").agg(F.sum("n").alias("n"), F.min("first").alias("a"), F.max("last").alias("z"))
    return settled(ends.select("word", "n", *(F.col(f"{e}.{c}").alias(f"{name}_{c}") for e, name in (("a", "first"), ("z", "last")) for c in ("doc", "pos"))), folder)


def _index_read(spark, sf_dir):
    blocks, folder = _blocks(spark, sf_dir)
    return settled(postings.read_blocks(blocks), folder)


_INDEX_BLOCKS = f"""with {_POSTINGS}, ends as (select word, count(*) as n, min({{'doc': doc, 'pos': pos}}) as a, max({{'doc': doc, 'pos': pos}}) as z from posts group by word)
select word, n, a.doc as first_doc, a.pos as first_pos, z.doc as last_doc, z.pos as last_pos from ends"""

# Top-k


def _salaries(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("int").alias("salary"))


def _top_k_distinct(spark, sf_dir):
    rows = _salaries(spark, sf_dir)
    return topk.top_k_distinct(rows.unionAll(rows))


_TOP_K = "select o_orderkey as id, cast(floor(o_totalprice) as int) as salary from orders order by salary desc, id limit 3"

# Joins: customers with the last supplier (by key) of their nation; a nation can have many suppliers or none.


def _join(strategy: str, separator: str, missing: str) -> Query:
    def run(spark, sf_dir):
        fact = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("category"))
        dim = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("category"), F.col("s_name").alias("category_name"), F.col("s_suppkey").alias("line"))
        joined = joins.left_join(fact, dim, "category", strategy, order="line")
        return joined.select("id", "category", "category_name", joins.rendered(F.col("category"), F.col("category_name"), separator, missing).alias("value"))

    return run


def _join_tagged(spark, sf_dir):
    fact = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("category"))
    dim = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("category"), F.col("s_name").alias("category_name"), F.col("s_suppkey").alias("line"))
    joined = joins.tagged_join(fact, dim, "category", order="line")
    return joined.select("id", "category", "category_name", joins.rendered(F.col("category"), F.col("category_name"), " ", "").alias("value"))


def _join_sql(separator: str, missing: str) -> str:
    return f"""select c_custkey as id, c_nationkey as category, name as category_name, c_nationkey::varchar || {separator} || coalesce(name, '{missing}') as value
from customer left join (select s_nationkey, arg_max(s_name, s_suppkey) as name from supplier group by s_nationkey) on c_nationkey = s_nationkey"""


# Matrices: the vectors' components in hundredths, a row a vector. The product is that of the transposed matrix with
# the matrix itself, so that the inner index runs over all vectors.


def _cells(spark, sf_dir, dealt=lambda df: df):
    vectors = dealt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return vectors.select(F.col("vec_id").cast("int").alias("i"), F.posexplode("embedding").alias("j", "x")).select("i", "j", F.round(F.col("x").cast("double") * 100).cast("int").alias("v"))


def _matrix_add(spark, sf_dir):
    a = _cells(spark, sf_dir)
    return matrix.matrix_add(a, a.where("(i + j) % 2 = 0"))


def _matrix_multiply(spark, sf_dir):
    a = _cells(spark, sf_dir, spread)
    return matrix.matrix_multiply(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a)


def _matrix_multiply_tiled(spark, sf_dir):
    a = _cells(spark, sf_dir, spread)
    return matrix.matrix_multiply_tiled(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a)


_CELLS = """cells as (select cast(vec_id as int) as i, cast(generate_subscripts(embedding, 1) - 1 as int) as j, cast(round(cast(unnest(embedding) as double) * 100) as int) as v
from embeddings)"""
_ADD = "select i, j, cast(sum(v) as bigint) as v from (select * from cells union all select * from cells where (i + j) % 2 = 0) group by i, j"
_MULTIPLY = "select a.j as i, b.j, cast(sum(cast(a.v as bigint) * b.v) as bigint) as v from cells a join cells b on a.i = b.i group by a.j, b.j"

# PageRank on parts: an edge from each part of an order to the next one, by line number and part.


def _graph(spark, sf_dir):
    follow = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(follow).alias("dst"))
    steps = lines.where("dst is not null").select("src", "dst")
    pairs = steps.repartition(parts_of(steps), "src", "dst").distinct()
    edges = pairs.join(pairs.groupBy("src").agg(F.count("*").alias("out_degree")), "src")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page")), edges


def _page_rank(spark, sf_dir):
    pages, edges = _graph(spark, sf_dir)
    return graph.page_rank(pages, edges, n_pages=pages.count()).select("page", F.round("rank", 9).alias("rank"))


def _page_rank_textbook(spark, sf_dir):
    pages, edges = _graph(spark, sf_dir)
    return graph.page_rank_textbook(pages, edges, n_pages=pages.count()).select("page", F.round("rank", 9).alias("rank"))


#: The residual that pages do not send, as a share of the mean rank, and more rounds than this takes.
_UNSENT, _ROUNDS = 1e-3, 60


def _page_rank_converged(spark, sf_dir):
    pages, edges = _graph(spark, sf_dir)
    n = pages.count()
    return graph.page_rank_converged(pages, edges, n_pages=n, bound=_UNSENT / n).select("page", F.round("rank", 9).alias("rank"))


_FOLLOW = """pairs as (select distinct src, dst from (
  select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem) where dst is not null)"""
_EDGES = f"""{_FOLLOW},
edges as (select src, dst, count(*) over (partition by src) as deg from pairs),
size as (select cast(count(*) as double) as n from part)"""


def _page_rank_sql(textbook: bool) -> str:
    kept = "0.15::double / n" if textbook else "r.rank"
    stored = "double" if textbook else "float"
    ctes = [_EDGES, f"r0 as (select p_partkey as page, cast(cast(1.0::double / n as {stored}) as double) as rank from part, size)"]
    for k in range(1, 4):
        ctes.append(f"in{k} as (select dst, 0.15::double / any_value(n) + 0.85::double * sum(rank / deg) as rank from edges join r{k - 1} on src = page, size group by dst)")
        ctes.append(f"r{k} as (select r.page, coalesce(cast(cast(i.rank as {stored}) as double), {kept}) as rank from r{k - 1} r left join in{k} i on r.page = i.dst, size)")
    last = "select page, round(rank, 9) as rank from r3" if textbook else "select dst as page, round(rank, 9) as rank from in3"
    return f"with {', '.join(ctes)} {last}"


_CONVERGED = f"""with recursive {_EDGES},
state(round, page, rank, residual) as (
  select 0, p_partkey, 0.15::double / n, 0.15::double / n from part, size
  union all
  select round + 1, s.page, rank + coalesce(got, 0), case when abs(residual) > {_UNSENT} / n then 0 else residual end + coalesce(got, 0)
  from state s left join (
    select dst, sum(0.85::double * residual / deg) as got from state join edges on src = page, size where abs(residual) > {_UNSENT} / n group by dst) m on m.dst = s.page, size
  where round < {_ROUNDS})
select page, round(rank, 9) as rank from state where round = {_ROUNDS}"""

# K-means on (l_quantity / 5, l_discount * 100)

#: Steps to which the SQL of the loop is unrolled; those after the fixpoint change nothing.
STEPS = 30


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 5).alias("x"), (F.col("l_discount") * 100).alias("y"))


def _kmeans_assign(spark, sf_dir):
    return cluster.kmeans_assign(_points(spark, sf_dir), cluster.SEEDS).select("l_orderkey", "l_linenumber", "cluster")


def _rounded(step: DataFrame) -> DataFrame:
    return step.select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


def _kmeans_step(spark, sf_dir):
    return _rounded(cluster.kmeans_step(_points(spark, sf_dir), cluster.SEEDS))


def _kmeans(spark, sf_dir):
    """Until no centre moves. The points are held while the loop reads them, and the result no longer needs them."""
    points = spread(_points(spark, sf_dir).select("x", "y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _rounded(cluster.kmeans(points, cluster.SEEDS)[0])
    finally:
        points.unpersist()


_KPOINTS = "pts as (select l_orderkey, l_linenumber, l_quantity / 5 as x, l_discount * 100 as y from lineitem)"


def _away(k: str) -> str:
    return f"sqrt((x - c.x{k}) * (x - c.x{k}) + (y - c.y{k}) * (y - c.y{k}))"


_ASSIGN = f"case when {_away('0')} <= {_away('1')} then 0 else 1 end"


def _kmeans_sql(steps: int) -> str:
    ctes = [_KPOINTS, "c0 as (select 0.0::double as x0, 0.0::double as y0, 7.0::double as x1, 7.0::double as y1)"]
    for k in range(1, steps):
        ctes.append(f"s{k} as (select {_ASSIGN} as cluster, avg(x) as mx, avg(y) as my from pts, c{k - 1} c group by 1)")
        old = f"c{k - 1}"
        ctes.append(
            f"c{k} as (select "
            + ", ".join(f"coalesce((select cast(cast(m{a} as float) as double) from s{k} where cluster = {i}), {a}{i}) as {a}{i}" for i in (0, 1) for a in "xy")
            + f" from {old})"
        )
    return f"""with {', '.join(ctes)} select cast({_ASSIGN} as int) as cluster, round(avg(pts.x), 6) as x, round(avg(pts.y), 6) as y, count(*) as n
from pts, c{steps - 1} c group by 1"""


_CENTRES = "c as (select 0.0::double as x0, 0.0::double as y0, 7.0::double as x1, 7.0::double as y1)"

#: name: (query, SQL)
QUERIES: dict[str, tuple[Query, str]] = {
    "word_count": (lambda s, d: text.word_count(_docs(s, d)), f"select word, count(*) as cnt from ({_TOKENS}) where word <> '' group by word"),
    "inverted_index_postings": (lambda s, d: text.postings(_docs(s, d)), f"with {_POSTINGS} select word, doc, pos from posts"),
    "inverted_index": (
        lambda s, d: text.inverted_index(_docs(s, d)),
        f"with {_POSTINGS} select word, string_agg(doc::varchar || ': ' || pos::varchar, ' ' order by doc, pos) as postings from posts group by word",
    ),
    "inverted_index_blocks": (_index_blocks, _INDEX_BLOCKS),
    "inverted_index_read": (_index_read, f"with {_POSTINGS} select word, doc, pos from posts"),
    "tf_count": (_tf_count, f"with {_COUNTS} select word, doc, n from counts"),
    "tf_doc_total": (lambda s, d: text.with_doc_total(_tf_count(s, d)), f"{_FULL} select word, doc, n, doc_total from full_"),
    "tf_doc_freq": (lambda s, d: text.with_doc_freq(_tf_count(s, d)), f"{_FULL} select word, doc, n, m from full_"),
    "tf_idf": (_tf_idf, _TF_IDF),
    "tf_idf_chain": (_tf_idf_chain, _TF_IDF),
    "tf_idf_maintained": (_tf_idf_maintained, _TF_IDF),
    "top_k": (lambda s, d: topk.top_k(_salaries(s, d)), _TOP_K),
    "top_k_distinct": (_top_k_distinct, _TOP_K),
    "join_map_side": (_join("broadcast", " ", "null"), _join_sql("' '", "null")),
    "join_reduce_side": (_join("hash", "\t", ""), _join_sql("chr(9)", "")),
    "join_secondary_sort": (_join("merge", " ", ""), _join_sql("' '", "")),
    "join_tagged": (_join_tagged, _join_sql("' '", "")),
    "matrix_add": (_matrix_add, f"with {_CELLS} {_ADD}"),
    "matrix_multiply": (_matrix_multiply, f"with {_CELLS} {_MULTIPLY}"),
    "matrix_multiply_tiled": (_matrix_multiply_tiled, f"with {_CELLS} {_MULTIPLY}"),
    "page_rank": (_page_rank, _page_rank_sql(False)),
    "page_rank_textbook": (_page_rank_textbook, _page_rank_sql(True)),
    "page_rank_converged": (_page_rank_converged, _CONVERGED),
    "kmeans_assign": (_kmeans_assign, f"with {_KPOINTS}, {_CENTRES} select l_orderkey, l_linenumber, cast({_ASSIGN} as int) as cluster from pts, c"),
    "kmeans_step": (_kmeans_step, _kmeans_sql(1)),
    "kmeans": (_kmeans, _kmeans_sql(STEPS)),
}
