"""Queries over text files: tables are written as text into the shared folder and read back by the parsers of the layouts.

Each has DuckDB SQL that works out, from the tables alone, what the files must hold and what the query must give. The
files have names of their own, with their lines in order of the table's key, so names and byte offsets are known. Results
are settled, and the folders emptied, before they are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.folders import forget, new_folder, settled
from tidemill.operators import cluster, graph, joins, matrix, text, topk
from tidemill.plans.reference_queries import _ASSIGN, _CELLS, _CENTRES, _FOLLOW, _MULTIPLY, Query, _cells, _graph, _rounded, table
from tidemill.sources import sinks
from tidemill.sources import text as sources


def _files(lines: DataFrame, name: str) -> str:
    """The folder of the files (file, order, value)."""
    folder = new_folder(lines.sparkSession, name)
    sinks.write_named_files(lines, folder)
    return folder


def _line(delimiter: str, *columns: Column | str) -> Column:
    """The columns as one delimited line; nulls are left out, so their fields are missing."""
    return F.concat_ws(delimiter, *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))


# Lines of documents, one file a source; the texts' own line ends make further lines.


def _document_lines(spark, sf_dir):
    name = F.concat(F.col("lang"), F.lit("-"), F.col("doc_id") % 5, F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(name.alias("file"), F.col("doc_id").alias("order"), F.col("text").alias("value"))


def _texts(spark, sf_dir):
    return _files(_document_lines(spark, sf_dir), "texts")


def _text_lines(spark, sf_dir):
    folder = _texts(spark, sf_dir)
    return settled(sources.read_lines(spark, folder).groupBy("file", "value").agg(F.count("*").alias("n")), folder)


def _text_line_offsets(spark, sf_dir):
    folder = _texts(spark, sf_dir)
    return settled(sources.read_lines_with_offset(spark, folder), folder)


def _text_inverted_index(spark, sf_dir):
    lines = _text_line_offsets(spark, sf_dir).select(F.col("file").alias("doc"), F.col("offset").alias("start"), "value")
    return text.listed(text.postings_of_lines(lines))


_TEXT_FILES = """files as (select lang || '-' || (doc_id % 5) || '.txt' as file, doc_id, coalesce(text, '') || chr(10) as text from documents),
rows_ as (select file, doc_id, regexp_replace(text, chr(10) || '$', '') as text,
  coalesce(sum(strlen(text)) over (partition by file order by doc_id rows between unbounded preceding and 1 preceding), 0) as base from files),
parts as (select file, doc_id, base, generate_subscripts(ls, 1) as k, unnest(ls) as value from (select file, doc_id, base, string_split(text, chr(10)) as ls from rows_)),
lines as (select file, value, cast(base + coalesce(sum(strlen(value) + 1) over (partition by file, doc_id order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as start from parts)"""


def _text_line_places(spark, sf_dir):
    """The byte of its file at which the sink puts each document."""
    return settled(sinks.placed_lines(_document_lines(spark, sf_dir)).select("file", F.col("order").alias("doc_id"), "offset"))


_TEXT_POSTINGS = """toks as (select file, start, generate_subscripts(ts, 1) as k, unnest(ts) as word
  from (select file, start, list_filter(regexp_split_to_array(value, '[ \\t\\r\\f]+'), lambda t: t <> '') as ts from lines)),
posts as (select word, file, start + coalesce(sum(length(word) + 1) over (partition by file, start order by k rows between unbounded preceding and 1 preceding), 0) as pos from toks)"""


def _text_word_count(spark, sf_dir):
    """Counted from the files, written in order of the word with tabs between, read back and parsed."""
    folder, out = _texts(spark, sf_dir), new_folder(spark, "counts")
    sinks.write_key_value(text.word_count(sources.read_lines(spark, folder), "value"), out, "word", "cnt", ordered=True)
    parts = F.split("value", "\t")
    return settled(sources.read_lines(spark, out).select(parts[0].alias("word"), parts[1].cast("long").alias("cnt")), folder, out)


# Employees: an order is one; of orders with status P the department is missing, so their lines are short.


def _text_top_k(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    dept = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
    lines = orders.select(F.lit("employees.txt").alias("file"), F.col("o_orderkey").alias("order"), _line("|", "o_orderkey", dept, F.floor("o_totalprice").cast("int"), F.lit("info"), F.lit("more")).alias("value"))
    short = F.regexp_replace("value", "\\|info\\|more$", "|info")
    lines = lines.withColumn("value", F.when(F.size(F.split("value", "\\|")) < 5, short).otherwise(F.col("value")))
    folder, out = _files(lines, "employees"), new_folder(spark, "top")
    top = topk.top_k(sources.employees(sources.read_lines(spark, folder)), 10)
    sinks.write_key_value(top.select(_line(" | ", "id", "dept_id", "salary", "emp_info").alias("line")), out, "line")
    return settled(sources.read_lines(spark, out).select("value"), folder, out)


_TEXT_TOP_K = """select o_orderkey || ' | ' || o_orderstatus || ' | ' || cast(floor(o_totalprice) as int) || ' | info' as value
from orders where o_orderstatus <> 'P' order by cast(floor(o_totalprice) as int) desc, o_orderkey limit 10"""


# Joins: facts and dimension in one folder, told apart by name; the dimension repeats its keys, the last line wins.


def _text_join(strategy: str, separator: str, missing: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = table(spark, sf_dir, "customer").select(F.lit("fileA.txt").alias("file"), F.col("c_custkey").alias("order"), _line("|", "c_custkey", "c_acctbal", "c_nationkey").alias("value"))
        dims = table(spark, sf_dir, "supplier").select(F.lit("fileB.txt").alias("file"), F.col("s_suppkey").alias("order"), _line("|", "s_nationkey", "s_name").alias("value"))
        folder = _files(facts.unionAll(dims), "join")
        dim = sources.read_lines_with_offset(spark, f"{folder}/file=fileB.txt")
        named = sources.dimension(dim, keep=("offset",))
        joined = joins.left_join(sources.facts(sources.read_lines(spark, f"{folder}/file=fileA.txt")), named, "category", strategy, order="offset")
        out = new_folder(spark, "joined")
        value = joins.rendered(F.col("price"), F.col("category_name"), separator, missing)
        sinks.write_key_value(joined.select("id", value.alias("value")), out, "id", "value", overwrite=False)
        return settled(sources.read_lines(spark, out).select("value"), folder, out)

    return run


# The same from one scan of a mixed folder, where files that are neither facts nor dimension lie as well.


def _text_join_tagged(spark, sf_dir):
    line = lambda name, at, order, *columns: table(spark, sf_dir, name).select(F.lit(at).alias("file"), F.col(order).alias("order"), _line("|", *columns).alias("value"))
    facts, dims = line("customer", "fileA.txt", "c_custkey", "c_custkey", "c_acctbal", "c_nationkey"), line("supplier", "fileB.txt", "s_suppkey", "s_nationkey", "s_name")
    folder = _files(facts.unionAll(dims).unionAll(line("orders", "notes.txt", "o_orderkey", "o_orderkey")), "mixed")
    rows = sources.tagged_records(sources.read_tagged(spark, folder, [sources.Named("fact", "fileA"), sources.Named("dimension", "fileB")]))
    joined = joins.carried_join(rows, "category", F.col("tag") == "fact", "line", ("category_name",))
    return settled(joined.select(F.concat_ws("\t", "id", joins.rendered(F.col("price"), F.col("category_name"), " ", "")).alias("value")), folder)


def _text_join_sql(separator: str, missing: str) -> str:
    return f"""select c_custkey || chr(9) || c_acctbal || {separator} || coalesce(name, '{missing}') as value
from customer left join (select s_nationkey, arg_max(s_name, s_suppkey) as name from supplier group by s_nationkey) on c_nationkey = s_nationkey"""


# Adjacency: a line for each part with those that follow it in an order; points: a seventh line of an order lacks y.


def _text_page_rank(spark, sf_dir):
    pairs = _graph(spark, sf_dir)[1].groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    lines = pairs.select(F.lit("graph.txt").alias("file"), F.col("src").alias("order"), _line(" ", "src", F.array_join("targets", "  ")).alias("value"))
    folder = _files(lines, "graph")
    edges = settled(sources.adjacency(sources.read_lines(spark, folder)), folder)
    pages = settled(edges.select(F.col("src").alias("page")).unionAll(edges.select("dst")).distinct())
    return graph.page_rank(pages, edges, n_pages=pages.count()).select("page", F.round("rank", 9).alias("rank"))


_TEXT_EDGES = f"""{_FOLLOW},
edges as (select src, dst, count(*) over (partition by src) as deg from pairs),
pages as (select src as page from pairs union select dst from pairs), size as (select cast(count(*) as double) as n from pages)"""


def _text_page_rank_sql() -> str:
    ctes = [_TEXT_EDGES, "r0 as (select page, cast(cast(1.0::double / n as float) as double) as rank from pages, size)"]
    for k in range(1, 4):
        ctes.append(f"in{k} as (select dst, 0.15::double / any_value(n) + 0.85::double * sum(rank / deg) as rank from edges join r{k - 1} on src = page, size group by dst)")
        ctes.append(f"r{k} as (select r.page, coalesce(cast(cast(i.rank as float) as double), r.rank) as rank from r{k - 1} r left join in{k} i on r.page = i.dst)")
    return f"with {', '.join(ctes)} select cast(dst as int) as page, round(rank, 9) as rank from in3"


def _text_kmeans_step(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_linenumber") < 7, F.col("l_discount") * 100)
    rows = lines.select(F.lit("points.txt").alias("file"), F.col("l_orderkey").alias("order"), _line(",", F.concat(F.lit(" "), (F.col("l_quantity") / 5).cast("string")), y).alias("value"))
    folder = _files(rows, "points")
    return settled(_rounded(cluster.kmeans_step(sources.points(sources.read_lines(spark, folder)), cluster.SEEDS)), folder)


_TEXT_KMEANS = f"""with pts as (select l_quantity / 5 as x, l_discount * 100 as y from lineitem where l_linenumber < 7), {_CENTRES}
select cast({_ASSIGN} as int) as cluster, round(avg(pts.x), 6) as x, round(avg(pts.y), 6) as y, count(*) as n from pts, c group by 1"""


def _text_matrix_multiply(spark, sf_dir):
    a = _cells(spark, sf_dir)
    line = lambda i, j, name: a.select(F.lit(name).alias("file"), F.col("i").alias("order"), _line(" ", i, j, "v").alias("value"))
    folder = _files(line("j", "i", "matrix_a.txt").unionAll(line("i", "j", "matrix_b.txt")), "matrix")
    return settled(matrix.matrix_multiply(*(sources.cells(sources.read_lines(spark, f"{folder}/file=matrix_{k}.txt")) for k in "ab")), folder)


def _text_matrix_tagged(spark, sf_dir):
    """Both matrices from one mixed folder by their files' exact names; a third file lies there too."""
    a = _cells(spark, sf_dir)
    line = lambda i, j, name: a.select(F.lit(name).alias("file"), F.struct(i, j).alias("order"), _line(" ", i, j, "v").alias("value"))
    folder = _files(line("j", "i", "matrix_a.txt").unionAll(line("i", "j", "matrix_b.txt")).unionAll(line("i", "j", "matrix_a.txt.old")), "matrix")
    rows = sources.read_tagged(spark, folder, [sources.Named(k, f"matrix_{k}.txt", equals=True) for k in "ab"])
    return settled(matrix.matrix_multiply_tiled(*(sources.cells(rows.where(F.col("tag") == k)) for k in "ab")), folder)


def _sink_modes(spark, sf_dir):
    """A folder written, refused, and replaced: (attempt, rows read after it, whether it was refused)."""
    nations, regions = table(spark, sf_dir, "nation").select(F.col("n_name").alias("k")), table(spark, sf_dir, "region").select(F.col("r_name").alias("k"))
    out, rows = new_folder(spark, "modes"), []
    for attempt, (df, overwrite) in enumerate(((nations, False), (regions, False), (regions, True))):
        refused = False
        try:
            sinks.write_key_value(df, out, "k", overwrite=overwrite)
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
            refused = True
        rows.append((attempt, sources.read_lines(spark, out).count(), refused))
    forget(spark, out)
    return spark.createDataFrame(rows, "attempt int, n long, refused boolean")


QUERIES: dict[str, tuple[Query, str]] = {
    "text_lines": (_text_lines, f"with {_TEXT_FILES} select file, value, count(*) as n from lines group by file, value"),
    "text_line_offsets": (_text_line_offsets, f"with {_TEXT_FILES} select file, start as \"offset\", value from lines"),
    "text_line_places": (_text_line_places, f"with {_TEXT_FILES} select file, doc_id, cast(base as bigint) as \"offset\" from rows_"),
    "text_inverted_index": (
        _text_inverted_index,
        f"with {_TEXT_FILES}, {_TEXT_POSTINGS} select word, string_agg(file || ': ' || pos::varchar, ' ' order by file, pos) as postings from posts group by word",
    ),
    "text_word_count": (
        _text_word_count,
        "select word, count(*) as cnt from (select unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')) as word from documents) where word <> '' group by word",
    ),
    "text_top_k": (_text_top_k, _TEXT_TOP_K),
    "text_join_map_side": (_text_join("broadcast", " ", "null"), _text_join_sql("' '", "null")),
    "text_join_reduce_side": (_text_join("hash", "\t", ""), _text_join_sql("chr(9)", "")),
    "text_join_secondary_sort": (_text_join("merge", " ", ""), _text_join_sql("' '", "")),
    "text_join_tagged": (_text_join_tagged, _text_join_sql("' '", "")),
    "text_page_rank": (_text_page_rank, _text_page_rank_sql()),
    "text_kmeans_step": (_text_kmeans_step, _TEXT_KMEANS),
    "text_matrix_multiply": (_text_matrix_multiply, f"with {_CELLS} {_MULTIPLY}"),
    "text_matrix_tagged": (_text_matrix_tagged, f"with {_CELLS} {_MULTIPLY}"),
    "sink_modes": (
        _sink_modes,
        "select attempt::int as attempt, case when attempt = 2 then (select count(*) from region) else (select count(*) from nation) end as n, attempt = 1 as refused from range(3) t(attempt)",
    ),
}
