"""TF-IDF that is kept up to date: the counts of texts that are added or removed are merged into tables, and old texts are not read again.

The tables: counts (word, doc, n), freqs (word, m), rows (doc, rows). Each change gives new tables; write them to keep them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.folders import tidy
from tidemill.operators import text


@dataclass(frozen=True)
class TermTables:
    """counts: how often a word stands in a document; freqs: the documents that hold a word; rows: the rows of texts that a document has."""

    counts: DataFrame
    freqs: DataFrame
    rows: DataFrame

    def written(self, folder: str) -> TermTables:
        """The tables, written as Parquet to a new folder and read from there. Counts stand in order of their words, which compress so; the shuffles of a table go before the next one is made."""
        spark = self.counts.sparkSession
        for name in ("counts", "freqs", "rows"):
            _kept(getattr(self, name), f"{folder}/{name}")
        return read_tables(spark, folder)


def _kept(table: DataFrame, path: str) -> DataFrame:
    """table written to path, each file in order of its words, and read from there."""
    spark = table.sparkSession
    (table.sortWithinPartitions("word") if "word" in table.columns else table).write.parquet(path)
    tidy(spark)
    return spark.read.parquet(path)


def read_tables(spark: SparkSession, folder: str) -> TermTables:
    return TermTables(*(spark.read.parquet(f"{folder}/{name}") for name in ("counts", "freqs", "rows")))


def term_tables(docs: DataFrame, doc: str = "doc_id", text_: str = "text", folder: str | None = None) -> TermTables:
    """The tables of documents; a document's further rows are more of its text. Null ids are not kept: they could not be removed again.

    folder: a new one, to which the counts are written first, so that texts are tokenised and dealt once for all tables.
    """
    known = docs.where(F.col(doc).isNotNull())
    counts = text.term_counts(known, doc, text_)
    if folder:
        counts = _kept(counts, f"{folder}/counts")
    return TermTables(counts, text.doc_freqs(counts), known.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("rows")))


def _summed(one: DataFrame, other: DataFrame, by: list[str], value: str) -> DataFrame:
    """The sums of both tables; rows of 0 go."""
    return one.unionByName(other).groupBy(*by).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def added(tables: TermTables, docs: DataFrame, doc: str = "doc_id", text_: str = "text", folder: str | None = None) -> TermTables:
    """The tables with more rows of text, of new documents or of ones that are there. folder: see term_tables."""
    new = term_tables(docs, doc, text_, folder)
    rows = _summed(tables.rows, new.rows, ["doc"], "rows")
    if new.rows.join(tables.rows, "doc", "left_semi").isEmpty():
        # No document was there before, so nothing is merged but the frequencies: the old counts are neither dealt nor compared.
        return TermTables(tables.counts.unionByName(new.counts), _summed(tables.freqs, new.freqs, ["word"], "m"), rows)
    # A word counts for a document once, also where the document held it before.
    first = new.counts.join(tables.counts.select("word", "doc"), ["word", "doc"], "left_anti")
    return TermTables(_summed(tables.counts, new.counts, ["word", "doc"], "n"), _summed(tables.freqs, text.doc_freqs(first), ["word"], "m"), rows)


def removed(tables: TermTables, docs: DataFrame, doc: str = "doc_id") -> TermTables:
    """The tables without the documents whose ids stand in docs."""
    gone = docs.select(F.col(doc).alias("doc")).where(F.col("doc").isNotNull()).distinct()
    less = text.doc_freqs(tables.counts.join(gone, "doc", "left_semi")).select("word", (-F.col("m")).alias("m"))
    return TermTables(tables.counts.join(gone, "doc", "left_anti").select("word", "doc", "n"), _summed(tables.freqs, less, ["word"], "m"), tables.rows.join(gone, "doc", "left_anti"))


def scores(tables: TermTables, folder: str | None = None) -> DataFrame:
    """tf_idf of all documents in the tables. folder: a new one, to which the counts with their totals are written, so that the shuffle of the totals is gone before that of the words is made."""
    n_docs = tables.rows.agg(F.sum("rows")).scalar()
    totals = text.with_doc_total(tables.counts)
    full = (_kept(totals, f"{folder}/totals") if folder else totals).join(tables.freqs, "word")
    return full.select("word", "doc", "n", "doc_total", "m", text.tf_idf_score(n_docs).alias("score"))
