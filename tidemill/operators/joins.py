"""One relation, three physical strategies: fact rows with the name of their category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.spread import estimated_bytes

#: Largest dimension in bytes (as Spark estimates it) that `broadcast` may send to every executor.
BROADCAST_LIMIT = 64 << 20


def last_of(dim: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key that is not null: that of the largest `order` (the last line wins), among equal ones or without an order that of the largest values of the other columns."""
    others = [c for c in dim.columns if c != key]
    ranked = F.struct(*([order] if order else []), *others) if others else F.lit(0)
    last = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(ranked).alias("__last"))
    return last.select(key, *(F.col("__last")[c].alias(c) for c in others if c != order))


def left_join(fact: DataFrame, dim: DataFrame, key: str, strategy: str = "broadcast", limit: int = BROADCAST_LIMIT, order: str | None = None) -> DataFrame:
    """fact LEFT JOIN dim on key, each fact row once: of a key that the dimension repeats the last row counts (see last_of).

    order: a column of dim by which its rows follow one another; it is not in the result. A null key joins nothing.
    Other columns of both sides must have different names. strategy: `broadcast` (no shuffle of the fact side; used
    only if the dimension's estimated size is within limit, else it becomes `merge`), `merge` (sort-merge join: both
    sides shuffled and sorted on the key) or `hash` (shuffled hash join). AQE splits skewed keys of the shuffled forms.
    """
    if strategy not in ("broadcast", "merge", "hash"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if clash := (set(fact.columns) & set(dim.columns)) - {key, order}:
        raise ValueError(f"columns of both sides: {sorted(clash)}; rename them first")
    one = last_of(dim, key, order)
    if strategy == "broadcast" and estimated_bytes(dim) <= limit:
        return fact.join(F.broadcast(one), key, "left")
    return fact.join(one.hint("shuffle_hash" if strategy == "hash" else "merge"), key, "left")


#: Fact rows of a key that one task gets before the key is split, and most keys that are split.
PART_ROWS, MOST_SPLIT = 1_000_000, 10_000


def split_keys(facts: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame | None:
    """(__key, __parts): the keys of more fact rows than a task should get, null among them, and into how many parts they are split; None without any.

    Measured by a count of the key column. A key counts as hot above part_rows and above 1 / MOST_SPLIT of all
    rows, so the table has at most MOST_SPLIT rows, whatever the input.
    """
    limit = max(part_rows, facts.count() // MOST_SPLIT)
    counts = facts.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot = counts.select("__key", F.ceil(F.col("n") / limit).cast("int").alias("__parts")).collect()
    return facts.sparkSession.createDataFrame(hot, f"__key {facts.schema[key].dataType.simpleString()}, __parts int") if hot else None


def carried_join(rows: DataFrame, key: str, is_fact: Column, order: str, names: tuple[str, ...], part_rows: int = PART_ROWS) -> DataFrame:
    """The fact rows of a union of facts and dimension rows, with the columns `names` of the last dimension row (by order, then by names) of their key; null without one.

    Both sides cross one exchange, dealt by key and part, and are sorted by (key, part, dimension first, order); a
    window carries the last dimension row forward over the facts, which stream behind it. Facts of a hot key (see split_keys) are dealt
    over its parts, and its dimension rows are repeated to each. A null key joins nothing.
    """
    kept = rows.withColumn("__fact", is_fact).where(F.col("__fact") | F.col(key).isNotNull())
    hot = split_keys(kept.where("__fact").select(key), key, part_rows)
    parts = F.lit(1)
    if hot is not None:
        kept = kept.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
        parts = F.coalesce("__parts", F.lit(1))
    kept = kept.withColumn("__row", F.monotonically_increasing_id())
    dealt = kept.withColumn("__part", F.explode(F.when(F.col("__fact"), F.array(F.pmod("__row", parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))))
    before = Window.partitionBy(key, "__part").orderBy("__fact", order, *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(~F.col("__fact"), F.struct(*names)), ignorenulls=True).over(before)
    found = dealt.withColumn("__last", F.when(F.col(key).isNotNull(), last)).where("__fact")
    return found.select(*(F.col("__last")[c].alias(c) if c in names else F.col(c) for c in rows.columns))


def tagged_join(fact: DataFrame, dim: DataFrame, key: str, order: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """left_join's rows by carried_join: one exchange for both sides, no aggregate of the dimension, and hot keys in several tasks. order: a column of dim, not in the result."""
    if clash := (set(fact.columns) & set(dim.columns)) - {key}:
        raise ValueError(f"columns of both sides: {sorted(clash)}; rename them first")
    names = tuple(c for c in dim.columns if c not in (key, order))
    ordered = dim if order else dim.withColumn("__order", F.lit(0))
    both = fact.withColumn("__tag", F.lit(True)).unionByName(ordered.withColumn("__tag", F.lit(False)), allowMissingColumns=True)
    return carried_join(both, key, F.col("__tag"), order or "__order", names, part_rows).select(*fact.columns, *names)


def rendered(price: Column, name: Column, separator: str, missing: str) -> Column:
    """`price<separator>name`, with `missing` where the name is null."""
    return F.concat(price.cast("string"), F.lit(separator), F.coalesce(name, F.lit(missing)))
