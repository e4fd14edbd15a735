"""PageRank over an edge DataFrame (src, dst, out_degree).

The edges are written once to the shared folder, dealt by src, and those of a hub in parts; an iteration joins them with the ranks that the one
before gave to pages with in-links, and sums the shares by dst with map-side combine. So a plan has one join and one
exchange of sums an iteration, and is cut by a checkpoint every CUT_EVERY iterations.

page_rank_converged runs to convergence instead: only pages whose rank has changed by more than a bound since they last
sent something send the change on, and the edges of a hub are dealt in parts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.folders import cut

#: Iterations between checkpoints of the rank state, which cut the growing plan.
CUT_EVERY = 5


def as_float(x: float) -> float:
    """x rounded to 32 bits."""
    return struct.unpack("f", struct.pack("f", x))[0]


#: Edges of a page that one task gets; a page with more has them dealt in parts.
HUB_EDGES = 200_000
#: Edges for which the dealt table has a partition, so that what a task sorts doesn't grow with the graph.
PART_EDGES = 2_000_000


def _hubs(links: DataFrame, hub_edges: int) -> DataFrame | None:
    """(src, parts) of the pages with more than hub_edges links; None without any."""
    hubs = cut(links.groupBy("src").agg(F.ceil(F.count("*") / hub_edges).cast("int").alias("parts")).where("parts > 1"))
    return None if hubs.isEmpty() else hubs


def _dealt(links: DataFrame, n: int, *by: str) -> DataFrame:
    """n links dealt by these columns and written. Adaptive execution is off meanwhile: what it writes is not known to be dealt, so each join would deal it again."""
    spark = links.sparkSession
    parts, adaptive = max(spark.sparkContext.defaultParallelism, -(-n // PART_EDGES)), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(links.repartition(parts, *by))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _in_parts(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """links with `part`, by the target for hubs."""
    return links.join(hubs, "src", "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def _iterated(
    pages: DataFrame, edges: DataFrame, first: float, other: Column, kept, n_pages: int, iterations: int, damping: float, base: float, hub_edges: int = HUB_EDGES
) -> DataFrame:
    """(dst, rank) of the pages with in-links after the last iteration. first: every page's rank at the start, other: that of a page without in-links later; kept: how a rank is carried on."""
    links = edges.join(pages.select(F.col("page").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "out_degree")
    hubs = None
    if iterations > 1:
        # Written as they come: what makes them runs once, not for the hubs and the dealing each.
        links = cut(links)
        hubs = _hubs(links, hub_edges)
        links = _dealt(links if hubs is None else _in_parts(links, hubs), links.count(), "src", *([] if hubs is None else ["part"]))
    ranks = None
    for k in range(iterations):
        if ranks is None:
            shares = links.select("dst", (F.lit(first) / F.col("out_degree")).alias("share"))
        else:
            carried = ranks.select(F.col("dst").alias("src"), kept(F.col("rank")).alias("rank"))
            if hubs is not None:
                # A hub's rank goes to each part of its edges.
                carried = carried.join(hubs, "src", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            shares = links.join(carried, ["src"] if hubs is None else ["src", "part"], "left").select("dst", (F.coalesce("rank", other) / F.col("out_degree")).alias("share"))
        ranks = shares.groupBy("dst").agg((F.lit(base) / n_pages + F.lit(damping) * F.sum("share")).alias("rank"))
        ranks = cut(ranks) if (k + 1) % CUT_EVERY == 0 and k + 1 < iterations else ranks
    return ranks


def page_rank(pages: DataFrame, edges: DataFrame, n_pages: int, iterations: int = 3, damping: float = 0.85, base: float = 0.15, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(page, rank) after a fixed number of iterations (one at least), for the pages that have in-links.

    A page without in-links keeps its initial 1/n; a page without out-links gives nothing away, and neither does an edge
    from what is not a page. The carried state is rounded to float between iterations, the result is not.
    """
    rounded = lambda c: c.cast("float").cast("double")
    first = 1.0 / n_pages
    start = rounded(F.lit(first))
    return _iterated(pages, edges, as_float(first), start, rounded, n_pages, iterations, damping, base, hub_edges).select(F.col("dst").alias("page"), "rank")


def page_rank_textbook(pages: DataFrame, edges: DataFrame, n_pages: int, iterations: int = 3, damping: float = 0.85, base: float = 0.15, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(page, rank) for all pages: a page without in-links gets base / n; doubles throughout."""
    without = F.lit(base / n_pages)
    found = _iterated(pages, edges, 1.0 / n_pages, without, lambda c: c, n_pages, iterations, damping, base, hub_edges)
    return pages.select("page").join(found, F.col("page") == F.col("dst"), "left").select("page", F.coalesce("rank", without).alias("rank"))


def page_rank_converged(
    pages: DataFrame, edges: DataFrame, n_pages: int, bound: float, damping: float = 0.85, base: float = 0.15, textbook: bool = True, max_rounds: int = 1000,
    hub_edges: int = HUB_EDGES, progress: Callable[[int, int, int], None] | None = None,
) -> DataFrame:
    """(page, rank) at the fixpoint of page_rank_textbook (of page_rank, unless textbook), up to what pages have not sent.

    Each page has its rank and a residual, what the rank has gained since it was last sent on. In a round the pages whose
    residual exceeds bound send it, damped and shared by their out-links, and start again from 0; what arrives adds to rank and residual,
    all other ranks are carried on as they are. The loop ends when no page sends, or after max_rounds. Doubles throughout; a
    rank is short of the fixpoint by bound / (1 - damping) for each page that can reach it at most. progress is called with
    the round and the pages and edges that send in it.

    pages: (page), without repetition. Edges from or to what is not a page are ignored. Edges are written once, dealt by
    source and part of it, so a hub's are in several tasks, to each of which the hub's residual is sent. A round joins the
    senders with the edges, sums by target with map-side combine, and writes the pages' state.
    """
    ids = pages.select("page")
    known = cut(edges.join(ids.select(F.col("page").alias("src")), "src", "left_semi").join(ids.select(F.col("page").alias("dst")), "dst", "left_semi"))
    spread = known.groupBy("src").agg(F.ceil(F.count("*") / hub_edges).cast("int").alias("parts"), F.count("*").alias("links"))
    # Within a hub, edges go to parts by their target.
    dealt = known.join(spread, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "dst", "out_degree")
    links = _dealt(dealt, known.count(), "src", "part")
    given = F.lit(base / n_pages)
    if not textbook:
        into = known.select(F.col("dst").alias("page")).distinct().withColumn("linked", F.lit(True))
        ids = ids.join(into, "page", "left")
        given = F.when(F.col("linked"), F.lit(base / n_pages)).otherwise(F.lit(1.0 / n_pages))
    state = ids.join(spread.withColumnRenamed("src", "page"), "page", "left").select(
        "page", given.alias("rank"), given.alias("residual"), F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("links", F.lit(0)).alias("links"), *([] if textbook else ["linked"])
    )
    sends = (F.abs("residual") > bound) & (F.col("parts") > 0)
    state = cut(state)
    for k in range(max_rounds):
        senders, messages = state.where(sends).agg(F.count("*"), F.coalesce(F.sum("links"), F.lit(0))).first()
        if not senders:
            break
        if progress:
            progress(k + 1, senders, messages)
        sent = state.where(sends).select(F.col("page").alias("src"), "residual", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        got = links.join(sent, ["src", "part"]).groupBy(F.col("dst").alias("to")).agg(F.sum(F.lit(damping) * F.col("residual") / F.col("out_degree")).alias("got"))
        new = F.coalesce("got", F.lit(0.0))
        left = F.when(sends, F.lit(0.0)).otherwise(F.col("residual"))
        state = cut(state.join(got, F.col("page") == F.col("to"), "left").select("page", (F.col("rank") + new).alias("rank"), (left + new).alias("residual"), *state.columns[3:]))
    return state.select("page", "rank") if textbook else state.where("linked").select("page", "rank")
