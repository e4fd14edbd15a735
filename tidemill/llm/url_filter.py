"""URL filter: host and path rules first, else a ratio of two character language models.

URLs that a rule decides are the models' examples: a smoothed variable-order Markov model (orders 0 to 3,
each order's estimate interpolated with the next lower one by the number of different characters seen in
the context) for the accepted and one for the rejected. A URL without a rule is accepted when the
difference of its log-likelihoods, divided by its length, reaches a threshold. The threshold is calibrated by
cross-fitting: each example is scored by models that did not see its fold (one of FOLDS, by a hash of the URL),
and the threshold lies between the two classes' means, at equal distances in standard deviations. A class's
deviation is pooled with that of all examples about their class's mean, which counts as POOLED examples, and is at
least LEAST_DEVIATION, so a class with one example has a deviation as well.

Only DataFrame expressions are used. Characters are folded to an alphabet of 39 codes, so the counts have
at most 39**4 cells a class and fold, and a model's log ratio is a table of at most 39**4 numbers whatever the
corpus. It is broadcast for scoring if its counted rows are at most BROADCAST_CELLS, else joined by shuffle.
Different URLs are scored once each, dealt by a hash over all tasks before they become cells. Examples are counted
with map-side combine, so a frequent host or a URL that is repeated without end costs one row a task.

Null URLs and URLs without `://` have an empty host and path and no rule; a null URL is scored as an empty
one. Without examples of both classes the ratio is 0 and everything without a rule is accepted. Input
columns with clashing names are ignored, but for those passed in keep. An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.session import cut, partitions


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters with codes 1, 2, ...; digits fold to 0. The next code is any other character; code 0 is the edge of the URL.
SHOWN = LOWER + "0./-:?=&#_%"
OTHER = len(SHOWN) + 1
SIZE = OTHER + 1
ORDER = 3
FOLDS = 5
#: Cells of a model that may be broadcast.
BROADCAST_CELLS = 1_000_000
#: Examples as which the pooled variance counts, and the least deviation of a class.
POOLED, LEAST_DEVIATION = 5.0, 1e-3


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def codes(url: Column) -> Column:
    """Codes of the URL's characters between three edges and one."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9./:?=&#_%-]", "~")
    plain = F.translate(plain, "123456789", "000000000")
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    code = F.transform(letters, lambda c: F.coalesce(F.nullif(F.instr(F.lit(SHOWN), c), F.lit(0)), F.lit(OTHER)))
    edge = [F.lit(0)] * ORDER
    return F.concat(F.array(*edge), code, F.array(F.lit(0)))


def cells(code: Column) -> Column:
    """The number of each run of ORDER + 1 codes. code must be a column, as it is read at every position."""
    ends = F.sequence(F.lit(ORDER + 1), F.size(code))
    number = lambda at: sum((F.element_at(code, at - k) * SIZE**k for k in range(1, ORDER + 1)), F.element_at(code, at))
    return F.transform(ends, number)


def _conditional(counts: DataFrame, needed: DataFrame) -> DataFrame:
    """(model, accepted, cell, logp) for both classes and the needed cells: the interpolated log-probability of the cell's last code after the ones before it."""
    grid = needed.select("model", "cell", F.explode(F.array(F.lit(True), F.lit(False))).alias("accepted"))
    for k in range(ORDER + 1):
        width = SIZE ** (k + 1)
        seen = counts.groupBy("model", "accepted", (F.col("cell") % width).alias(f"gram{k}")).agg(F.sum("n").alias(f"n{k}"))
        context = seen.groupBy("model", "accepted", F.floor(F.col(f"gram{k}") / SIZE).cast("int").alias(f"ctx{k}")).agg(F.sum(f"n{k}").alias(f"all{k}"), F.count("*").alias(f"kinds{k}"))
        grid = grid.withColumn(f"gram{k}", (F.col("cell") % width).cast("int")).withColumn(f"ctx{k}", F.floor(F.col(f"gram{k}") / SIZE).cast("int"))
        grid = grid.join(seen, ["model", "accepted", f"gram{k}"], "left").join(context, ["model", "accepted", f"ctx{k}"], "left")
    p = F.lit(1.0 / SIZE)
    for k in range(ORDER + 1):
        n, every, kinds = (F.coalesce(F.col(f"{c}{k}").cast("double"), F.lit(0.0)) for c in ("n", "all", "kinds"))
        grid = grid.withColumn(f"p{k}", F.when(every > 0, (n + kinds * p) / (every + kinds)).otherwise(p))
        p = F.col(f"p{k}")
    return grid.select("model", "accepted", "cell", F.ln(p).alias("logp"))


def cells_of(urls: DataFrame) -> DataFrame:
    """The rows of urls, one for each cell of their url."""
    coded = urls.withColumn("code", codes(F.col("url")))
    return coded.withColumn("cell", F.explode(cells(F.col("code")))).drop("code")


def train(examples: DataFrame, needed: DataFrame) -> DataFrame:
    """(model, cell, r double): the log ratio of accepted to rejected for the needed cells (model int, cell int, each pair once).

    examples: (url, n long: how often it occurs, accepted boolean, fold int). Model k below FOLDS leaves out fold k; model
    FOLDS has all examples.
    """
    by_fold = cells_of(examples).groupBy("accepted", "fold", "cell").agg(F.sum("n").alias("n"))
    models = F.array_except(F.sequence(F.lit(0), F.lit(FOLDS)), F.array("fold"))
    counts = cut(by_fold.select("accepted", "cell", "n", F.explode(models).alias("model")).groupBy("model", "accepted", "cell").agg(F.sum("n").alias("n")))
    logs = _conditional(counts, needed)
    return logs.groupBy("model", "cell").agg(F.sum(F.when(F.col("accepted"), F.col("logp")).otherwise(-F.col("logp"))).alias("r"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score): the mean log ratio over the cells of each url. urls: (url, model int), model: what train gives."""
    small = model.count() <= BROADCAST_CELLS
    return cells_of(urls.select("url", "model")).join(F.broadcast(model) if small else model, ["model", "cell"]).groupBy("url").agg(F.avg("r").alias("score"))


def _judged(url: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    return rule_of(*host_and_path(url), rules)


def judge(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns in keep, host, path, rule (null without one), verdict (`allow` or `block`) and score (null where a rule decides)."""
    host, path = host_and_path(F.col("__url"))
    base = pages.select(*keep, F.coalesce(F.col(url), F.lit("")).alias("__url")).withColumns({"__host": host, "__path": path})
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    ruled = base.withColumns({"__rule": rule, "__verdict": verdict})

    # Each different URL once, with how often it occurs, dealt over all tasks.
    urls = cut(base.groupBy(F.col("__url").alias("url")).agg(F.count("*").alias("n")).repartition(partitions(pages.sparkSession), "url"))
    verdicts = urls.withColumn("verdict", _judged(F.col("url"), rules)[1])
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    examples = verdicts.where("verdict is not null").select("url", "n", (F.col("verdict") == "allow").alias("accepted"), fold.alias("fold"))
    # Rules decide the examples, so only the others are scored by the model of all examples.
    free = verdicts.where("verdict is null").select("url", F.lit(FOLDS).alias("model"))
    unseen = examples.select("url", F.col("fold").alias("model"))
    model = cut(train(examples, cells_of(free.unionAll(unseen)).select("model", "cell").distinct()))
    threshold = _threshold(examples, score(unseen, model))
    scores = score(free, model).select(F.col("url").alias("__scored"), F.col("score").alias("__score"))

    joined = ruled.join(scores, F.col("__url") == F.col("__scored"), "left")
    s = F.when(F.col("__verdict").isNull(), F.coalesce(F.col("__score"), F.lit(0.0)) if threshold is not None else F.lit(0.0))
    final = F.coalesce(F.col("__verdict"), F.when(s >= (threshold or 0.0), F.lit("allow")).otherwise(F.lit("block")))
    return joined.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), final.alias("verdict"), s.alias("score"))


def _threshold(examples: DataFrame, scores: DataFrame) -> float | None:
    """Between the classes' means over the examples' scores, at equal distances in deviations; None without both classes."""
    each = examples.join(scores, "url").select("accepted", F.col("n").cast("double").alias("n"), "score")
    sums = each.groupBy("accepted").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("score")).alias("a"), F.sum(F.col("n") * F.col("score") * F.col("score")).alias("b"))
    return between({r["accepted"]: (r["w"], r["a"], r["b"]) for r in sums.collect()})


def between(sums: dict[bool, tuple[float, float, float]]) -> float | None:
    """The threshold from each class's number of examples, sum of scores and sum of their squares."""
    if len(sums) < 2:
        return None
    mean = {k: a / w for k, (w, a, _) in sums.items()}
    apart = {k: max(0.0, b - a * a / w) for k, (w, a, b) in sums.items()}
    pooled = sum(apart.values()) / sum(w for w, _, _ in sums.values())
    deviation = {k: max(LEAST_DEVIATION, ((apart[k] + POOLED * pooled) / (sums[k][0] + POOLED)) ** 0.5) for k in sums}
    return (mean[True] * deviation[False] + mean[False] * deviation[True]) / (deviation[True] + deviation[False])
