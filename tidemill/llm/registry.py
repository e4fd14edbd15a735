"""Queries of this subpackage over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import ball_tree, fingerprints, jaccard_join, line_dedup, lm_scoring, packing, pieces, pii, repetition, telephony, toxicity, url_filter, whitening

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


_OP2_SQL = f"""with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[]
    else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) end as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared
  from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs where 100 * shared >= 75 * (na + nb - shared)
  union all select b, a from pairs where 100 * shared >= 75 * (na + nb - shared)),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, cast(len(s) as bigint) as n_shingles, (select min(b) from reach where a = doc_id) as component_id from sets"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_digests(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_OP6_SQL = f"""with lines as (
  select doc_id, generate_subscripts(ls, 1) as pos, unnest(ls) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
keyed as (select *, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') as key from lines),
owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1)
select doc_id, count(*) as n_lines, count(*) filter (where owner is not null and owner <> doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where owner is null or owner = doc_id), '')) as kept_sha256
from keyed left join owners using (key) group by doc_id"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_model())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.size(pii.of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(pii.joined(pii.of_kinds(F.col("spans"), pii.BASE_KINDS)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op12_sql(k: int = ball_tree.CLUSTERS, rounds: int = ball_tree.ROUNDS) -> str:
    nearest = lambda z: f"select vec_id, min(far * {k} + c) as best from (select vec_id, c, sum((v.x - z.x) * (v.x - z.x)) as far from v join {z} z using (d) group by vec_id, c) group by vec_id"
    ctes = [
        "kept as (select vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)",
        "v as materialized (select vec_id, generate_subscripts(embedding, 1) as d, cast(floor(1024 * cast(unnest(embedding) as double)) as bigint) as x from kept)",
        f"first_ as (select vec_id, row_number() over (order by sha256('3:' || vec_id), embedding) - 1 as c from kept qualify c < {k})",
        "z0 as materialized (select c, d, x from v join first_ using (vec_id))",
    ]
    for r in range(1, rounds + 1):
        ctes.append(f"a{r} as materialized ({nearest(f'z{r - 1}')})")
        ctes.append(f"s{r} as (select best % {k} as c, d, sum(x) as s, count(*) as n from v join a{r} using (vec_id) group by 1, 2)")
        ctes.append(f"z{r} as materialized (select c, d, cast(coalesce((s - (s % n + n) % n) // n, x) as bigint) as x from z{r - 1} left join s{r} using (c, d))")
    ctes.append(f"last as materialized (select vec_id, best % {k} as c, best // {k} as far from ({nearest(f'z{rounds}')}))")
    return f"""with {', '.join(ctes)}
select vec_id, cast(c as int) as cluster, cast(far as bigint) as distance, cast(sum(far) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(far) over () as bigint) as inertia, centroid_sha256
from last join (select c, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from z{rounds} group by c) using (c)"""


def op13_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


#: name: (query, SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_ngram_jaccard": (op2_ngram_jaccard, _OP2_SQL),
    "op3_lm_scoring": (op3_lm_scoring, None),
    "op4_url_filter": (op4_url_filter, None),
    "op5_telephony_audio": (op5_telephony_audio, None),
    "op6_line_dedup": (op6_line_dedup, _OP6_SQL),
    "op7_sentencepiece": (op7_sentencepiece, None),
    "op8_fingerprints": (op8_fingerprints, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_pii": (op10_pii, None),
    "op11_embedding_whitening": (op11_embedding_whitening, None),
    "op12_ball_tree_clusters": (op12_ball_tree_clusters, _op12_sql()),
    "op13_repetition_rules": (op13_repetition_rules, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
