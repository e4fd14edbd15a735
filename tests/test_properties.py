"""Properties over generated inputs."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemill.operators import matrix, text, topk

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet="aB é\n\t,", max_size=20), min_size=1, max_size=6)


def slow_tokens(s):
    return s.replace("\t", " ").replace("\n", " ").split()


@QUICK
@given(TEXTS)
def test_counts_and_postings_cover_the_tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    all_tokens = [t for s in texts for t in slow_tokens(s)]
    assert {r["word"]: r["cnt"] for r in text.word_count(df).collect()} == Counter(t.lower() for t in all_tokens)
    assert text.postings(df).count() == len(all_tokens)
    totals = text.with_doc_total(text.term_counts(df)).groupBy("doc").agg({"n": "sum", "doc_total": "max"}).collect()
    assert all(r["sum(n)"] == r["max(doc_total)"] for r in totals)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(-9, 9)), max_size=12))
def test_identity_and_order(spark, rows):
    df = spark.createDataFrame(rows, "i int, j int, v int")
    one = spark.createDataFrame([(k, k, 1) for k in range(4)], "i int, j int, v int")
    want = Counter()
    for i, j, v in rows:
        want[i, j] += v
    assert {(r["i"], r["j"]): r["v"] for r in matrix.matrix_multiply(df, one).collect()} == dict(want)
    ranked = topk.top_k(df.repartition(3), 4, by="v", tie="i").collect()
    assert [(r["v"], r["i"]) for r in ranked] == sorted(((v, i) for i, _, v in rows), key=lambda x: (-x[0], x[1]))[:4]
