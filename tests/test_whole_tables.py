"""Queries over whole tables, against brute force that reads the tables without any filter."""

import numpy as np
from oracle import duck

from tidemill.plans.reference_queries import QUERIES

SF = "/root/testdata/sf0.001"


def grid(spark, name, shape):
    rows = QUERIES[name][0](spark, SF).toPandas()
    assert len(rows) == shape[0] * shape[1]
    out = np.zeros(shape, np.int64)
    out[rows["i"], rows["j"]] = rows["v"]
    return out


def test_matrices_of_all_vectors(spark):
    vectors = duck(SF).execute("select embedding from embeddings order by vec_id").fetchall()
    a = np.array([v for (v,) in vectors], np.float64) * 100
    a = (np.sign(a) * np.floor(np.abs(a) + 0.5)).astype(np.int64)
    i, j = np.indices(a.shape)
    assert (grid(spark, "matrix_add", a.shape) == a + np.where((i + j) % 2 == 0, a, 0)).all()
    assert (grid(spark, "matrix_multiply", (a.shape[1],) * 2) == a.T @ a).all()


def test_kmeans_reaches_the_fixpoint(spark):
    points = np.array(duck(SF).execute("select l_quantity / 5, l_discount * 100 from lineitem").fetchall(), np.float64)
    centres = np.array([(0.0, 0.0), (7.0, 7.0)])
    while True:
        nearest = np.argmin(np.linalg.norm(points[:, None] - centres, axis=2), axis=1)
        means = np.array([points[nearest == k].mean(axis=0) for k in (0, 1)])
        if (means.astype(np.float32) == centres).all():
            break
        centres = means.astype(np.float32).astype(np.float64)
    rows = sorted(tuple(r) for r in QUERIES["kmeans"][0](spark, SF).collect())
    assert [(k, n) for k, _, _, n in rows] == [(k, int((nearest == k).sum())) for k in (0, 1)]
    np.testing.assert_allclose([r[1:3] for r in rows], means, atol=2e-6)


def test_page_rank_over_all_parts(spark):
    lines = duck(SF).execute("select l_orderkey, l_partkey from lineitem order by l_orderkey, l_linenumber, l_partkey").fetchall()
    pages = [p for (p,) in duck(SF).execute("select p_partkey from part order by 1").fetchall()]
    at = {p: k for k, p in enumerate(pages)}
    links = np.zeros((len(pages),) * 2)
    for (o, a), (p, b) in zip(lines, lines[1:]):
        if o == p:
            links[at[a], at[b]] = 1
    shares, reached, n = links / links.sum(axis=1, keepdims=True).clip(1), links.any(axis=0), len(pages)
    kept = plain = np.full(n, 1 / n)
    for _ in range(3):
        kept = np.where(reached, 0.15 / n + 0.85 * kept @ shares, kept)
        plain = 0.15 / n + 0.85 * plain @ shares
    for name, want in (("page_rank", {pages[k]: kept[k] for k in np.flatnonzero(reached)}), ("page_rank_textbook", dict(zip(pages, plain)))):
        got = {r["page"]: r["rank"] for r in QUERIES[name][0](spark, SF).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)
