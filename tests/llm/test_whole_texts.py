"""Very long texts and extra columns under the names of results, for each operator on documents as its query uses it."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm import fingerprints, line_dedup, pieces, pii, registry, repetition, telephony, toxicity

CLASHING = ["spans", "score", "text_", "fingerprint", "n_bytes", "n_tokens", "bitmap", "version", "doc", "own", "kept", "at", "n", "path", "media", "ids"]


@pytest.fixture(scope="module")
def docs(spark):
    """Two long texts among short ones, with sixteen extra columns."""
    rng = random.Random(21)
    words = [f"w{k}é" for k in range(4000)]
    long = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(6000))
    rows = [(1, "short a@b.org"), (2, long + "\nmail me@there.org"), (3, None), (4, "x" * 500_000), (5, ""), (5, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING)).repartition(3).cache()


def test_long_texts_of_each_operator(spark, docs):
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    key = lambda rows: sorted(rows, key=repr)
    got = telephony.media_digests(docs).collect()
    assert key((r["doc_id"], r["n_bytes"]) for r in got) == key((d, len(t.encode())) for d, t in texts)
    assert all(r["payload_sha256"] in {hashlib.sha256((e := t.encode()) + bytes(max(64, -(-len(e) // 64) * 64) - len(e))).hexdigest() for _, t in texts} for r in got)
    got = line_dedup.dedup_lines(docs).collect()
    assert key((r["doc_id"], r["text"]) for r in got) == key(texts)
    got = pieces.digests(docs, registry.tokenizer_model()).collect()
    own = {hashlib.sha256(t.encode()).hexdigest() for _, t in texts}
    assert len(got) == 6 and sum(r["decoded_sha256"] in own for r in got) >= 5
    got = fingerprints.fingerprint_pairs(docs).collect()
    assert key((r["doc_id"], r["n_chars"]) for r in got) == key((d, len(t)) for d, t in texts)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    assert key(r["doc_id"] for r in toxicity.fit_and_score(docs, labels).collect()) == key(d for d, _ in texts)
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect() if r["doc_id"] < 5}
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [1, 1, 0, 0]
    end = len(dict(texts)[2])
    assert (got[2][0]["start"], got[2][0]["end"]) == (end - len("me@there.org"), end)
    got = repetition.judge(docs).collect()
    assert key((r["doc_id"], r["n_words"]) for r in got) == key((d, len(t.split())) for d, t in texts)


def test_blanks_at_the_head_of_a_normalised_text():
    """Leading blanks are dropped one by one, without copying the rest each time."""
    from tidemill.llm.pieces import Pieces

    model = Pieces(registry.tokenizer_model())
    ids, counts, *_ = model.encode([" " * 200_000 + "a"])
    assert counts.tolist() == [len(ids)]
