import random
import zlib

import numpy as np

from storelens.llm.quality_ri import _temperature, fit, quality_scores


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(rows[x.doc_id].score, x.quality) for x in labels.collect() if x.doc_id in rows and rows[x.doc_id].held_out]
    score, y = map(np.array, zip(*held, strict=True))
    assert auc(score, y) > 0.9


def test_held_out_labels_are_not_used(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    one, two = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (None, 0), (99, None), (7, 1), (12, 0)], "doc_id bigint, quality int")
    assert quality_scores(odd, labels).count() == odd.count()
    assert quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_temperature_recovers_a_scale():
    r = np.random.default_rng(1)
    logit = r.normal(0, 2, 20_000)
    y = (r.random(20_000) < 1 / (1 + np.exp(-logit))).astype(int)
    assert 2.7 < _temperature(3 * logit, y) < 3.3


def test_fit_is_repeatable():
    r = random.Random(1)
    some = [" ".join(r.choice(["ab", "cd", "ef!!", "GH"]) for _ in range(30)) for _ in range(40)]
    y = np.array([int("!!" not in t[:20]) for t in some])
    assert (fit(some, y).layers[0] == fit(some, y).layers[0]).all()
