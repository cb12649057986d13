"""Python-side helpers against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularlab.operators import web as W
from tabularlab.operators.models import knn_classify

PAGE = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/a">a</a>'
        '<a href="http://x">x</a><a href="/a">a</a></nav><div class="ad">buy</div><article><h1>Head</h1>'
        '<p>One &amp; two.</p><script>skip()</script><p>Three</p></article><footer>f</footer></body></html>')


def test_main_text_and_links(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    assert W.main_text(df).first()["text"] == "Head One & two. Three"
    assert [r.href for r in W.nav_links(df).collect()] == ["/a"]
    fields = {r.field: r.value for r in W.page_fields(df).collect()}
    assert fields["n_paragraphs"] == "2" and fields["last_paragraph"] == "Three"


def test_knn_matches_brute_force_with_duplicates(spark):
    rng = np.random.default_rng(0)
    clustered = rng.normal(size=(60, 8)) + np.repeat(np.eye(8)[:3] * 6, 20, axis=0)
    dup = np.repeat(clustered[:1], 25, axis=0)                # a hot group of identical vectors
    X = np.vstack([clustered, dup, rng.normal(size=(40, 8))])
    y = rng.integers(0, 3, size=len(X))
    rows = [(i, [float(v) for v in X[i]], int(y[i])) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = {r["id"]: r["pred"] for r in knn_classify(df, "id", "v", "label", 5, block_rows=16).collect()}
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    for i in range(len(X)):
        nn = sorted(range(len(X)), key=lambda j: (D[i, j], j))[:5]
        counts = np.bincount(y[nn], minlength=3)
        assert got[i] == int(np.argmax(counts)), i


def test_knn_prunes_clusters_in_many_dimensions(spark):
    """Clusters apart in every direction: one projection would not part them, their cells do."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 16)) * 4
    x = np.repeat(middle, 60, axis=0) + rng.normal(size=(720, 16)) * 0.2
    x[:90] = x[0]                                    # a value that an eighth of the rows share
    y = rng.integers(0, 3, size=len(x))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(len(x))], "id long, v array<double>, label int")
    shares = []
    got = {r.id: r.pred for r in knn_classify(df, "id", "v", "label", 5, compared=shares).collect()}
    assert shares[0] < 0.5
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(len(x)):
        nn = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:5]
        assert got[i] == int(np.argmax(np.bincount(y[nn], minlength=3))), i


def test_knn_with_fewer_rows_than_neighbours_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 2), (2, [0.0, 2.0], 1)], "id long, v array<double>, label int")
    assert {r.id: r.pred for r in knn_classify(df, "id", "v", "label", 5).collect()} == {1: 1, 2: 1}
    assert knn_classify(df.where("id > 5"), "id", "v", "label", 5).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_knn_over_many_groups_of_blocks(spark, monkeypatch, kind):
    """Blocks travel in groups: isotropic vectors, where all meet, equal vectors, and cells of several groups."""
    from tabularlab.operators import models as MD
    monkeypatch.setattr(MD, "QUERY_BYTES", 1 << 11)
    monkeypatch.setattr(MD, "CANDIDATE_BYTES", 1 << 12)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[:150] = x[0]
    y = rng.integers(0, 4, size=len(x))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(len(x))], f"id long, v array<{kind}>, label int")
    seen, real = [], MD.materialize

    def counted(df, name="stage"):
        seen.append((name, df))
        return real(df, name)

    monkeypatch.setattr(MD, "materialize", counted)
    got = {r.id: r.pred for r in knn_classify(df, "id", "v", "label", 5, block_rows=16).collect()}
    x = x.astype(float)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(len(x)):
        nn = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:5]
        assert got[i] == int(np.argmax(np.bincount(y[nn], minlength=4))), i
    assert [n for n, _ in seen] == ["knn-rows", "knn-blocks", "knn-asked", "knn-found"]
    groups = real(seen[1][1], "again").agg(F.count_distinct("_group").alias("g"), F.count_distinct("_ask").alias("a"), F.count("*").alias("b")).first()
    assert 3 < groups.g < groups.a < groups.b


def test_nearest_in_growing_chunks():
    from tabularlab.operators.models import _nearest
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(30_000, 6)), rng.normal(size=(40, 6))
    pid = rng.permutation(len(x))
    x[500:900] = x[20_000]                                   # ties across chunks
    q[0] = x[20_000]
    for scale in (1.0, 1e18):                                # the second is beyond single precision
        kth = np.full(40, np.inf)
        kth[5] = 0.0
        a, b = q * scale, x * scale
        row, col, d2 = _nearest(a, kth, b, (b * b).sum(1), pid, 4)
        for i in range(40):
            d = ((b - a[i]) ** 2).sum(1)
            want = [] if i == 5 else sorted(range(len(b)), key=lambda j: (d[j], pid[j]))[:4]
            assert i == 5 or pid[col[row == i]].tolist() == pid[want].tolist()
