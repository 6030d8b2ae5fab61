"""Nearest neighbours against a plain sum over all pairs, and the embedders."""

import math
import random

import numpy as np
import pytest

from loreloom.operators import vectors as V


def plain_knn(queries, index, scopes, k):
    out = {}
    for q, x in queries:
        found = []
        for item, collection, kind, y in index:
            if x and y and (q, collection) in scopes and len(x) == len(y):
                sums = [0.0, 0.0, 0.0]
                for a, b in zip(x, y):
                    sums = [sums[0] + a * b, sums[1] + a * a, sums[2] + b * b]
                length = math.sqrt(sums[1]) * math.sqrt(sums[2])
                found.append((kind, float(np.round(1 - sums[0] / length, V.DIGITS)) if length else math.inf, item))
        for kind in {f[0] for f in found}:
            out[q, kind] = [(item, d) for _, d, item in sorted(f for f in found if f[0] == kind)[:k]]
    return out


@pytest.mark.parametrize("held", [0, V.BROADCAST_NUMBERS])
def test_knn(spark, monkeypatch, held):
    """Ties, vectors of no length, other widths, null vectors, a hot scope and queries without one, in small blocks."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    monkeypatch.setattr(V, "ITEM_BLOCK", 16)
    random.seed(3)
    some = [[random.gauss(0, 1) for _ in range(8)] for _ in range(40)] + [[0.0] * 8, [1.0] * 8]
    index = [(f"i{n}", "hot" if n % 3 else f"c{n % 5}", random.choice(["x", "y"]), random.choice([*some, None, [], [1.0, 2.0]])) for n in range(400)]
    queries = [(n, random.choice([*some, [3.0, 4.0], None])) for n in range(23)]
    scopes = [(n, c) for n in range(20) for c in random.sample(["hot", "c0", "c3", "none"], 2)]
    frames = (spark.createDataFrame(queries, "query_id int, embedding array<double>"), spark.createDataFrame(index, "item_id string, collection_id string, kind string, embedding array<double>").repartition(5))
    got = V.knn(*frames, spark.createDataFrame([*scopes, scopes[0]], "query_id int, collection_id string"), 7, ("kind",), held).collect()
    want = plain_knn(queries, index, set(scopes), 7)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault((r.query_id, r.kind), []).append((r.item_id, r.distance))
    assert found == want and sum(map(len, want.values())) == len(got) > 150


def test_embedders(spark):
    texts = ["the red stone", "the blue stone", "", None, "THE red, stone!", "the"]
    df = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    plain = {r.id: r.v for r in df.select("id", V.hash_embedder(32)(df["text"]).alias("v")).collect()}
    assert plain[0] == plain[4] and plain[2] is plain[3] is None and abs(sum(x * x for x in plain[1]) - 1) < 1e-12
    weights = V.word_weights(df)
    words = V._Words(512)
    own = {w: weights[words.of(w)[2]] for w in ("the", "red", "blue")}
    assert own == {"the": pytest.approx(math.log(7 / 5) + 1), "red": pytest.approx(math.log(7 / 3) + 1), "blue": pytest.approx(math.log(7 / 2) + 1)}
    signed = {r.id: np.array(r.v) for r in df.filter("text <> ''").select("id", V.hash_embedder(512, weights)(df["text"]).alias("v")).collect()}
    assert signed[0] @ signed[4] == pytest.approx(1) and signed[0] @ signed[1] < signed[0] @ signed[0] - 0.2
    sizes = []

    def model(batch):
        assert all(batch) and len(batch) <= 2
        sizes.append(len(batch))
        return np.array([[len(t), 1.0] for t in batch])

    by_model = {r.id: r.v for r in df.coalesce(1).select("id", V.batch_embedder(model, 2)(df["text"]).alias("v")).collect()}
    assert by_model == {0: [13.0, 1.0], 1: [14.0, 1.0], 2: None, 3: None, 4: [15.0, 1.0], 5: [3.0, 1.0]}
