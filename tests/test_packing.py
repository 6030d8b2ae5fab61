"""Packing against a plain loop, in scopes of all shapes and over many segments."""

from collections import Counter
import random

import numpy as np
import pytest

from loreloom.operators import packing as P


def plain(sizes, budget, gap):
    """The batch of each row of one scope."""
    out, batch, used = [], 0, None
    for size in sizes:
        if used and used + gap + size > budget:
            batch, used = batch + 1, None
        used = used + gap + size if used else size
        out.append(batch)
    return out


def test_segments():
    """All ways to cut a scope into segments give the batches of the plain loop."""
    random.seed(17)
    for _ in range(3000):
        sizes = [random.choice([0, 0, 1, 2, 3, 5, 9, 10, 11, 14]) for _ in range(random.randint(1, 16))]
        budget, gap = random.randint(1, 16), random.choice([0, 2])
        cuts = sorted({0, len(sizes), *random.choices(range(len(sizes) + 1), k=3)})
        used, done, got = P.EMPTY, 0, []
        for a, b in zip(cuts, cuts[1:]):
            own = P.Segment(np.array(sizes[a:b]), budget, gap)
            begins = own.begins(used)
            got += [done + int(x) for x in np.searchsorted(begins, np.arange(b - a), "right")]
            least, counts, ends, total, empty_count, empty_end = own.summary()
            if used == P.EMPTY:
                done, used = done + empty_count, empty_end
            else:
                at = next((i for i, x in enumerate(least) if used >= x), None)
                done, used = (done, used + total) if at is None else (done + counts[at], ends[at])
        assert got == plain(sizes, budget, gap), (sizes, budget, gap, cuts)


@pytest.mark.parametrize("segment", [3, P.SEGMENT])
def test_batches(spark, monkeypatch, segment):
    """Rows of one place, repeated rows, null scopes, places and texts; one scope has most of the rows."""
    monkeypatch.setattr(P, "SEGMENT", segment)
    random.seed(4)
    rows = []
    for n in range(900):
        scope = random.choice(["hot"] * 8 + ["a", "b", None])
        rows.append((scope, random.choice([n, n, n // 5, None]), random.choice(["", None, "é" * random.randint(1, 30), "x" * random.randint(1, 90), "same"]), n % 2))
    rows += [("three", 1, "y" * 9000, 0), ("three", 1, "z" * 9000, 0), ("three", 2, "w", 0)]
    df = spark.createDataFrame(rows, "scope string, place int, text string, _x int").repartition(7)
    for budget in (100, 16_000):
        got = [*map(tuple, P.batch_passages(df, "scope", "place", "text", budget).collect())]
        assert Counter(r[:4] for r in got) == Counter(rows)
        hashes = {(r.scope, r.text): r.h for r in df.selectExpr("scope", "text", "xxhash64(text) AS h").collect()}
        for scope in {r[0] for r in rows}:
            own = sorted((r for r in got if r[0] == scope), key=lambda r: (r[1] is not None, r[1] or 0, hashes[scope, r[2]], r[4]))
            assert [r[4] for r in own] == plain([len((r[2] or "").encode()) for r in own], budget, 2)
