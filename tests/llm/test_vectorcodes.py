import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import vectorcodes as v


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows of (id, vector, label), all of one length, by plain loops."""
    kept = [(i, [math.floor(scale * x) for x in vec], label) for i, vec, label in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    d = len(kept[0][1])
    edges = np.cumsum([0] + [d // parts + (j < d % parts) for j in range(parts)]).tolist()
    cut = lambda vec: [vec[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    starts = {}
    for i, vec, _ in kept:
        if i is not None:
            starts[i] = min(vec, starts.get(i, vec))
    starts = [starts[i] for i in sorted(starts)[:entries]]
    books = [[cut(s)[j] for s in starts] for j in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, book: min((distance(p, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        moved = []
        for j, book in enumerate(books):
            owned = [[] for _ in book]
            for _, vec, _ in kept:
                owned[nearest(cut(vec)[j], book)[1]].append(cut(vec)[j])
            moved.append([[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(owned, book, strict=True)])
        books = moved
    out, sums = [], {}
    for i, vec, label in kept:
        best = [nearest(p, book) for p, book in zip(cut(vec), books, strict=True)]
        error = sum(e for e, _ in best)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def vectors(spark):
    def make(rows, element="float"):
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], f"vec_id long, embedding array<{element}>, label int, code string, error string")
        return df.withColumn("id", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)

    return make


def table(d=24, n=150, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    return [(int(i), (centres[i % 5] + rng.normal(scale=0.3, size=d)).astype(np.float32).tolist(), rng.choice([None, 1, 2])) for i in rng.permutation(n)]


def test_whole_table_by_brute_force(vectors):
    rows = [(i, x, None if label is None else int(label)) for i, x, label in table()]
    rows += [(500, None, 1), (501, [None] * 24, 1), (502, [0.0] * 23 + [math.nan], 2), (503, [math.inf] + [0.0] * 23, 2), (504, [0.0] * 23 + [None], None)]
    rows += [(-1, None, 1), (600, rows[0][1], 1), (600, rows[0][1], 1), (3, rows[1][1], 2), (None, rows[2][1], None)] + [(700 + i, rows[5][1], 7) for i in range(90)]
    want = brute([r for r in rows if r[1] is not None])
    assert found(v.compress(vectors(rows))) == want
    assert found(v.compress(vectors(rows, "double"))) == want


def test_parts_of_unequal_length_and_few_rows(vectors):
    rows = [(i, x[:11], 1) for i, x, _ in table(11, 9)]
    assert found(v.compress(vectors(rows))) == brute(rows)
    short = [(i, x[:3], 1) for i, x, _ in table(3, 20)]  # more parts than components
    assert found(v.compress(vectors(short))) == brute(short)


def test_odd_lengths_are_left_out_and_ties_go_to_the_lower_entry(vectors):
    rows = [(i, [float(i % 4)] * 16, i % 2) for i in range(40)]
    out = found(v.compress(vectors([*rows, (900, [1.0] * 8, 1), (901, [], 1)])))
    assert out == brute(rows)
    assert {r[1] for r in out} <= {f"{k:02x}" * 8 for k in range(4)}


def test_no_usable_row(vectors):
    assert v.compress(vectors([])).count() == 0
    assert v.compress(vectors([(1, None, 1), (2, [math.nan] * 8, 1)])).count() == 0
    unnamed = v.compress(vectors([(None, [1.0] * 8, 1)])).collect()
    assert [(r.code, r.error, r.label_error) for r in unnamed] == [("", None, None)]


def test_huge_components_saturate(vectors):
    out = v.compress(vectors([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)])).collect()
    assert [r.error for r in out] == [0, 0, 0]


@pytest.mark.parametrize("bits", [0, 3, 8, 20])
def test_memo_is_exact_whatever_the_cell(bits):
    rng = np.random.default_rng(bits)
    entries = rng.integers(-500, 500, (16, 5))
    entries[7] = entries[2]  # a tie
    points = np.concatenate([rng.integers(-900, 900, (3000, 5)), entries, (entries[:8] + entries[8:]) // 2])
    exact = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    for most in (v.MEMO_CELLS, 10):
        memo = v.CellMemo(entries, bits, most)
        for part in np.array_split(points, 7):
            owner, best = memo.nearest(part)
            want = ((part[:, None] - entries[None]) ** 2).sum(axis=2)
            assert (owner == want.argmin(axis=1)).all() and (best == want.min(axis=1)).all()
    alive = v.CellMemo(entries, bits).look_up(points)
    assert alive[np.arange(len(points)), exact.argmin(axis=1)].all() and (bits > 8 or alive.mean() < 0.9)


def test_a_cell_that_is_met_again_is_not_evaluated_again():
    memo = v.CellMemo(np.array([[0, 0], [100, 100]]), 4)
    points = np.array([[random.Random(i).randint(0, 63), 5] for i in range(200)])
    memo.nearest(points)
    boxes = memo.boxes
    memo.nearest(points[::-1])
    assert memo.boxes == boxes == 4
