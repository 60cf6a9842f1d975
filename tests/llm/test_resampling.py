import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import resampling as r

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % r.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=r.PERCENT):
    s, t = [0] * r.BUCKETS, [0] * r.BUCKETS
    for table, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for b in features(text):
                table[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + r.BUCKETS) / ((x + 1) * (sum(t) + r.BUCKETS)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features(text))
        out.append([i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((o for o in out if o[5] >= r.LEAST_WORDS), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    for rank, o in enumerate(able[: percent * len(able) // 100], 1):
        o[4] = rank
    return sorted((tuple(o[:5]) for o in out), key=str)


def found(df):
    return sorted((tuple(x) for x in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def corpus():
    rng = random.Random(9)
    pool = ["the", "Of", "über", "ÀB", "x1", "7", "don't", "a-b", "😀", "q" * 64, "r" * 65, "s" * 200, "w\x7fv"] + [f"w{i}" for i in range(200)]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 60, 200])))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " .. "), (None, "w1 " * 30), (None, None), (303, "w1 w2 " * 30_000), (304, "w" * 300_000)]
    rows += [(7, rows[7][1])] * 5 + [(305, "w3 w4 w5 " * 10)] * 90
    return rows


def test_checksums_of_all_runs():
    texts = [t or "" for _, t in corpus()[:100]] + ["", "x" * 64 + " y", "x" * 65 + " " + "y" * 66 + " z"]
    runs = r.Runs([t.encode() for t in texts])
    got = [[] for _ in texts]
    for owner, crc in runs.runs():
        for i, v in zip(owner, crc, strict=True):
            got[i].append(int(v) % r.BUCKETS)
    assert got == [features(t) for t in texts] and runs.n_words.tolist() == [len(words(t)) for t in texts]


def test_whole_tables_by_brute_force(documents, spark):
    rows, target = corpus(), [(i, t) for i, t in corpus() if i is not None and i % 9 == 0] + [(None, None)]
    benchmark = spark.createDataFrame(target, "item_id long, text string")
    assert found(r.resample(documents(rows), benchmark)) == brute(rows, target)
    assert found(r.resample(documents(rows), benchmark, percent=40)) == brute(rows, target, 40)


@pytest.mark.parametrize("last", [1, 7])
def test_cutoff_by_rounds(spark, monkeypatch, last):
    monkeypatch.setattr(r, "LAST", last)
    rng = random.Random(last)
    rows = [(rng.randint(-20, 20), rng.choice([None, 1, 2, 3]), 5, i) for i in range(900)] + [(3, 1, 5, 10_000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long, row long").repartition(9).withColumn("key", r.draw_key()).cache()
    keys = sorted((-s, int(i is None), i or 0, n, at) for s, i, n, at in rows)
    for nth in (1, 2, 650, 1399, 1400):
        assert r.cutoff(df.select("key"), nth) == keys[nth - 1]
    df.unpersist()


def test_the_weighted_median_leaves_a_quarter_on_each_side():
    rng = random.Random(3)
    for _ in range(50):
        parts = [sorted(rng.random() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 12))]
        pivot = r.weighted_median([((p[(len(p) - 1) // 2],), len(p)) for p in parts])[0]
        everything = [x for p in parts for x in p]
        assert sum(x <= pivot for x in everything) >= len(everything) / 4 and sum(x >= pivot for x in everything) >= len(everything) / 4


def test_numbering(spark):
    rows = [(x,) for x in range(500)]
    df = spark.createDataFrame(rows, "x long").repartition(7).select(F.struct((-F.col("x")).alias("k")).alias("key"), "x")
    assert sorted((n.rank, n.x) for n in r.numbered(df).collect()) == [(i + 1, 499 - i) for i in range(500)]


def test_small_and_empty_tables(documents, spark):
    benchmark = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert r.resample(documents([]), benchmark).count() == 0
    few = [(1, "w1 " * 25), (2, "w2"), (None, None)]
    assert found(r.resample(documents(few), benchmark)) == brute(few, [(1, "w1 w2")])
    assert found(r.resample(documents(few), nothing)) == brute(few, [])


def test_columns_that_arrow_splits():
    runs = list(r.text_runs(pa.array(["a b", None, "c"])))
    assert [x.n_words.tolist() for x in runs] == [[2, 0, 1]] and isinstance(runs[0].text, np.ndarray)
