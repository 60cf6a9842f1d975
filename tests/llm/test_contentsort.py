import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import contentsort as c


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept, digest); of rows alike in everything one is kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), n == 0, digest) for n, m in enumerate(members)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(c, "RANGE_BYTES", 2000)
    monkeypatch.setattr(c, "ROW_BYTES", 20)


def corpus():
    rng = random.Random(5)
    common = "the same long beginning of many texts " * 5
    rows = [(i, common + " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(1000 + i, "hot text  with\tspaces" + " " * (i % 7)) for i in range(400)]
    rows += [(2000 + i, rng.choice(["", " ", "\n\n", None, "x", "X", "é", "é", " ", "😀 😀", "a b", "ab", "a\x1cb"])) for i in range(80)]
    rows += [(None, "hot text with spaces"), (None, None), (1000, "hot text  with\tspaces"), (1000, "hot text  with\tspaces"), (3000, "v " * 40_000), (3001, "v" * 40_000), (3002, "v" * 40_001)]
    rng.shuffle(rows)
    return rows


def test_whole_table_by_brute_force(documents):
    rows = corpus()
    assert found(c.grouped(documents(rows))) == brute(rows)


def test_groups_that_span_many_ranges(documents, small_ranges, monkeypatch):
    rows = corpus()
    docs = documents(rows)
    bounds = c.splitters(docs.select(F.coalesce("text", F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row")))
    assert len(bounds) > 20 and bounds == sorted(bounds)
    assert max(sum(b[0] == norm(t)[: c.HEAD] for b in bounds) for t in ("hot text with spaces",)) >= 2  # a hot text has several ranges
    assert found(c.grouped(docs)) == brute(rows)


def test_all_rows_are_one_text(documents, small_ranges):
    rows = [(i % 50, "one text of this table") for i in range(700)]
    assert found(c.grouped(documents(rows))) == brute(rows)


def test_range_numbers(spark):
    bounds = sorted((head, h, r) for head in ("", "a", "b\\\"", "é") for h in (-5, 3) for r in (0, 9, 10**12))
    rows = [(head, h, r) for head in ("", "a", "aa", "b\\\"", "z", "é", "😀") for h in (-9, -5, 0, 3, 4) for r in (0, 5, 9, 10**12, 10**13)]
    df = spark.createDataFrame(rows, "head string, hash long, row long")
    for n in (0, 1, 2, 5, len(bounds)):
        out = df.select("*", c.range_of(F.struct("head", "hash", "row"), bounds[:n]).alias("range")).collect()
        assert all(o.range == sum(b <= (o.head, o.hash, o.row) for b in bounds[:n]) for o in out)


def test_kept_rows_have_all_columns(documents):
    docs = documents([(1, "a b"), (2, "a  b"), (2, "a  b"), (3, "c")]).withColumn("kept", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2))
    out = c.kept_rows(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r["kept"], r["a.b"]) for r in out.collect()) == [(2, "a  b", "mine", 1), (3, "c", "mine", 1)]


def test_no_rows(documents):
    assert c.grouped(documents([])).count() == 0 and c.kept_rows(documents([])).count() == 0


def test_no_python_in_the_plan(documents):
    plan = c.grouped(documents(corpus()[:50]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
