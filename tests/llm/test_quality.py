import os
import re
from collections import Counter

import pandas as pd
import pytest

from panelwright.llm import quality
from panelwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered, seen, lines = Counter(grams), set(), set(), 0
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)


def test_counts_of_whole_texts():
    texts = [None, "", " \n\t", "a", "a\n\na\n a\na", "\n".join(["one two"] * 40), "é¿ " * 9 + "#|<", "x y z " * 5000, "w\x1cv\xa0u\x85t"]
    found = quality.count_frame(pd.Series(texts))
    assert [tuple(map(int, r)) for r in found.itertuples(index=False)] == [brute(t) for t in texts]


def test_verdicts(documents):
    clean = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"$$%w{i}" for i in range(60))
    rows = [(i, clean, "en", "good") for i in range(30)] + [(300 + i, clean, "en", f"good{i % 5}") for i in range(200)]
    rows += [(100 + i, junk, "en", "bad") for i in range(40)] + [(150, clean, "en", "bad")]
    rows += [(200, junk, "en", "tiny"), (201, clean, None, None), (202, None, None, "good"), (202, None, None, "good"), (None, "few words", "en", None)]
    out = quality.judge(documents(rows)).toPandas()
    assert len(out) == len(rows)
    kept = {None if r.doc_id != r.doc_id else int(r.doc_id): bool(r.kept) for r in out.itertuples()}
    assert kept[0] and not kept[100] and not kept[150]
    assert kept[200]  # one failing document does not condemn its host
    assert kept[201] and not kept[202] and not kept[None]
    rejected = out.set_index("doc_id").host_rejected
    assert rejected[150] and not rejected[200]
    assert sorted(quality.kept_rows(documents(rows)).toPandas().doc_id.astype(int)) == sorted(k for k, v in kept.items() if v)


def test_prior_shrinks_to_the_mean():
    mean, strength = quality.beta_prior(3, 300, 30000.0, 30, 3.0)
    assert mean == 0.1 and strength > 1000  # equal hosts: full shrinkage
    assert quality.beta_prior(2, 200, 20000.0, 100, 100.0)[1] == pytest.approx(4)  # hosts all or none: least shrinkage
    assert quality.beta_prior(0, None, 0, 0, 0) == (0.0, 1.0)


def test_no_rows(documents):
    assert quality.judge(documents([])).count() == 0
    assert quality.kept_rows(documents([])).count() == 0


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("the driver tables are not here")
    found = QUERIES["op2_quality_rules"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op2_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(found, want[found.columns], check_dtype=False)
