import os

import pandas as pd
import pytest

from panelwright.llm import licences
from panelwright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
MIT = licences.KNOWN["MIT"]


def test_same_licence_in_other_dress(documents):
    wrapped = "\n".join(MIT[i : i + 1] if False else line for i, line in enumerate(MIT.split(" ")))
    texts = {
        1: MIT,
        2: MIT.upper(),
        3: "/*\n * " + MIT.replace("<year> <copyright holders>", "2019-2024 Somebody Else, Inc.").replace("\n", "\n * ") + "\n */",
        4: MIT.replace("sublicense", "sub-licence").replace(",", "").replace('"', "“"),
        5: wrapped.replace("Copyright\n(c)\n<year>\n<copyright\nholders>\n", ""),
        6: MIT.replace("without restriction", "with restrictions"),
        7: MIT + "\nCopyright 2024 Another\nAll rights reserved.",
    }
    found = {r.doc_id: r for r in licences.scan(documents(list(texts.items()))).collect()}
    assert [found[i].license for i in range(1, 8)] == ["MIT"] * 5 + [None, "MIT"]
    assert found[1].digest == found[3].digest != found[6].digest


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "LICENSED under the apache licence -- version 2.0\nmore text"), (5, "Released under the MIT License."), (5, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (6, "word " * 100_000 + "\nReleased under the MIT License.\n© 2020 x"), (7, "© 2020"), (8, "copyright matters")]
    found = licences.scan(documents(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: (r.license, r.n_notices, r.notices) for r in found}
    assert by_id == {1: (None, 0, ""), 2: (None, 0, ""), 3: (None, 0, ""), 4: (None, 1, "Apache-2.0 notice"), 5: ("MIT notice", 1, "MIT notice"), None: ("CC-BY-NC-4.0 notice", 1, "CC-BY-NC-4.0 notice"), 6: (None, 1, "MIT notice"), 7: (None, 0, ""), 8: (None, 0, "")}
    assert licences.scan(documents([])).count() == 0
    assert licences.scan(documents(rows), {}).where("license IS NOT NULL OR n_notices > 0").count() == 0


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("the driver tables are not here")
    found = QUERIES["op7_licence_scan"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op7_licence_scan"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(found, want[found.columns].astype({"license": object}), check_dtype=False)
    assert found.n_notices.sum() > 0


def test_no_python_in_the_plan(documents):
    plan = licences.scan(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
