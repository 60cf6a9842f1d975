import random

import pytest
from test_nearjoin import brute as near_brute
from test_quality import brute as count_brute

import corpus_pipeline
from panelwright.llm.queries import ORACLES, QUERIES, tokenizer
from panelwright.llm.wordpieces import WordPieces

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def corpus():
    rng = random.Random(12)
    english = ["the", "of", "and", "tion", "there", "with", "from", "that", "which", "were"] + [f"{a}{b}" for a in ("th", "ing", "er") for b in ("an", "ough", "ly", "ed")]
    german = ["der", "die", "und", "ung", "nicht", "schaft", "über", "für", "ein"] + [f"{a}{b}" for a in ("sch", "keit", "ge") for b in ("en", "lich", "stück", "te")]
    rows = []
    for i in range(160):
        lang, words = ("en", english) if i % 3 else ("de", german)
        rows.append((i, " ".join(rng.choice(words) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(rng.randint(15, 300))), lang, f"s{i % 5}", None))
    rows += [(200 + i, rows[i][1].replace("the", "The", 1) + " end", *rows[i][2:]) for i in range(25)]
    rows += [(300, "same words again and again here now " * 40, "en", "s1", None), (301, "few words", "en", "s1", None), (302, "1 2 3 " * 30, "en", "s0", None), (303, None, None, None, None), (304, "", "en", None, None), (305, " ".join(f"Ωμέγα{i}" for i in range(50)), None, "s2", None)]
    return rows


def test_stages_by_brute_force(spark, folder):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    good = {i for i, t, *_ in rows if (c := count_brute(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    first = stages["quality rules"](spark, docs, "")
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good
    assert 302 not in good and 305 in good
    second = stages["language identification"](spark, first, "")
    known = {r.doc_id for r in second.collect()}
    assert second.columns == docs.columns and known == good - {305}  # another script
    third = stages["near duplicates"](spark, second, "")
    found = near_brute([(i, t) for i, t, *_ in rows if i in known])
    kept = {i for i, (_, least) in found.items() if i == least}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == kept and len(kept) < len(known) - 10
    out = corpus_pipeline.run(spark, folder(rows)).toPandas()
    words = WordPieces(tokenizer("word_bpe_49k.json"))
    want = {i: len(words.encode(t)) // 4 + 1 for i, t, *_ in rows if i in kept}
    assert out.groupby("doc_id").length.sum().to_dict() == want
    assert out.groupby("sequence_id").length.sum().max() <= 4096


def test_no_rows(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_rows_without_ids_and_repeated_rows(spark, folder):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text + " end", "en", "s", 2), (None, text, "en", "s", None), (3, " ".join(f"of{i} the{i} and word{i}" for i in range(40)), "en", "s", 3)]
    rows += [(10 + i, " ".join(f"the{i} of{j} and{i * j}" for j in range(30)), "en", "s", 9) for i in range(10)]
    out = corpus_pipeline.run(spark, folder(rows)).toPandas()
    assert out.doc_id.dropna().astype(int).value_counts().to_dict() == {1: 1, 3: 1} | {10 + i: 1 for i in range(10)}
    assert out.doc_id.isna().sum() == 1


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language identification", "near duplicates", "packing"]
