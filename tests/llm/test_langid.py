import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from panelwright.llm import langid

SF = "/root/testdata/sf0.01"


def test_n_grams_do_not_cross_texts():
    texts = [b"ab c", b"", b"x", b"\xc3\xa9t\xc3\xa9", b"ab c"]
    together = langid.counts(texts)
    for i, t in enumerate(texts):
        assert (together[i] == langid.counts([t])[0]).all()
    assert together[1].sum() == 0 and together[2].sum() > 0


def test_vectors_have_length_one():
    v = langid.weighted(langid.counts([b"some words here", b""]), np.ones(langid.DIMENSIONS, np.float32))
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs).toPandas().set_index("doc_id")
    truth = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pandas().set_index("doc_id").lang
    assert len(out) == len(truth)
    assert [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.index] == out.held_out.tolist()
    assert (out.lang_pred == truth[out.index])[out.held_out].mean() > 0.98
    assert out.rejected.mean() < 0.01
    assert out.score.between(0, 1).all()


def test_edges(documents):
    english = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en", "s") for i in range(40)]
    spanish = [(100 + i, f"el perro perezoso numero {i} salta sobre la zorra", "es", "s") for i in range(40)]
    odd = [(200, None, "en", "s"), (201, "", None, None), (202, "123 !!", "en", "s"), (203, "the lazy fox", None, "s"), (None, "la zorra salta", "es", "s"), (204, "Ωμέγα γράμματα μόνο εδώ", None, "s"), (205, "dog " * 50_000, "en", "s"), (100, spanish[0][1], "es", "s")]
    rows = english + spanish + odd
    out = langid.identify(documents(rows)).toPandas()
    assert len(out) == len(rows)
    by_id = out[out.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id")
    assert by_id.lang_pred[[200, 201, 202]].tolist() == ["und"] * 3 and by_id.score[200] == 0
    assert by_id.lang_pred[203] == "en" and out[out.doc_id.isna()].lang_pred.iloc[0] == "es"
    assert by_id.rejected[204] and by_id.lang_pred[204] in {"en", "es"}
    kept = langid.accepted_rows(documents(rows))
    assert kept.columns == documents(rows).columns
    assert kept.count() == (~out.rejected).sum()


def test_nothing_to_learn(documents):
    out = langid.identify(documents([(1, "some words", None, None)])).collect()
    assert [(r.lang_pred, r.rejected) for r in out] == [("und", True)]
    assert langid.identify(documents([])).count() == 0


FOREIGN = [
    "suomen kieli on kaunis ja vaikea oppia koska siinä on monta sijamuotoa ja pitkiä sanoja joita ulkomaalaiset eivät ymmärrä helposti",
    "a magyar nyelv nagyon nehéz mert sok rag van benne és a szórend is más mint a többi európai nyelvben ezért kevesen tudják",
    "xqzv kjhwq zzkp qwxv bvcxz plmkq wrtzx ghjkq vbnmz qqxzw zxcvq kkjhz wqpxm zvbqk jxqzw hhqzk pqxwv nzkqx bqwzj xvkqz",
]


def test_unlearnt_languages_and_gibberish_are_rejected(spark):
    """Beside the table, with training rows that have no letter or next to none in every language."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    top = table.agg({"doc_id": "max"}).collect()[0][0]
    ids = (i for i in range(top + 1, top + 10_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    odd = [(next(ids), t, lang) for lang in ("en", "de", "fr", "es") for t in ("", "12 345 !!", "x", "zq")]
    probes = [(-i, t, None) for i, t in enumerate(FOREIGN, 1)]
    out = langid.identify(table.unionByName(spark.createDataFrame(odd + probes, "doc_id long, text string, lang string"))).toPandas().set_index("doc_id")
    assert out.rejected[[i for i, *_ in probes]].all()
    assert out.rejected[[i for i, t, _ in odd if not any(map(str.isalpha, t))]].all()
    assert out.rejected[(out.index >= 0) & (out.index <= top)].mean() < 0.01


def test_a_letterless_training_row_changes_nothing(documents):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en", "s") for i in range(60)]
    odd = [(100 + i, t, "en", "s") for i in range(30) for t in ("", "123", "!?")]
    plain = {r.doc_id: (r.score, r.rejected) for r in langid.identify(documents([*rows, (999, FOREIGN[2], None, "s")])).collect()}
    mixed = {r.doc_id: (r.score, r.rejected) for r in langid.identify(documents([*rows, *odd, (999, FOREIGN[2], None, "s")])).collect()}
    assert plain[999][1] and all(mixed[i] == plain[i] for i in plain)


def brute_vector(text, idf):
    """Buckets of the two- and three-byte runs of a text, one by one; its last byte and the end count twice."""
    data = b"".join(bytes([b]) if b >= 0x80 or chr(b).isalpha() else b" " for b in text.lower().encode()) + b" "
    found = {}
    for n in (2, 3):
        for run in [data[i : i + n] for i in range(len(data) - n + 1)] + [data[-2:]] * (n == 3):
            if run[:2] != b"  ":
                code = int.from_bytes(run, "big") + (len(run) == 3) * (1 << 24)
                bucket = (code * 0x9E3779B1 % (1 << 32)) >> 20
                found[bucket] = found.get(bucket, 0) + 1
    v = {k: (1 + math.log(c)) * idf[k] for k, c in found.items()}
    size = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / size for k, x in v.items()}, set(found)


def dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def unit_sum(vectors):
    total = {}
    for v in vectors:
        for k, x in v.items():
            total[k] = total.get(k, 0.0) + x
    size = math.sqrt(sum(x * x for x in total.values())) or 1.0
    return {k: x / size for k, x in total.items()}


def brute_means(vectors):
    middle = unit_sum(vectors)
    order = sorted(range(len(vectors)), key=lambda i: -dot(vectors[i], middle))
    k = min(langid.CENTROIDS, len(vectors))
    means = [vectors[order[j * len(vectors) // k]] for j in range(k)]
    for _ in range(langid.ROUNDS):
        owner = [max(range(k), key=lambda j, v=v: (dot(v, means[j]), -j)) for v in vectors]
        means = [unit_sum([v for v, o in zip(vectors, owner, strict=True) if o == j]) if j in owner else means[j] for j in range(k)]
    return means


def test_predictions_by_brute_force(spark):
    rng = random.Random(4)
    english, dutch = "the of and with there from which ing".split(), "de het van een met niet zijn ook".split()
    rows = [(i, " ".join(rng.choice(english if i % 2 else dutch) + rng.choice(["", "", "a", "er", "3"]) for _ in range(rng.randint(8, 60))), "en" if i % 2 else "nl") for i in range(90)]
    rows += [(100, "zzz qqq", None), (101, "Ünïcödé wörds ähnlich", None), (102, "", "en"), (103, None, "nl"), (104, "the the " * 3000, "en")]
    training = [(i, t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1 and lang and t and any(map(str.isalpha, t))]
    plain = [1.0] * langid.DIMENSIONS
    df = [0] * langid.DIMENSIONS
    for _, t, _ in training:
        for k in brute_vector(t, plain)[1]:
            df[k] += 1
    idf = [math.log((1 + len(training)) / (1 + n)) + 1 for n in df]
    means = [(lang, m) for lang in ("en", "nl") for m in brute_means([brute_vector(t, idf)[0] for _, t, own in sorted(training) if own == lang])]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).toPandas().set_index("doc_id")
    for i, t, _ in rows:
        if not t:
            assert (out.lang_pred[i], out.score[i], out.rejected[i]) == ("und", 0.0, True)
            continue
        near = [dot(brute_vector(t, idf)[0], m) for _, m in means]
        assert abs(max(near) - out.score[i]) < 1e-4
        if sorted(near)[-1] - max(x for x, (lang, _) in zip(near, means, strict=True) if lang != means[near.index(max(near))][0]) > 1e-4:
            assert out.lang_pred[i] == means[near.index(max(near))][0]
    assert out.rejected[100] and not out.rejected[[i for i, *_ in training]].any()


def test_outer_distances_and_radii():
    rng = np.random.default_rng(2)
    points = np.abs(rng.normal(size=(60, langid.DIMENSIONS))).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    distinct, cosine = langid.outer_cosines(np.concatenate([points, points, points[:5]]))
    assert len(distinct) == 60 and cosine.max() < 0.999  # no copy of a point is among those it is measured against
    assert langid.radii_of(np.repeat(points[:1], 500, axis=0)) == [langid.WIDE] * langid.CLASSES
    assert langid.radii_of(points[:19]) == [langid.WIDE] * langid.CLASSES
    assert langid.radii_of(points)[-1] < langid.WIDE


def test_few_or_repeated_training_texts_reject_little(documents):
    """Eight texts a language, and one text a hundred times: new texts of the language stay, another script goes."""
    few = [(i, f"{w} the quick brown fox and the dog", "en") for i, w in enumerate("red lazy big small old young sad happy".split())]
    few += [(20 + i, f"{w} der schnelle braune fuchs und der hund", "de") for i, w in enumerate("rote faule grosse kleine alte junge traurige frohe".split())]
    same = [(100 + i, "el perro perezoso salta sobre la zorra", "es") for i in range(100)]
    new = [(300, "the dog and the fox are quick", None), (301, "der hund und der fuchs sind schnell", None), (302, "la zorra salta sobre el perro viejo", None), (303, "Ωμέγα γράμματα μόνο", None)]
    out = langid.identify(documents(few + same + new)).toPandas().set_index("doc_id")
    assert out.lang_pred[[300, 301, 302]].tolist() == ["en", "de", "es"] and not out.rejected[[300, 301, 302]].any()
    assert out.rejected[303] and out.rejected.sum() == 1


def test_columns_of_any_name_are_carried(documents):
    rows = [(i, f"the quick brown fox {'very ' * i} lazy", "en") for i in range(12)] + [(50, "γράμματα", "en"), (50, "the fox", "en")]
    docs = documents(rows).withColumn("found", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("Found_", F.lit(2)).withColumn("rejected", F.lit(3))
    kept = langid.accepted_rows(docs)
    assert kept.columns == docs.columns
    assert {(r["found"], r["a.b"], r["rejected"]) for r in kept.collect()} == {("mine", 1, 3)}


def test_equally_near_languages_and_no_rows(documents):
    rows = [(i, "same words in both", lang) for i in range(20) for lang in ("fr", "de")]
    out = langid.identify(documents(rows)).toPandas()
    assert set(out.lang_pred) == {"de"} and len(out) == 40
    assert langid.accepted_rows(documents([])).count() == 0
