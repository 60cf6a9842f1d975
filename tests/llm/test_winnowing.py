import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from panelwright.llm import winnowing as w


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_entries(text, gram=w.GRAM, window=w.WINDOW):
    """(hash, position) of the rightmost least gram of every window."""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    codes = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) % w.PRIME for x in words]
    grams = []
    for i in range(len(words) - gram + 1):
        h = 0
        for c in codes[i : i + gram]:
            h = (h * w.BASE + c) % w.PRIME
        grams.append(h)
    if words and not grams:
        seed = 42
        for x in words:
            seed = xxhash.xxh64_intdigest(x.encode(), seed=seed)
        grams = [signed(seed) % w.PRIME]
    found = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[i : i + window]
        at = max(j for j, h in enumerate(part) if h == min(part)) + i
        if (grams[at], at) not in found:
            found.append((grams[at], at))
    return found


def shown(entries):
    return " ".join(str((h << 31) + w.PRIME - i) for h, i in entries)


def brute_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, cut, nxt = (brute_entries(x) for x in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(cut), brute_likeness(own, cut), brute_likeness(own, nxt)))
    return sorted(out)


def test_whole_table_by_brute_force(documents):
    rng = random.Random(3)
    words = ["the", "The", "über", "x", "😀", "alpha", "beta"] + [f"w{i}" for i in range(50)]
    ids = rng.sample(range(-2000, 5000), 70) + [10**15, -(10**15), 2**40, 2**40 + 1]
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 20, 21, 90])))) for i in ids]
    rows += [(6000, None), (6001, ""), (6002, " \n "), (6003, "a b " * 300), (6004, "w1 w2 w3 w4 w5 " * 30), (6004, "same id"), (6004, "same id")]
    found = w.compare_with_edits(documents(rows)).collect()
    assert sorted(tuple(r) for r in found) == brute(rows)


def test_without_id_and_long_text(documents):
    long = " ".join(f"v{i % 977}x{i}" for i in range(60_000))
    found = {r.doc_id: r for r in w.compare_with_edits(documents([(1, long), (None, "a b c d e f g")])).collect()}
    assert found[1].near_next == 1.0 and found[1].fingerprint == shown(brute_entries(long))
    assert found[None].near_next == 0.0 and found[None].n_chars == 13
    assert found[None].edited_sha256 == hashlib.sha256(b"a b c d e").hexdigest()


def test_a_shared_passage_is_always_found(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(w.GRAM + w.WINDOW - 1))
    noise = lambda: " ".join(f"n{rng.random()}" for _ in range(rng.randint(0, 60)))
    rows = [(f"{noise()} {passage} {noise()}", f"{noise()} {passage} {noise()}") for _ in range(40)]
    df = w.with_fingerprint(w.with_fingerprint(spark.createDataFrame(rows, "x string, y string"), "x", "a"), "y", "b")
    assert df.where(F.arrays_overlap(w.hashes(F.col("a")), w.hashes(F.col("b")))).count() == 40


def test_no_rows(documents):
    assert w.compare_with_edits(documents([])).count() == 0


def test_no_python_in_the_plan(documents):
    plan = w.compare_with_edits(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_texts_share_an_entry_with_their_edit(documents):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randint(1000, 9999)}" for _ in range(rng.randint(16, 50)))) for i in range(80)]
    assert [r.doc_id for r in w.compare_with_edits(documents(rows)).collect() if r.near_edited == 0] == []
