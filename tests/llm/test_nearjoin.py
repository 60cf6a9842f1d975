import random
import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import graph, nearjoin


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (set size, least doc_id reachable), comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= 0.75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Chains of edits, a large group of copies edited by themselves, shared passages, exact and near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            t[rng.randrange(len(t))] = rng.choice(words)
        return t

    texts = [text(rng.randint(1, 120)) for _ in range(60)]
    origin, passage = text(150), text(70)
    texts += [edited(origin, rng.randint(0, 9)) for _ in range(120)]
    texts += [passage + text(rng.randint(5, 60)) for _ in range(60)]
    chain = text(200)
    for _ in range(25):
        chain = edited(chain, 3)
        texts.append(chain)
    texts += [list(t) for t in rng.sample(texts, 20)]
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n", "  "]).join(t).replace("w1", "W1" if rng.random() < 0.5 else "w1")) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(documents, seed):
    rows = corpus(seed)
    found = nearjoin.near_duplicates(documents(rows)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert len({c for _, c in want.values()}) < len(rows) - 60  # there was something to link


def test_edges(documents):
    long = " ".join(f"t{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "two one"), (7, "one two three"), (8, long), (9, long + " end"), (8, long), (None, "one two"), (None, "a b c d e f"), (None, None)]
    found = nearjoin.near_duplicates(documents(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert [by_id[i].n_shingles for i in range(1, 10)] == [0, 0, 0, 1, 1, 1, 1, 39_996, 39_997]
    assert [by_id[i].component_id for i in range(1, 10)] == [1, 2, 3, 4, 4, 6, 7, 8, 8]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None and r.n_shingles == 1) == [(1, 4, False)]
    kept = nearjoin.kept_rows(documents(rows))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert kept.columns == documents(rows).columns


def test_no_rows(documents):
    assert nearjoin.near_duplicates(documents([])).count() == 0


def test_one_group_only(documents):
    rows = [(i, "the same text in every row of the table") for i in range(50)]
    assert {r.component_id for r in nearjoin.near_duplicates(documents(rows)).collect()} == {0}


def test_component_labels(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in found) == sorted(label.items())
    assert graph.components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).count() == 0
