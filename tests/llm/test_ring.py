import zlib
from collections import Counter

from pyspark.sql import functions as F

from panelwright.llm import ring


def brute(rows, points, shards):
    """Row by row: every arc fills its own shard first, in rank order; the rest walks on."""
    capacity = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    positions = [p for p, _ in points]
    arcs = {}
    for position, key in rows:
        arc = next((i for i, p in enumerate(positions) if p >= position), 0)
        arcs.setdefault(arc, []).append(key)
    load, place, late = [0] * shards, {}, []
    for arc in sorted(arcs):
        shard = points[arc][1]
        for n, key in enumerate(arcs[arc]):
            if load[shard] < capacity[shard]:
                load[shard] += 1
                place[arc, n] = shard
            else:
                late.append((arc, n))
    for arc, n in late:
        at = arc
        while True:
            at = (at + 1) % len(points)
            if load[points[at][1]] < capacity[points[at][1]]:
                load[points[at][1]] += 1
                place[arc, n] = points[at][1]
                break
    return Counter((arc, shard) for (arc, _), shard in place.items())


def checked(out, n, shards=8):
    loads = Counter(out["shard"])
    assert len(out) == n
    assert max(loads[s] for s in range(shards)) - min(loads[s] for s in range(shards)) <= 1
    for _, group in out.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    return out


def test_counts_and_slots(spark, documents):
    rows = [(i, f"text {i} é") for i in range(2003)] + [(None, "x"), (None, None), (5, "text 5 é"), (5, "text 5 é")]
    out = checked(ring.shard_documents(documents(rows)).toPandas(), len(rows))
    sizes = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None}
    for r in out[out.doc_id.notna()].itertuples():
        assert (r.size, r.text_crc32) == sizes[int(r.doc_id)]


def test_overflow_continues_clockwise(spark, documents):
    rows = [(i, str(i)) for i in range(997)]
    points = ring.ring_points(spark, 8)
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("doc_id").alias("h")).toPandas()
    want = brute([(r.h, r.doc_id) for r in hashed.itertuples()], points, 8)
    out = ring.shard_documents(documents(rows)).toPandas().merge(hashed, on="doc_id")
    arc = [next((i for i, (p, _) in enumerate(points) if p >= h), 0) for h in out.h]
    assert Counter(zip(arc, out["shard"])) == want


def test_a_frequent_key_spreads(documents):
    rows = [(1, f"text {i}") for i in range(600)] + [(i, "t") for i in range(2, 400)]
    checked(ring.shard_documents(documents(rows)).toPandas(), len(rows))


def test_few_rows_move_when_a_shard_is_added(documents):
    docs = documents([(i, str(i)) for i in range(4000)])
    old = ring.shard_documents(docs, 8).toPandas().set_index("doc_id")["shard"]
    new = ring.shard_documents(docs, 9).toPandas().set_index("doc_id")["shard"]
    assert (old != new.loc[old.index]).mean() < 0.35  # a modulus of the hash moves 8 of 9 rows


def test_no_rows(documents):
    assert ring.shard_documents(documents([])).count() == 0
