"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

A document's set holds its distinct shingles of five lower-cased words.  A signature has 64 coordinates, each
the least value of one hash function over the set; two sets of similarity s agree in a coordinate
with probability s.  Documents are posted under each (coordinate, value) pair, and pairs of documents
that collide in at least ``MATCHES`` coordinates are candidates: at similarity 0.75 a pair is
missed with probability 4e-7, at 0.8 with 1e-9.  Candidates are confirmed on the full sets.

*Prefix merging.*  Coordinate-value pairs are ordered from rare to frequent.  Two signatures that agree
in ``MATCHES`` places agree in one of the 64 - ``MATCHES`` + 1 rarest of each, so only those are posted;
values nobody else has are never posted, and a document with fewer shared values than ``MATCHES``
has no partner at all.

*Skip merging.*  Only components are asked for, so collisions inside a component are skipped.  First
every list is merged with its centre, the member with the most frequent values.  A list whose
members are then in one component is done, however long it is.  For the members of the other lists the order
from rare to frequent is taken on the shingles themselves: two linked sets must share one
of the rarest shingles of both, early enough to leave room for the overlap their sizes ask for.  Only
collisions of that kind between different components are counted.  No pairs inside a component
and no pairs of a whole list are ever made, and none that may be linked is left out.

Equal sets are one node, named by their least doc_id.  All tables are keyed by node, coordinate value or shingle;
frequent keys are counted with partial aggregates and joined under adaptive skew splitting.

Null text, or text without a word, has an empty set, no links, and is kept.  A row with null doc_id never
links others; it counts as a copy where a document with a doc_id has the same set, and is kept otherwise.  Rows that
repeat get a row each.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.graph import components
from panelwright.llm.storage import keep
from panelwright.llm.words import Joined, joined, mix

COORDINATES = 64
MATCHES = 30
WIDTH = 5
#: Linked from this similarity on, as a fraction: intersection / union >= 3 / 4.
PART, WHOLE = 3, 4

_FACTORS = np.random.default_rng(271828).integers(1, 1 << 62, COORDINATES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _FACTORS[:, None]


def shingle_sets(words: Joined) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, first = words.windows(WIDTH)
    start = np.searchsorted(first, words.first_word)
    for i in range(words.n_texts):
        if start[i] < start[i + 1]:
            yield np.unique(hashes[start[i] : start[i + 1]])
        else:
            value = np.zeros(1, np.uint64)
            for h in words.hashes[words.first_word[i] : words.first_word[i + 1]]:
                value = mix(value + h)
            yield value if words.first_word[i] < words.first_word[i + 1] else value[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function, as signed 32-bit integers; the set must not be empty."""
    least = [(_FACTORS * shingles[i : i + 2048]).min(axis=1) for i in range(0, len(shingles), 2048)]
    return (np.min(least, axis=0) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit key and its signature; a row for each row."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for words in joined(frame["text"], lower=True):
                for s in shingle_sets(words):
                    key = [int(mix(s * np.uint64(k)).sum().view(np.int64)) for k in (3, 5)] if len(s) else [0, 0]
                    rows.append((len(s), *key, signature(s) if len(s) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "key_a", "key_b", "sig"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(sign, "doc_id long, n_shingles long, key_a long, key_b long, sig array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the documents in ``wanted``; texts travel compressed."""

    def squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"node": frame["doc_id"], "packed": [zlib.compress((t or "").encode(), 1) for t in frame["text"]]})

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = (zlib.decompress(p).decode() for p in frame["packed"])
            sets = [s.view(np.int64) for words in joined(texts, lower=True) for s in shingle_sets(words)]
            yield pd.DataFrame({"node": frame["node"].to_numpy(), "shingles": sets})

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL").mapInPandas(squeeze, "node long, packed binary")
    return packed.join(wanted, "node", "left_semi").mapInPandas(spread, "node long, shingles array<long>")


def coordinate_lists(nodes: DataFrame) -> DataFrame:
    """(token, node, weight): the posted prefix of every node that may have a partner."""
    value = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posts = nodes.select("node", F.posexplode("sig").alias("at", "value")).select("node", value.alias("token"))
    frequency = posts.groupBy("token").agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1")
    shared = posts.join(frequency, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("frequency", "token"))).alias("tokens"), F.sum(F.log("frequency")).alias("weight")
    )
    shared = shared.where(F.size("tokens") >= MATCHES)
    return shared.select("node", "weight", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))).alias("t")).select("t.token", "node", "weight")


def enough_matches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``MATCHES`` coordinates or more."""
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    matches = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(matches >= MATCHES).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    # no distinct here: it would hold the join to its partitioning, and a frequent centre could not be split
    return both.where((PART + WHOLE) * common >= PART * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def ordered_pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def centre_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's centre."""
    centre = lists.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = lists.join(centre.select("token", F.col("top.node").alias("centre")), "token").where("node <> centre")
    return pairs.select(*ordered_pair(F.col("node"), F.col("centre"))).distinct()


def rare_shingle_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different labels that meet in a shingle early enough for the overlap they need.

    A set of n shingles in order of frequency that meets another first at place p shares n - p + 1 at most, so the
    other's size is at most ``reach``: (WHOLE + PART) * (n - p + 1) >= PART * (n + size).
    Shingles held by one label only come first; they are never a meeting place.
    """
    n = F.size("shingles")
    posts = sets.join(members, "node").select("node", "label", n.alias("n"), F.explode("shingles").alias("shingle"))
    mixed = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("frequency"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n"))
    mixed = mixed.where("low <> high").select("shingle", "frequency", "least_n")
    own = posts.join(mixed, "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("frequency", "shingle", "least_n"))).alias("held"))
    early = own.select("node", "label", "n", F.size("held").alias("m"), F.posexplode("held").alias("i", "h"))
    reach = F.floor(((PART + WHOLE) * (F.col("m") - F.col("i")) - PART * F.col("n")) / PART)
    early = early.select("node", "label", "n", reach.alias("reach"), F.col("h.shingle").alias("shingle"), F.col("h.least_n").alias("least_n"))
    early = early.where((F.col("reach") >= F.col("least_n")) & (WHOLE * F.col("reach") >= PART * F.col("n")))
    x, y = early.alias("x"), early.alias("y")
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    meet &= (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") <= F.col("x.reach"))
    return x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def link_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of every node that is linked to another."""
    lists = keep(coordinate_lists(nodes))
    sets = keep(full_sets(docs, lists.select("node").distinct()))
    links = keep(confirmed(enough_matches(centre_pairs(lists), nodes), sets))
    first = keep(components(links))
    labelled = lists.join(first, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    open_lists = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    members = keep(labelled.join(open_lists, "token", "left_semi").select("node", "label").distinct())
    late = keep(confirmed(enough_matches(keep(rare_shingle_pairs(members, sets)), nodes), sets))
    name = members.select(F.col("node"), F.col("label"))
    joint = late.join(name.select(F.col("node").alias("a"), F.col("label").alias("label_a")), "a").join(name.select(F.col("node").alias("b"), F.col("label").alias("label_b")), "b")
    merged = components(joint.select("label_a", "label_b"), "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("joint"))
    # a label that only the late links reach is a node without any earlier link
    alone = merged.join(first.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("joint").alias("label"))
    return first.join(merged, "label", "left").select("node", F.coalesce("joint", "label").alias("label")).unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = keep(signed(docs))
    nodes = keep(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")))
    labels = link_nodes(docs, nodes)
    named = nodes.select("key_a", "key_b", "node").join(labels, "node", "left").select("key_a", "key_b", F.coalesce("label", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "key_a", "key_b").join(named, ["key_a", "key_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component; of rows that repeat, one.  Rows without doc_id, which no verdict can name, stay."""
    verdicts = keep(near_duplicates(docs))
    kept = verdicts.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    columns = docs.columns
    out = docs.join(kept, "doc_id", "left_semi").select(*columns)
    if not verdicts.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.where("doc_id IS NULL"))
