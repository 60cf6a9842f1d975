"""Document fingerprints by winnowing, in SQL expressions only.

A text is its lower-cased words.  Every ``GRAM`` consecutive words have a hash that rolls over the word hashes (a polynomial
modulo a prime, extended by doubling); of every ``WINDOW`` consecutive grams the least hash is chosen, the
rightmost one on ties, and the choices with their positions are the fingerprint.  Two texts that
share ``GRAM + WINDOW - 1`` words in a row share a fingerprint entry, and nothing shorter than
``GRAM`` words is ever matched.  A text of fewer words than a gram has its words as one gram; a text of fewer
grams than a window has one window.

Null text counts as empty: no words, an empty fingerprint.  Two empty fingerprints are alike (1),
an empty and another are not (0).  Rows that repeat are ordered by their text and fingerprinted once each.
A row with null doc_id has no next document: its last third is cut, and nothing follows.  An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 5
WINDOW = 4
PRIME = 2_147_483_647
BASE = 1_000_003
#: Documents are neighbours within ranges of 2 ** BUCKET_BITS ids; ranges are ordered in levels of 2 ** LEVEL_BITS.
BUCKET_BITS = 8
LEVEL_BITS = 20


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, F.lit(by + 1), F.size(array))


def _roll(left: Column, right: Column, by: int, width: int) -> Column:
    """Grams of ``left`` extended by ``right`` words that start ``by`` later; null where a text ends."""
    factor = pow(BASE, width, PRIME)
    return F.zip_with(left, _shifted(right, by), lambda x, y: (x * factor + y) % PRIME)


def _least(array: Column, by: int) -> Column:
    """Window minima of twice the width; ``least`` passes over the null beyond the end."""
    return F.zip_with(array, _shifted(array, by), lambda x, y: F.least(x, y))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once: a lambda over an array that holds it alone."""
    return F.transform(F.array(value), body)[0]


def _windows_of(grams: Column) -> Column:
    """The rightmost least gram of every window, with its position."""

    def chosen(placed: Column) -> Column:
        least, by = placed, 1
        windows = F.greatest(F.size(placed) - (WINDOW - 1), F.least(F.size(placed), F.lit(1)))
        steps = []
        while by < WINDOW:
            steps.append(by)
            by *= 2

        def narrowed(array: Column, left: list[int]) -> Column:
            if not left:
                return F.array_distinct(F.slice(array, F.lit(1), windows))
            return let(_least(array, left[0]), lambda m: narrowed(m, left[1:]))

        return narrowed(least, steps)

    return let(F.transform(grams, lambda h, i: F.shiftleft(h, 31) + (F.lit(PRIME).cast("long") - i)), chosen)


def fingerprint(text: Column) -> Column:
    """An array of hash * 2^31 + (2^31 - 1 - position), in order of position.

    One expression in which every step is bound once and used by the next, so that no step is
    computed again for each element and no row is copied between steps.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def grams_of(w: Column) -> Column:
        count = F.size(w) - (GRAM - 1)
        whole = F.array(F.pmod(F.xxhash64(w), F.lit(PRIME)))
        rolled = let(
            F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))),
            lambda h: let(_roll(h, h, 1, 1), lambda two: let(_roll(two, two, 2, 2), lambda four: _roll(four, h, 4, 1))),
        )
        long_enough = F.slice(rolled, F.lit(1), F.greatest(count, F.lit(1)))
        return F.when(count > 0, long_enough).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words, lambda w: let(grams_of(w), _windows_of))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, fingerprint(F.col(text)))


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda p: F.shiftright(p, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def printed(fingerprint: Column) -> Column:
    """The entries as decimal numbers: the hash is ``entry >> 31``, the position ``2^31 - 1 - (entry & 2^31 - 1)``."""
    return F.array_join(fingerprint.cast("array<string>"), " ")


def followers(keys: DataFrame, bits_left: int = 64) -> DataFrame:
    """(key, next) in descending order of distinct long keys; the least is followed by the greatest.

    Keys are ordered within ranges of 2 ** LEVEL_BITS values, and the ranges in their turn, so that no
    task orders more than that many keys, however many there are.
    """
    if bits_left <= LEVEL_BITS:
        order = Window.orderBy(F.desc("key"))
        return keys.withColumn("next", F.coalesce(F.lead("key").over(order), F.max("key").over(Window.partitionBy())))
    ranged = keys.withColumn("range", F.shiftright("key", LEVEL_BITS))
    inside = ranged.withColumn("next", F.lead("key").over(Window.partitionBy("range").orderBy(F.desc("key"))))
    first = ranged.groupBy("range").agg(F.max("key").alias("first"))
    chain = followers(first.select(F.col("range").alias("key")), bits_left - LEVEL_BITS)
    after = chain.join(first.withColumnRenamed("range", "next"), "next").select(F.col("key").alias("range"), "first")
    return inside.join(after, "range").select("key", F.coalesce("next", "first").alias("next"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, in which the next document's start replaces the last third.

    Texts are shuffled once, by ranges of doc_id.  The document after a range's last is the first of the next range;
    those few are joined to their range.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bucketed = rows.where("doc_id IS NOT NULL").withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS))
    dealt = bucketed.repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    first = dealt.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.col("bucket").alias("next"), F.col("text").alias("border_text"))
    chain = followers(bucketed.select(F.col("bucket").alias("key")).distinct(), 64 - BUCKET_BITS)
    border = with_fingerprint(chain.join(first, "next").select(F.col("key").alias("bucket"), "border_text"), "border_text", "border")
    border = border.select("bucket", "border_text", hashes(F.col("border")).alias("border_hashes"))
    own = with_fingerprint(dealt.withColumn("next_text", F.lead("text").over(order)), "text", "entries")
    own = own.withColumn("own", hashes(F.col("entries"))).withColumn("next_own", F.lead("own").over(order))
    named = own.join(border, "bucket").select("doc_id", "text", "entries", "own", F.coalesce("next_text", "border_text").alias("next_text"), F.coalesce("next_own", "border_hashes").alias("next_own"))
    alone = with_fingerprint(rows.where("doc_id IS NULL"), "text", "entries").withColumn("own", hashes(F.col("entries")))
    alone = alone.select("doc_id", "text", "entries", "own", F.lit("").alias("next_text"), F.array().cast("array<bigint>").alias("next_own"))
    both = named.unionByName(alone).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "next_text")
    both = with_fingerprint(both, "edited", "edited_entries").withColumn("edited_own", hashes(F.col("edited_entries")))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("entries")).alias("fingerprint"), printed(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
