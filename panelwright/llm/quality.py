"""Quality rules with verdicts on hosts.

Every document gets counts from its whole text and fails or passes a few rules.  Failures are
summed per host (the column ``source``).  A host's failure rate under a rule is shrunk towards
the rate of all hosts by a beta prior whose strength is estimated from the spread between
hosts (moments of the beta-binomial), so a host with few documents is not condemned by them.
A host whose shrunk rate of any rule exceeds ``HOST_RATE`` is rejected, and the verdict is
joined back to its documents.

Null text counts as empty: no words, so the base rule fails.  A null host is nobody's host and has
no verdict.  Rows that repeat are judged and counted once each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.storage import keep
from panelwright.llm.words import Joined, joined, mix

HOST_RATE = 0.5
#: Bounds of the prior's intra-host correlation 1 / (a + b + 1): strength between 4 and a million.
CORRELATION = (1e-6, 0.2)
#: Hosts up to this many are broadcast; more are joined by shuffle with the documents of each host spread.
BROADCAST_HOSTS = 20_000
SPREAD = 64

REPEAT_WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Joined) -> np.ndarray:
    """Words of each text that lie in a window found at least twice in this text."""
    hashes, first = words.windows(REPEAT_WINDOW)
    text = words.text[first]
    keys = mix(hashes + mix(text.astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    cover[first[twice]] += 1
    cover[first[twice] + REPEAT_WINDOW] -= 1
    return np.bincount(words.text[np.cumsum(cover[:-1]) > 0], minlength=words.n_texts)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def count_frame(texts: pd.Series) -> pd.DataFrame:
    parts = []
    for words in joined(texts):
        letters = ~(words.space | CONTINUES[words.bytes])
        parts.append(np.stack([np.diff(words.first_word), words.per_text(letters), words.per_text(SYMBOLS[words.bytes]), repeated_words(words)], axis=1))
    counts = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
    n, chars, symbols, repeats = counts.T.astype(np.int64)
    lines = np.array([duplicate_lines(t) for t in texts], np.int64)
    return pd.DataFrame(dict(zip(COUNTS, (n, chars, symbols, lines, repeats), strict=True)))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of the whole text; a row for each row."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = count_frame(frame["text"])
            out.insert(0, "source", frame["source"].to_numpy())
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInPandas(count, schema)


def rules() -> dict[str, Column]:
    """True where a document fails."""
    n = F.col("n_words")
    return {
        "short": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": (F.col("n_dup_lines") > 2) & (50 * F.col("n_dup_lines") > n),
    }


def host_rates(counts: DataFrame) -> DataFrame:
    """source, n_docs and the shrunk failure rate of every rule."""
    names = list(rules())
    hosts = counts.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(rule.cast("long")).alias(f"failed_{k}") for k, rule in rules().items()]
    )
    n = F.col("n_docs")
    moments = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.sum(n * n.cast("double")).alias("squares"),
        *[f for k in names for f in (F.sum(f"failed_{k}").alias(f"sum_{k}"), F.sum(F.col(f"failed_{k}") * F.col(f"failed_{k}").cast("double") / n).alias(f"spread_{k}"))],
    ).first()
    shrunk = []
    for k in names:
        mean, strength = beta_prior(moments["hosts"], moments["docs"], moments["squares"], moments[f"sum_{k}"], moments[f"spread_{k}"])
        shrunk.append(((F.col(f"failed_{k}") + strength * mean) / (n + strength)).alias(f"rate_{k}"))
    return hosts.select("source", "n_docs", *shrunk)


def beta_prior(hosts: int, docs: int | None, squares: float, failed: int, spread: float) -> tuple[float, float]:
    """Mean and strength a + b of the prior; ``spread`` is the sum over hosts of failed^2 / docs."""
    if not docs:
        return 0.0, 1.0
    mean = failed / docs
    between = spread - docs * mean * mean
    chance, room = mean * (1 - mean), docs - squares / docs - (hosts - 1)
    correlation = (between - chance * (hosts - 1)) / (chance * room) if chance > 0 and room > 0 else 0.0
    correlation = min(max(correlation, CORRELATION[0]), CORRELATION[1])
    return mean, 1 / correlation - 1


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, host_rejected and kept of every row."""
    counts = keep(text_counts(docs))
    rates = keep(host_rates(counts))
    rejected = F.greatest(*[F.col(f"rate_{k}") for k in rules()], F.lit(0.0)) > HOST_RATE
    hosts = rates.select("source", rejected.alias("host_rejected"))
    if rates.count() <= BROADCAST_HOSTS:
        joined_back = counts.join(F.broadcast(hosts), "source", "left")
    else:
        part = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SPREAD)).cast("int")
        copies = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        joined_back = counts.withColumn("part", part).join(copies, ["source", "part"], "left")
    base_failed = rules()["short"] | rules()["repeats"]
    host_rejected = F.coalesce("host_rejected", F.lit(False))
    return joined_back.select("doc_id", *COUNTS, base_failed.alias("base_failed"), (~base_failed & ~host_rejected).alias("kept"), host_rejected.alias("host_rejected"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, judged row by row in one more pass over the text.

    The base rule is recomputed where the text is, so the text itself is never shuffled.
    """
    rates = keep(host_rates(keep(text_counts(docs))))
    bad = rates.where(F.greatest(*[F.col(f"rate_{k}") for k in rules()], F.lit(0.0)) > HOST_RATE).select("source")

    @F.pandas_udf("boolean")
    def base_passes(text: pd.Series) -> pd.Series:
        c = count_frame(text)
        return (c["n_words"] >= 20) & (100 * c["n_repeat_words"] <= 30 * c["n_words"])

    passing = docs.where(base_passes(F.col("text").cast("string")))
    if not bad.isEmpty():
        passing = passing.join(F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad, "source", "left_anti")
    return passing


#: The same result in SQL: windows of eight words by position, hosts by moments.
QUALITY_SQL = r"""
WITH tokens AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM tokens)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, t.source, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM tokens t LEFT JOIN covered c ON c.doc_id = t.doc_id LEFT JOIN lines l ON l.doc_id = t.doc_id
), failures AS (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words,
    10 * n_symbols > n_words, n_dup_lines > 2 AND 50 * n_dup_lines > n_words])::INT AS failed
  FROM counts WHERE source IS NOT NULL
), hosts AS (
  SELECT rule, source, count(*) AS n, sum(failed) AS f FROM failures GROUP BY rule, source
), moments AS (
  SELECT rule, count(*) AS k, sum(n) AS docs, sum(n * n::DOUBLE) AS squares, sum(f) / sum(n) AS m, sum(f * f::DOUBLE / n) AS spread FROM hosts GROUP BY rule
), prior AS (
  SELECT rule, m, 1 / least(greatest(CASE WHEN m > 0 AND m < 1 AND docs - squares / docs - (k - 1) > 0
    THEN (spread - docs * m * m - m * (1 - m) * (k - 1)) / (m * (1 - m) * (docs - squares / docs - (k - 1))) ELSE 0 END, 1e-6), 0.2) - 1 AS strength
  FROM moments
), verdicts AS (
  SELECT source, bool_or((f + strength * m) / (n + strength) > 0.5) AS rejected FROM hosts JOIN prior USING (rule) GROUP BY source
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected
FROM judged LEFT JOIN verdicts USING (source)
"""
