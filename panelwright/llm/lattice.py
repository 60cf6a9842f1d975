"""Language-model scores: the marginal probability of a text under a unigram model of subword pieces.

The vocabulary is an existing one.  Its pieces get log probabilities from their counts in the training
documents, segmented by the vocabulary's own library, with half a count added to each.  The probability of a
text is the sum over all ways to write it in pieces, by the forward recursion in log space over the
lattice of pieces.  As no piece crosses a word's marker, the sum over a text is the product
over its words and the end of the text; each distinct word's lattice is summed once, and documents
take the sums by position.  A character without a piece is spelled in byte pieces.

The base score is a unigram of words with half a count added.

Null text counts as empty: the end token alone.  A null doc_id is held out.  Rows that repeat get a row each.
Without training documents every word is unknown and every piece equally likely.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.chunks import ANSWER, CHUNK_BYTES, DOCUMENT, Documents, Uses, cut, pack, per_bucket, per_chunk, unpack
from panelwright.llm.pieces import SPACE_MARK, model

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Rows of the counts that are no pieces.
TOKENS, DISTINCT = -1, -2


def words(text: str) -> list[str]:
    return _WORDS(text.translate(_UPPER))


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 1, F.lit(True))


class Lattice:
    """Log probabilities of pieces, and forward sums over the lattice of a marked word."""

    def __init__(self, path: str, log_probability: np.ndarray):
        library = model(path).library
        self.pieces: dict[str, float] = {}
        self.bytes = [-math.inf] * 256
        for i, p in enumerate(log_probability.tolist()):
            if library.is_byte(i):
                self.bytes[int(library.id_to_piece(i)[3:5], 16)] = p
            elif not (library.is_control(i) or library.is_unknown(i)):
                self.pieces[library.id_to_piece(i)] = p
        self.longest = max(map(len, self.pieces))

    def log_sum(self, word: str) -> float:
        """log of the probability of ``word`` after a marker, over all segmentations."""
        text, get = SPACE_MARK + word, self.pieces.get
        forward = [0.0]
        for end in range(1, len(text) + 1):
            terms = []
            for start in range(max(0, end - self.longest), end):
                p = get(text[start:end])
                if p is not None:
                    terms.append(forward[start] + p)
            if get(text[end - 1]) is None:
                terms.append(forward[end - 1] + sum(self.bytes[b] for b in text[end - 1].encode()))
            top = max(terms)
            forward.append(top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms])))
        return forward[-1]


def score(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("flag", held_out())
    table = cut(rows, words, chunk_bytes)
    ends = table.where((F.col("bucket") == DOCUMENT) & ~F.col("flag")).count()
    size, end = _vocabulary(path)

    def count(uses: Uses) -> pd.DataFrame:
        seen = np.flatnonzero(uses.counts)
        total = np.zeros(size, np.int64)
        ids = model(path).library.encode([uses.words[i] for i in seen], num_threads=1)
        lengths = np.array([len(i) for i in ids], np.int64)
        np.add.at(total, np.array([i for word in ids for i in word], np.int64), np.repeat(uses.counts[seen].astype(np.int64), lengths))
        used = np.flatnonzero(total)
        piece = np.concatenate([used, [TOKENS, DISTINCT]])
        return pd.DataFrame({"piece": piece, "n": np.concatenate([total[used], [int(uses.counts.sum()), len(seen)]])})

    # one row per piece of the vocabulary, and the two totals
    counted = dict(per_bucket(table, count, "piece int, n long").groupBy("piece").agg(F.sum("n")).collect())
    tokens = counted.get(TOKENS, 0) + ends
    distinct = counted.get(DISTINCT, 0) + (ends > 0)
    n = np.array([counted.get(i, 0) + (ends if i == end else 0) for i in range(size)], float) + 0.5
    shared = docs.sparkSession.sparkContext.broadcast(np.log(n / n.sum()))
    floor = tokens + 0.5 * (distinct + 1)

    def sums(uses: Uses) -> pd.DataFrame:
        lattice = Lattice(path, shared.value)
        value = np.array([lattice.log_sum(w) for w in uses.words])
        out = [(chunk, uses.bucket, pack(uses.counts[used]), pack(value[used])) for chunk, used in zip(uses.chunks, uses.lists, strict=True)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "data", "more"])

    def join_back(order: np.ndarray, answers: pd.DataFrame, documents: Documents) -> pd.DataFrame:
        counts, value = np.zeros(len(order), np.uint64), np.zeros(len(order))
        if len(order):
            counts[order] = np.concatenate([unpack(d, np.uint64) for d in answers["data"]])
            value[order] = np.concatenate([unpack(d, np.float64) for d in answers["more"]])
        base = np.log10((counts.astype(float) + 0.5) / floor)
        base_end, model_end = math.log10((ends + 0.5) / floor), float(shared.value[end])
        out = []
        for doc_id, flag, places in documents:
            known = int((counts[places] > 0).sum()) + (ends > 0)
            out.append((doc_id, flag, len(places) + 1, known, tokens, float(base[places].sum()) + base_end, (float(value[places].sum()) + model_end) / math.log(10)))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return per_chunk(table, per_bucket(table, sums, ANSWER), join_back, schema)


def _vocabulary(path: str) -> tuple[int, int]:
    """Number of pieces, and the id of the end of a text."""
    library = model(path).library
    return library.get_piece_size(), library.eos_id()
