import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor

from panelwright.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute(rows):
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    n, v = sum(count.values()), len(count)
    piece = Counter()
    for token, c in count.items():
        for i in [LIBRARY.eos_id()] if token is None else LIBRARY.encode(token):
            piece[i] += c
    total = sum(piece.values()) + 0.5 * LIBRARY.get_piece_size()
    prob = {i: (piece[i] + 0.5) / total for i in range(LIBRARY.get_piece_size())}
    ids = {LIBRARY.id_to_piece(i): i for i in prob if not (LIBRARY.is_byte(i) or LIBRARY.is_control(i) or LIBRARY.is_unknown(i))}

    def ways(text):
        """Probability over all segmentations, from the end to the start, without logs."""
        memo = {len(text): 1.0}
        for i in range(len(text) - 1, -1, -1):
            p = sum(prob[ids[text[i:j]]] * memo[j] for j in range(i + 1, min(len(text), i + 40) + 1) if text[i:j] in ids)
            if text[i] not in ids:
                p += math.prod(prob[LIBRARY.piece_to_id(f"<0x{b:02X}>")] for b in text[i].encode()) * memo[i + 1]
            memo[i] = p
        return memo[0]

    out = []
    for (i, text), h in zip(rows, held):
        t = tokens(text)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        model = sum(math.log10(prob[LIBRARY.eos_id()] if x is None else ways("▁" + x)) for x in t)
        out.append((i, h, len(t), sum(count[x] > 0 for x in t), n, base, model))
    return out


@pytest.mark.parametrize("chunk_bytes", [500, 24_000_000])
def test_scores_by_brute_force(documents, chunk_bytes):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:80]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, "Ωx 한 😀\x00"), (503, "the " * 30_000), (503, "the " * 30_000), (None, "The end")]
    found = lattice.score(documents(rows), PATH, chunk_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for got, want in zip(sorted(found, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(got)[:5] == want[:5]
        assert np.allclose(tuple(got)[5:], want[5:], rtol=1e-9)


def test_probabilities_sum_to_one():
    """Over all piece sequences of one letter's pieces and the end, a geometric series."""
    n = LIBRARY.get_piece_size()
    one = lattice.Lattice(PATH, np.log(np.full(n, 1 / n)))
    assert math.isclose(math.exp(one.log_sum("q")), sum(n ** -k for k in (1, 2) for _ in range({1: "▁q" in one.pieces, 2: 1}[k])), rel_tol=1e-12)


def test_a_long_word_does_not_underflow():
    n = LIBRARY.get_piece_size()
    value = lattice.Lattice(PATH, np.log(np.full(n, 1 / n))).log_sum("ab" * 5000)
    assert -1e6 < value < -1e3


def test_nothing_to_learn(documents):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lattice.score(documents([(held, "a b")]), PATH).collect()[0]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert lattice.score(documents([]), PATH).count() == 0
