import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor

from panelwright.llm import chunks, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids))


def test_marked_words_give_the_library_s_ids():
    words = pieces.MarkedWords(PATH)
    rng = random.Random(6)
    alphabet = "  ▁▁aeThexz\n\t\r'.,;(){}<s>/0123é한😀\x00　 ﬁ"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert [i for w in words.encode(pieces.marked_words(text)) for i in w] == LIBRARY.encode(text), repr(text)


def test_packed_integers():
    for values in (np.array([], np.uint32), np.array([0, 1, 2**32 - 1], np.uint32), np.array([2**63], np.uint64), np.array([-1.5, 2e-300])):
        assert (chunks.unpack(chunks.pack(values), values.dtype) == values).all()
    assert chunks.unpack_words(chunks.pack_words(["a", "é\n", "x y"])) == ["a", "é\n", "x y"]


@pytest.mark.parametrize("chunk_bytes", [300, pieces.CHUNK_BYTES])
def test_whole_texts(documents, chunk_bytes):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:120]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " "), (503, "  a  "), (504, "▁"), (505, "\n \n"), (506, "word " * 60_000), (506, "word " * 60_000), (None, "x\x00y")]
    found = pieces.encode_decode(documents(rows), PATH, chunk_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(map(tuple, found), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)


def test_no_rows(documents):
    assert pieces.encode_decode(documents([]), PATH).count() == 0
