import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelwright.llm.packing import best_fit_decreasing, pack_documents
from panelwright.llm.wordpieces import WordPieces

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def brute_best_fit(lengths, window):
    free, out = [], []
    for n in lengths:
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        if fits:
            least = min(f for f, _ in fits)
            out.append((least, window - least))
            free[next(i for f, i in fits if f == least)] -= n
        else:
            out.append((None, 0))
            free.append(window - n)
    return out, free


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    number, offset = best_fit_decreasing(np.array(lengths, int), 64)
    _, free = brute_best_fit(lengths, 64)
    loads = np.bincount(number, weights=lengths, minlength=0) if lengths else np.zeros(0)
    assert sorted(64 - loads) == sorted(free)
    assert (offset + np.array(lengths, int) <= 64).all()


def test_ids_are_the_library_s():
    words = WordPieces(PATH)
    rng = random.Random(1)
    alphabet = "aAbBzZ'stremvld 0129\t\n\r .,!?-éÉßñÄöÆ…‘’¿×µªº²İΣσς한国😀́\x00\x1c\x85\xa0​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(alphabet[:45]) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["<|endoftext|> a", "it's they'LL 'Re", "a" * 5000, "", " ", "THE!! THBLEHE!!"]
    for text in texts:
        assert words.encode(text) == np.array(ids(text), "<u4").tobytes(), text


def test_every_token_is_built_by_its_own_merges():
    words = WordPieces(PATH)
    for piece, rank in words.ranked._mergeable_ranks.items():
        if piece != b"\xff":
            assert words.ranked._encode_single_piece(piece) == [rank]
    byte = {v: k for k, v in __import__("panelwright.llm.wordpieces", fromlist=["x"])._byte_of_symbol().items()}
    for piece, rank in words.ranked._mergeable_ranks.items():
        if piece.endswith(b"\xff") and len(piece) > 1:
            found = LIBRARY.model.tokenize("".join(byte[b] for b in piece[:-1]))
            assert [t.id for t in found] == [rank]


def test_pack(documents):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "erthan", "Onble,", "x9"]) for _ in range(rng.randint(0, 1500)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 30_000), (1002, "word " * 30_000), (None, "no id"), (7, rows[7][1])]
    out = pack_documents(documents(rows), PATH).toPandas()
    whole = {}
    for doc_id, text in rows:
        key = None if doc_id is None else doc_id
        whole.setdefault(key, []).append([*ids(text), 2])
    for doc_id, group in out.assign(doc_id=out.doc_id.astype(object).where(out.doc_id.notna(), None)).groupby("doc_id", dropna=False):
        key = None if doc_id != doc_id else int(doc_id)
        copies = whole.pop(key)
        assert group.length.sum() == sum(map(len, copies))
        for r in group.itertuples():
            part = copies[0][r.start : r.start + r.length]
            assert r.doc_tokens == len(copies[0])
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert not whole
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *group.length.cumsum().tolist()[:-1]]
        assert group.length.sum() <= 4096
    assert out.length.sum() / (4096 * out.sequence_id.nunique()) > 0.95


def test_pack_nothing(documents):
    assert pack_documents(documents([]), PATH).count() == 0
