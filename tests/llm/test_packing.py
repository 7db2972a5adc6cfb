import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing as P
from quire.llm import tokens as T

from .helpers import empty_docs, nasty_docs, nasty_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def encoded(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def check(texts):
    ids, bounds = T.token_ids(pa.array(texts, pa.string()), PATH)
    assert [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:])] == [encoded(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aB's.,!?<|>é \n Σİ1", max_size=40)), max_size=6))
def test_ids_equal_those_of_whole_texts(texts):
    check(texts)


def test_ids_of_awkward_texts(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 50)
    check([*nasty_texts(), "İstanbul's 'S can't <|endoftext|>. <|StartOfText|> x<|endoftext|>y... A\x85B ΣΑΣ. é. ǅ! ½. 1.4,5; 漢字。.! a ̈b '...' s'. ﬁ."])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_tree_packs_as_plain_first_fit_decreasing(sizes):
    bins, offsets = P.first_fit_decreasing(np.array(sizes, dtype=np.int64), 16)
    room, want = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(16)
        want[i] = (b, 16 - room[b])
        room[b] -= sizes[i]
    assert list(zip(bins.tolist(), offsets.tolist())) == want


@pytest.mark.parametrize("group", [4096, 8])
def test_pieces_sequences_and_ids(spark, group):
    docs = nasty_docs(spark, [" ".join(["word"] * n) for n in (2047, 2048, 2046, 4095, 1, 700)] * 3)
    out = P.pack(docs, PATH, group=group, keep=["doc_id", "n_words"], with_ids=True).toPandas()
    texts = sorted(repr(encoded(r.text) + [1]) for r in docs.collect())
    assert (out.n_words == "x").all()
    for r in out.sort_values("start").itertuples():
        ids = np.array(r.ids, dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length <= 2048
    # every document's pieces lie end to end: count ids of all pieces against all texts
    assert out.length.sum() == sum(len(eval(t)) for t in texts)
    single = out[(out.start == 0) & (out.length == out.doc_tokens)]
    assert sorted(repr(list(map(int, x))) for x in single.ids) == [t for t in texts if len(eval(t)) <= 2048]
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all() and s.length.sum() <= 2048
    total = out.groupby("sequence_id").length.sum()
    if group > 100:
        assert (total < 1024).sum() <= 1


def test_empty(spark):
    out = P.pack(empty_docs(spark), PATH)
    assert out.count() == 0
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
