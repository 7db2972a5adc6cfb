import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import words as W

from .helpers import blank_words, nasty_texts, plain_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\t.é漢\x00|< ", max_size=40)), max_size=8)


def check(texts):
    for rule, split in (("plain", plain_words), ("blank", blank_words)):
        w = W.words(pa.array(texts, pa.string()), rule)
        want = [split(t) for t in texts]
        got = [[w.text(i) for i in range(w.offsets[r], w.offsets[r + 1])] for r in range(len(texts))]
        assert got == want
        flat = [x for row in want for x in row]
        assert len(set(zip(flat, w.hashes.tolist()))) == len(set(flat)) == len(set(w.hashes.tolist()))
        for n in (2, 5):
            full, g = w.full(n), w.grams(n)
            seen = {}
            for r, row in enumerate(want):
                for i in range(len(row)):
                    at = w.offsets[r] + i
                    assert full[at] == (i + n <= len(row))
                    if full[at]:
                        assert seen.setdefault(tuple(row[i:i + n]), g[at]) == g[at]
            assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_hashes_and_grams(texts):
    check(texts)


def test_awkward_texts():
    check([t for t in nasty_texts() if t is None or len(t) < 50_000])


def test_words_longer_than_a_span_and_texts_beyond_it():
    long = "y" * (W._SPAN + 5)
    texts = [long, "a " + long + " b", "a b " * 200_000]
    w = W.words(pa.array(texts), "blank")
    assert w.counts.tolist() == [1, 3, 400_000]
    h = w.hashes
    assert h[0] == h[2] and h[1] == h[4] and h[3] == h[5] and len(set(h.tolist())) == 3


def test_grams_longer_than_a_column():
    for n in (2, 3, 5, 9):
        assert len(W.words(pa.array(["a b"]), "plain").grams(n)) == 2


def test_slices_of_an_array():
    a = pa.array(["x y", None, "z", "x y"])
    assert W.words(a.slice(2), "plain").hashes.tolist() == W.words(pa.array(["z", "x y"]), "plain").hashes.tolist()
