import pyarrow as pa
import pytest

from quire.llm import linechunks as L

from .helpers import empty_docs, nasty_docs, nasty_texts, prose, rows_of


def chunks(text):
    """Chunks by the module's hashes, but cut, measured and taken out in plain Python."""
    c = L.Chunks(pa.array([text], pa.string()))
    raw = (text or "").encode()
    return [(c.bytes(i), bool(c.fit[i]), int(s), int(e)) for i, (s, e) in enumerate(zip(c.starts, [*c.starts[1:], len(raw)]))]


def brute(docs):
    first = {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    out = [None] * len(docs)
    for i in order:
        text = docs[i][1]
        if text is None:
            continue
        raw, parts, gone = text.encode(), [], False
        all_chunks = chunks(text)
        for body, fit, s, e in all_chunks:
            gone = fit and body in first
            if fit and not gone:
                first[body] = True
            if not gone:
                parts.append(raw[s:e])
        left = b"".join(parts)
        out[i] = (left.rstrip(b"\n") if all_chunks and gone else left).decode() if all_chunks else text
    return sorted(((d, o) for (d, _), o in zip(docs, out)), key=repr)


def documents():
    line = lambda s, n=9: " ".join(prose(s, n))
    shared = [line(s) for s in range(100, 112)]
    long = line(500, 60)
    out = ["\n".join([line(i), *shared, line(i + 1000)]) for i in range(6)]
    out += ["\n\n".join([*shared[2:], line(31)]), "\n".join(shared), "\n".join(shared) + "\n", f"{line(41)}\n{long}\n{line(42)}",
            f"{line(43)}\n{long}", long, "\n".join(shared + [line(44)] + shared), "\n".join([line(s, 2) for s in (1, 2)] * 9)]
    return out


def test_chunks_tile_the_text_and_shift_with_it():
    for text in [*documents(), *[t for t in nasty_texts() if t]]:
        parts = chunks(text)
        assert all(a[3] == b[2] for a, b in zip(parts, parts[1:]))
        for body, fit, s, e in parts:
            n, words = len([x for x in body.split(b"\n") if x]), len(body.split())
            assert n <= L.MOST_LINES and body == text.encode()[s:e].rstrip(b"\n")
            assert not fit or (n > 1 and words >= L.MIN_WORDS) or words >= L.LONG_WORDS
    lines = [" ".join(prose(s, 9)) for s in range(200)]
    whole, shifted = chunks("\n".join(lines)), chunks("\n".join(["new line here", *lines[:90], "inserted", *lines[90:]]))
    assert len({c[0] for c in whole} - {c[0] for c in shifted}) <= 4 < len(whole) / 5


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force(spark, partitions, scratch):
    docs = nasty_docs(spark, documents())
    path = f"{scratch}/d{partitions}"
    docs.coalesce(1).write.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(L.without_repeats(spark.read.parquet(path).repartition(partitions) if partitions > 1 else spark.read.parquet(path))
                  .select("_in.doc_id", "text"), "*")
    want = brute(rows)
    texts = lambda x: sorted(t or "" for _, t in x)  # noqa: E731  which of two rows with one id comes first is by place
    assert texts(got) == texts(want) and [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]


def test_documents_keep_columns_and_count_anew(spark):
    docs = nasty_docs(spark, documents())
    left = L.deduplicated_documents(docs)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()
    changed = left.where("text is not null and doc_id >= 17").collect()
    assert changed and all(r.n_chars == len(r.text) for r in changed)
    assert left.where("text is null").count() == 1 and left.where("text = ''").count() >= 1  # they were so before


def test_bytes_are_compared(spark):
    texts = pa.array([documents()[0]])
    c = L.Chunks(texts)
    place = int(c.fit.nonzero()[0][0])
    assert L.strip_chunks(texts, [[{"place": place, "chunk": b"other"}]]) == ([texts[0].as_py()], [0])
    assert L.strip_chunks(texts, [[{"place": place, "chunk": c.bytes(place)}]])[1] == [1]


def test_lines_go_only_where_their_bytes_agree():
    texts = pa.array(["a b\nc\n\nd\ne", None, "x"])
    drops = [[{"place": 1, "until": 2, "body": b"c\nd"}, {"place": 3, "until": 3, "body": b"other"}], None, []]
    assert L.strip_lines(texts, drops) == (["a b\ne", None, "x"], [2, 0, 0])


def test_runs_with_equal_hashes_and_other_bytes_stay(spark, monkeypatch):
    """Hashes that collide everywhere make every run of over 50 words a candidate; on the registered path bytes decide."""
    real = L.runs

    def colliding(texts, passage):
        row, place, until, hashes = real(texts, passage)
        return row, place, until, [(place * 1000 + until).astype("int64"), (place * 0).astype("int64")]

    monkeypatch.setattr(L, "runs", colliding)
    line = lambda s, n: " ".join(prose(s, n))
    texts = ["\n".join(line(100 * d + i, 20) for i in range(4)) for d in range(6)] + ["\n".join(line(i, 20) for i in range(4))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = dict(rows_of(L.without_repeats(docs, L.PASSAGE).select("_in.doc_id", "text"), "*"))
    assert got[6] == "" and [got[d] for d in range(6)] == texts[:6]


def test_stretches_are_put_together():
    import numpy as np

    found = [(0, 2, 7, 10), (1, 4, 7, 11), (5, 6, 7, 15), (9, 9, 7, 19), (2, 3, 8, 0), (9, 12, 9, 3), (6, 7, 5, 1)]
    got = sorted(zip(*(x.tolist() for x in L.stretches(*(np.array(c) for c in zip(*found))))))
    assert got == [(0, 6, 7, 10), (6, 7, 5, 1), (9, 12, 9, 3)]


def test_empty(spark):
    assert L.without_repeats(empty_docs(spark)).count() == 0 and L.deduplicated_documents(empty_docs(spark)).count() == 0


def passages_gone(docs):
    """Lines that plain Python removes: those of a run of over PASSAGE words whose lines stand in an earlier text, or before it."""
    lines = [[x for x in t.split("\n") if x] for t in docs]
    out = []
    for d, own in enumerate(lines):
        bad = set()
        for i in range(len(own)):
            for e, other in enumerate(lines[:d + 1]):
                for k in range(len(other) if e < d else i):
                    n = 0
                    while i + n < len(own) and k + n < len(other) and own[i + n] == other[k + n] and (e < d or k + n < i):
                        n += 1
                    if sum(len(x.split()) for x in own[i:i + n]) > L.PASSAGE:
                        bad.update(range(i, i + n))
        out.append(bad)
    return out


def test_planted_passages_go_whatever_their_lines_and_neighbours(spark):
    line = lambda s, n: " ".join(prose(s, n))
    texts, planted = [], []
    for k, (n, size) in enumerate([(2, 30), (3, 20), (4, 15), (6, 10), (11, 5), (1, 51), (30, 3)]):
        passage = [line(1000 * k + i, size + i % 2) for i in range(n)]
        for copy in range(5):
            s = 100_000 + 100 * (10 * k + copy)
            texts.append("\n".join([line(s + i, 7 + 9 * i) for i in range(copy)] + passage + [line(s + 50 + i, 30 - 7 * i) for i in range(copy)]))
            planted.append((passage, copy))
    texts.append("\n".join([line(7, 10)] * 20))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(rows_of(L.without_repeats(docs, L.PASSAGE).select("_in.doc_id", "text"), "*"))
    for d, (passage, copy) in enumerate(planted):
        left = got[d].split("\n")
        assert [x in left for x in passage] == [copy == 0] * len(passage) and len(left) == 2 * copy + len(passage) * (copy == 0) or not got[d]
    for d, bad in enumerate(passages_gone(texts)):
        # lines that chunks of fewer words take out besides are none here
        assert [x for x in got[d].split("\n") if x] == [x for i, x in enumerate(x for x in texts[d].split("\n") if x) if i not in bad]
    assert got[len(texts) - 1].count("\n") == 5


def test_copies_leave_nothing(spark):
    texts = ["\n".join(" ".join(prose(100 * g + i, 1 + (7 * i + g) % 60)) for i in range(g + 1)) for g in range(12)]
    docs = spark.createDataFrame([(3 * g + k, t, len(t)) for g, t in enumerate(texts) for k in range(3)],
                                 "doc_id long, text string, n_chars long")
    left = {r.doc_id: r.text for r in L.deduplicated_documents(docs).collect()}
    for g, t in enumerate(texts):
        now = [left[3 * g + k] for k in range(3) if 3 * g + k in left]
        assert now in ([t], [t] * 3)  # one, or whole ones that are left to the join
        assert len(now) == 1 or len(t.split()) <= L.PASSAGE
