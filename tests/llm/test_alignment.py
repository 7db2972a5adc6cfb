"""Token alignment against whole-text encoding and plain Python cuts, and the corpus counts."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import public_tokenizers
from quire.llm import alignment

from .helpers import empty_docs, nasty_docs, nasty_texts, prose, rows_of

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WIDE = [" lead", "trail ", "two  blanks", "a\n b\n  c\t d", "tab\tx", "nb  x    y", "em  x", "z　  q 　x", "x\u0085 y",
        "漢字 かな 🧿🧿 ﬁ é é", "﻿bom", "\r\n x\r\n", " ", "  ", "   x   ", "▁mark", "a ▁ b", "<s> </s> <unk> <0x41>",
        "<|endoftext|> x <|endoftext|>", "don't we'll 'S 123,456.78 --- ((x))", "\x00 \x01\x7f", "𝒜𝒷 ​ zero​width ‍",
        "ÀÉ ñandú Größe œuvre — “quoted” …", "x" * 3000, "ab " * 2000, "é" * 500, "   \n\n   \n x"]


@pytest.fixture(scope="module")
def tool():
    return alignment.aligner(A_PATH, B_PATH)


def tokens(tool, text):
    """(ids, byte strings) of either side over the whole text, or None."""
    if not text:
        return None
    want = (" " + text).encode()
    a = tool.a.encode(" " + text, add_special_tokens=False).ids
    b = tool.b.encode(text)
    found = [(i, tool.a_bytes.get(i, b"")) for i in a], [(i, tool.b_bytes[i]) for i in b]
    return found if all(b"".join(x for _, x in side) == want for side in found) else None


def brute(tool, texts):
    links, rows = [], []
    for text in texts:
        found = tokens(tool, text)
        if found is None:
            rows.append([0, 0, 0, ""])
            links.append([])
            continue
        ends = []
        for side in found:
            at, by = 0, {}
            for i, raw in side:
                at += len(raw)
                by[at] = i
            ends.append(by)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(by[e]) for e in sorted(by) if before < e <= c) for by in ends))
            before = c
        rows.append([len(found[0]), len(found[1]), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links.append([(ends[0][c], ends[1][c]) for c in cuts])
    count = Counter(x for one in links for x in one)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*r[:3], r[2], r[3], sum(count[x] == most[x[1]] for x in one), sum(count[x] for x in one)) for r, one in zip(rows, links)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_equals_whole_text_encoding(spark, tool):
    texts = [t for t in nasty_texts() if t is None or len(t) < 3000] + WIDE + [" ".join(prose(k, 40)) for k in range(20)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A_PATH, B_PATH).collect()}
    assert got == dict(enumerate(brute(tool, texts)))
    assert got[texts.index("▁mark")] == (0, 0, 0, 0, "", 0, 0)


def test_units_are_encoded_as_in_the_whole_text(tool):
    """Ids and cuts of units laid end to end, without the corpus."""
    import random

    r = random.Random(5)
    marks = [" ", "  ", "\n", "\t", " ", "　", "\r", "a", "Z", "é", "漢", "🧿", "9", ".", "'s", "-", "\u0085", "\x1c", "▂"]
    texts = ["".join(r.choice(marks) for _ in range(r.randrange(1, 30))) for _ in range(4000)]
    rows, *_ = alignment.aligned_block(pa.array(texts), tool)
    want = brute(tool, texts)
    got = list(zip(rows["n_a"].tolist(), rows["n_b"].tolist(), rows["n_groups"].tolist(), rows["n_links"].tolist(), rows["groups_sha256"]))
    assert got == [w[:5] for w in want]


def test_slices_of_a_column(tool):
    texts = [" ".join(prose(k, 9)) + " é, x" for k in range(40)] + WIDE
    for kind in (pa.string(), pa.large_string()):
        column, want = pa.array(texts, kind), brute(tool, texts)
        for start in range(0, len(texts), 9):
            rows, *_ = alignment.aligned_block(column.slice(start, 4), tool)
            assert list(zip(rows["n_a"].tolist(), rows["n_b"].tolist(), rows["n_groups"].tolist(), rows["groups_sha256"])) == [
                (*w[:3], w[4]) for w in want[start:start + 4]]


def align(tool, unit):
    return tool.align(unit, tool.b.encode(alignment.b_text(unit), return_type="proto").pieces)


def test_refinement_inside_characters(tool):
    found = tool.b_tokens(" \U0001f9ff", " \U0001f9ff".encode(), tool.b.encode("\U0001f9ff", return_type="proto").pieces)
    assert found[1] == [1, 2, 3, 4, 5]
    assert tool.a_tokens("x漢", "x漢".encode())[1] == [1, 2, 3, 4]
    assert alignment.refined([1, 4, 4, 4], [False, True, True, False], [1, 1, 1, 1]) == [1, 2, 3, 4]


def test_units_without_a_space_stand_behind_a_guard(tool):
    assert align(tool, ",")[:2] == align(tool, "Word")[:2] == (1, 1) and align(tool, "\n")[:2] == (1, 1)
    assert tool.cuts[ord("a"), ord(",")] and not tool.cuts[ord("n"), ord("'")] and not tool.cuts[ord("'"), ord("t")]
    assert not tool.cuts[ord("\n"), ord("a")] and tool.cuts[ord("a"), ord("\n")] and not tool.cuts[ord(";"), ord("\r")]


def test_memory_turns_over(tool, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    words = [f" q{i}" for i in range(40)]
    first = [tool.records([w])[0] for w in words]
    assert [tool.records([w])[0] for w in words] == first == [align(tool, w) for w in words]
    assert len(tool.known) <= 7


def test_units_of_a_few_blocks_are_remembered(tool, monkeypatch):
    """A block of real text has some 125,000 different units."""
    asked = []
    monkeypatch.setattr(tool, "known", {})
    monkeypatch.setattr(tool, "before", {})
    monkeypatch.setattr(tool, "b", type("B", (), {"encode": lambda _, texts, **more: [type("P", (), {"pieces": ()})] * len(texts)})())
    monkeypatch.setattr(tool, "align", lambda unit, _: asked.append(unit) or (0, 0, unit, b""))
    blocks = [[f" {k}x{i}" for i in range(60_000)] for k in range(4)]
    for units in [*blocks, *blocks[:2]]:
        assert [r[2] for r in tool.records(units)] == units
    assert len(asked) == 240_000


def test_nasty_empty_and_clashing(spark):
    out = alignment.align(nasty_docs(spark), A_PATH, B_PATH)
    assert out.count() == 20
    assert rows_of(out.where("n_a = 0"), "n_b", "groups_sha256") == [(0, "")] * out.where("n_a = 0").count()
    assert alignment.align(empty_docs(spark), A_PATH, B_PATH).count() == 0
    kept = alignment.align(nasty_docs(spark).selectExpr("doc_id", "digest as pair", "label as block", "text"), A_PATH, B_PATH,
                           keep=["doc_id", "pair", "block"])
    assert kept.columns[:3] == ["doc_id", "pair", "block"] and kept.count() == 20
