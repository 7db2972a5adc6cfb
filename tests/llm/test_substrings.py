"""Substring dedup against every window compared in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from quire.llm import substrings
from quire.llm.words import words

from .helpers import blank_words, empty_docs, nasty_docs, nasty_texts, prose


def brute(texts, window):
    split = [blank_words(t) for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return out


def check(spark, texts, window, parts=5):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    got = {r[0]: tuple(r[1:]) for r in substrings.cut_repeats(docs, window, with_text=True).collect()}
    assert got == dict(enumerate(brute(texts, window)))
    return got


def passages():
    """Shared passages at any place, long copies, near copies, edges shared by some copies only, periodic texts."""
    r = random.Random(3)
    shared = [prose(100 + k, n) for k, n in enumerate((34, 35, 36, 52, 53, 70, 120, 400))]
    texts = []
    for k in range(60):
        own = prose(1000 + k, r.randrange(0, 90))
        for _ in range(r.randrange(3)):
            p = r.choice(shared)
            cut = p[r.randrange(0, 5) * r.randrange(2):len(p) - r.randrange(0, 5) * r.randrange(2)]
            at = r.randrange(len(own) + 1)
            own = own[:at] + cut + own[at:]
        texts.append(r.choice([" ", "\n", "\t \x0b"]).join(own))
    whole = prose(7, 500)
    for k in range(6):
        copy = list(whole)
        copy[50 * k + 20] = f"edit{k}"
        texts.append(" ".join(copy))
    return texts + [" ".join(whole), " ".join(whole), "a " * 200, "a b " * 60, "a " * 36, "x y z " * 12, " ".join(prose(8, 40) * 3)]


def test_equals_brute_force(spark):
    got = check(spark, passages() + [t for t in nasty_texts() if t is None or len(t) < 100_000], 35)
    assert 10 < sum(n > 0 for _, n, _, _ in got.values()) < len(got)


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_small_windows(spark, window):
    r = random.Random(window)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(25))) for _ in range(40)]
    check(spark, texts, window, 3)


def test_one_passage_in_all_documents_many_tasks(spark):
    passage = prose(5, 60)
    texts = [" ".join(prose(2000 + k, k % 50) + passage + prose(3000 + k, 7)) for k in range(300)]
    got = check(spark, texts, 35, 16)
    assert all(60 <= v[1] < 75 for v in got.values())


def test_false_anchors_cut_nothing(spark, monkeypatch):
    """Hashes of a few bits make nearly every probe an anchor; spans and windows still decide."""
    monkeypatch.setattr(substrings, "_keys", lambda w, block, buckets: (
        np.zeros(len(w.starts), np.int32), (w.grams(block) % substrings.U64(3)).astype(np.uint32)))
    texts = pa.array([" ".join(prose(1, 80)), " ".join(prose(2, 80))])
    w = words(texts, "blank")
    start, n, anchor = substrings.spans(w, w.full(18), 35)
    assert n.sum() == 2 * (80 - 34) and len(set(substrings.run_hash(substrings._prefix(w), start, n + 34).tolist())) == len(start)


def test_slices_of_a_column():
    texts = [" ".join(prose(k, 12)) for k in range(30)]
    column = pa.array(texts)
    for start in range(0, 30, 7):
        w = words(column.slice(start, 3), "blank")
        body, bounds = substrings.joined_words(w, np.ones(len(w.starts), dtype=bool))
        assert [body[s:e].tobytes().decode() for s, e in zip(bounds, bounds[1:])] == [t + " " for t in texts[start:start + 3]]


def test_packed_places_round_trip():
    r = np.random.default_rng(0)
    rows = [np.sort(r.integers(0, 16384, k)) for k in (1, 5, 400, 2)] + [np.array([0, 0, 255, 510, 16383])]
    begins = np.cumsum([0, *(len(x) for x in rows[:-1])])
    body, at = substrings.packed_places(np.concatenate(rows), begins)
    assert [substrings.unpacked_places(body[s:e].tobytes()).tolist() for s, e in zip(at, at[1:])] == [x.tolist() for x in rows]


def test_bucket_tells_all_probes_of_a_block_hit_twice():
    bucket = substrings.Bucket()
    bucket.add(np.array([5, 9], np.uint32))
    bucket.add(np.array([9, 12], np.uint32))
    told = []
    for h, u in (([5, 7], [1, 1]), ([9, 9, 12], [2, 3, 3]), ([5], [4]), ([12, 9], [3, 9])):
        uids, found = bucket.probe(np.array(h, np.uint32), np.array(u))
        told += zip(found.tolist(), uids.tolist())
    assert sorted(told) == [(5, 1), (5, 4), (9, 2), (9, 3), (9, 9), (12, 3), (12, 3)]


def test_nasty_empty_and_clashing(spark):
    out = substrings.cut_repeats(nasty_docs(spark), keep=["doc_id", "label", "hash", "uid", "place"])
    assert out.columns[:5] == ["doc_id", "label", "hash", "uid", "place"] and out.count() == 20
    assert substrings.cut_repeats(empty_docs(spark)).count() == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Joins on the bucketed texts exchange their other side alone."""
    from quire.llm import common

    with common.co_located(spark):
        texts = common.bucketed(spark.range(1000).selectExpr("id as uid", "shiftright(id, 6) as chunk", "'x' as text"), "t", "chunk", 4)
        side = spark.range(1000).selectExpr("id as uid", "1 as hits").groupBy("uid").count().selectExpr("uid", "shiftright(uid, 6) as chunk", "count")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = texts.join(side, ["chunk", "uid"])._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text_side = plan[plan.index("SortMergeJoin"):plan.index("Scan parquet")]
    assert "Bucketed: true" in plan and "Exchange" not in text_side, plan
