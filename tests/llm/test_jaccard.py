import random
from collections import Counter

import pytest

from quire.llm import jaccard as J

from .helpers import empty_docs, nasty_docs, plain_words, prose, rows_of


def sets(text):
    w = plain_words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, threshold=0.8):
    s = [sets(t) for _, t in docs]
    parent, links = list(range(len(s))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(docs)), key=repr)


def n_classes(texts):
    """Connected classes of the texts that have words."""
    numbered = brute([(i, t) for i, t in enumerate(texts) if sets(t)])
    return len({least for _, least, _ in numbered})


def edited(words, r, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus(groups, seed=7):
    r, out = random.Random(seed), []
    for size, n, edits in groups:
        base = prose(r.randrange(10**6), n)
        for _ in range(size):
            out.append(" ".join(edited(base, r, r.randrange(edits + 1))))
    return out


@pytest.mark.parametrize("block", [96, 7])
def test_classes_and_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = corpus([(60, 150, 5), (25, 200, 12), (3, 30, 1), (2, 100, 1), (1, 80, 0), (1, 300, 0), (12, 40, 2)])
    docs = nasty_docs(spark, texts + texts[:9])
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = rows_of(J.with_class_id(J.join(docs)), "doc_id", "class_id", "n_links")
    # banding reaches its recall of 0.9995 pair by pair; block-wise comparison makes up for nearly all the rest
    assert got == want
    assert max(x[2] for x in want) > 40


def test_banding_reaches_its_recall():
    for recall in (0.9, 0.99, 0.9995):
        bands, rows = J.banding(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        J.banding(0.8, 1 - 1e-300, most=1)


def test_linked_agrees_with_sets_over_many_columns(monkeypatch):
    import numpy as np

    monkeypatch.setattr(J, "_COLUMNS", 8)
    r = random.Random(3)
    s = [sorted(r.sample(range(40), r.randrange(1, 30))) for _ in range(20)]
    b = [np.array(x, dtype=np.uint64).tobytes() for x in s]
    for threshold, rare in ((0.3, 1), (0.8, 1), (0.3, 4), (0.8, 30)):
        monkeypatch.setattr(J, "_RARE", rare)
        own, cross = J.linked(b, None, threshold), J.linked(b[:8], b[8:], threshold)
        for i in range(20):
            for j in range(20):
                v = len(set(s[i]) & set(s[j])) >= threshold * len(set(s[i]) | set(s[j])) - 1e-9
                assert own[i, j] == (v and i != j)
                if i < 8 <= j:
                    assert cross[i, j - 8] == v


def test_spreading_joins_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (300, 200), (300, 250)]
    got = dict(rows_of(J._spread(spark.createDataFrame(edges, "uid long, root long")), "uid", "root"))
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and got[250] == got[300] == got[200] == 200


@pytest.mark.parametrize("block", [1024, 5])
def test_one_of_each_class_stays_with_all_columns(spark, monkeypatch, block):
    docs = nasty_docs(spark, corpus([(10, 100, 1), (40, 60, 2), (30, 90, 9), (2, 50, 1)]))
    monkeypatch.setattr(J, "BLOCK", block)
    left = J.distinct_documents(docs)
    assert left.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    n_wordless = sum(not sets(r.text) for r in docs.collect())
    assert sum(not sets(r.text) for r in left.collect()) == n_wordless >= 4
    assert left.count() < docs.count()
    assert left.count() == n_wordless + n_classes([r.text for r in docs.collect()])
    assert all(x[2] == 0 for x in brute([(r.doc_id, r.text) for r in left.collect()])) and any(x[2] for x in want)


def test_empty(spark):
    assert J.join(empty_docs(spark)).count() == 0
    assert J.distinct_documents(empty_docs(spark)).count() == 0


def test_pairs_of_blocks_are_rows_of_their_own(spark, monkeypatch):
    """No row holds a bucket: every pair is made by a join, for buckets of one block and of many."""
    monkeypatch.setattr(J, "MEET", 4)
    r = random.Random(5)
    buckets = {(b, h): {(r.randrange(3), r.randrange(60)) for _ in range(n)} for b in range(2) for h, n in enumerate((1, 2, 5, 60))}
    buckets[1, 9] = buckets[0, 3]
    met = spark.createDataFrame([(b, h, x, y) for (b, h), own in buckets.items() for x, y in own], "band int, hash long, label long, part long")
    out = J.meeting(met)
    got = [(tuple(p.a), tuple(p.b)) for p in out.collect()]
    assert set(got) == {(x, y) for own in buckets.values() for x in own for y in own if x < y}
    assert dict(out.dtypes) == {"a": "struct<label:bigint,part:bigint>", "b": "struct<label:bigint,part:bigint>"}
    assert "collect_" not in out._jdf.queryExecution().toString()


def test_a_large_group_of_different_copies(spark):
    """20,000 texts, all different and all linked: the pipeline's form compares blocks with themselves and one text of each."""
    base = prose(21, 60)
    texts = []
    for i in range(20_000):
        w = list(base)
        w[-1] = f"end{i}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    assert J.distinct_documents(docs).count() == 1
    some = J.with_class_id(J.join(docs.where("doc_id < 3000")))
    assert some.groupBy("class_id", "n_links").count().collect() == [(0, 2999, 3000)]
