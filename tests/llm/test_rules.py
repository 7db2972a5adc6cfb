import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import rules as R

from .helpers import blank_words, empty_docs, labels, nasty_docs, nasty_texts, prose, rows_of


def brute(text):
    w, seen, dup = blank_words(text), set(), 0
    for line in (text or "").split("\n"):
        if blank_words(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def repeated():
    a = prose(5, 30)
    return [" ".join(a + a[:8] + prose(6, 40)), " ".join(a[:9] * 5), "\n".join(["a b", "a b ", "a b", "", "", "\t", "\t", "c"] * 3),
            "# $ | <> && %%% ** x\n" * 4, " ".join(prose(7, 200, vocabulary=2))]


def test_statistics_against_brute_force(spark):
    docs = nasty_docs(spark, repeated())
    got = rows_of(R.statistics(docs).withColumn("b", R.base_failed()), "doc_id", *R.COUNTS[:5], "b")
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)


def test_counts_of_slices():
    a = pa.array([*nasty_texts(), *repeated()], pa.string())
    whole, part = R.counts(a), R.counts(a.slice(5, 9))
    assert all((whole[c][5:14] == part[c]).all() for c in R.COUNTS)


def test_learns_planted_rules():
    r = np.random.default_rng(0)
    x = r.random((6000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] <= 0.5)) | (x[:, 2] > 0.9)
    prune = r.random(6000) < 1 / 3
    found = R.learn(x, bad, ["a", "b", "c"], prune)
    said = np.zeros(6000, dtype=bool)
    for rule in found:
        said |= R.covered(rule, x, ["a", "b", "c"])
    assert (said == bad).mean() > 0.95 and len(found) >= 2 and all(1 <= len(rule) <= R.MOST_CONDITIONS for rule in found)
    assert R.learn(x[:0], bad[:0], ["a", "b", "c"], prune[:0]) == [] and R.learn(x, ~bad & bad, ["a", "b", "c"], prune) == []


def test_expression_says_what_the_rules_say(spark):
    stats = R.statistics(nasty_docs(spark, repeated() * 3))
    rules = [(R.Condition("symbols_per_word", True, 0.2), R.Condition("n_words", False, 100.0)), (R.Condition("word_length", True, 4.0),)]
    names = list(R.measures())
    rows = stats.select(*(c.alias(k) for k, c in R.measures().items()), R.base_failed().alias("b"), R.verdict(rules).alias("v")).collect()
    for r in rows:
        x = np.array([[r[k] for k in names]])
        assert r.v == (not r.b and not any(R.covered(rule, x, names)[0] for rule in rules))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)) == 0
    out, rules = R.judged(docs, known.where(~hidden))
    out = out.join(known.where(hidden), "doc_id")
    assert rules
    share = {r[0]: r[1] for r in out.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert share[1] > 0.98 and share[0] < 0.1


@pytest.mark.parametrize("rows", [[], [(0, 1, 0)], [(None, 0, 0), (1, None, 0)], [(11, 0, 0), (11, 1, 0), (12, 1, 0)]])
def test_few_labels_and_empty_tables(spark, rows):
    out, rules = R.judged(nasty_docs(spark), labels(spark, rows))
    assert rules == [] and out.where("kept = base_failed").count() == 0
    assert R.judged(empty_docs(spark), labels(spark, rows))[0].count() == 0


def test_a_repeated_id_comes_to_the_fit_once(spark, monkeypatch):
    from quire.llm import rules

    seen = []
    monkeypatch.setattr(rules, "learn", lambda values, bad, names, prune: seen.append((values.tolist(), bad.tolist(), prune.tolist())) or [])
    docs = spark.createDataFrame([(i, " ".join(f"word{k % (i + 9)}" for k in range(60))) for i in range(20)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    stats = rules.statistics(docs)
    rules.fitted_rules(stats, known)
    rules.fitted_rules(stats.unionByName(stats.where("doc_id < 3").crossJoin(spark.range(50)).drop("id")), known, 20)
    assert seen[0] == seen[1]
