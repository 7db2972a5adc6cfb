"""Document scores by masked pseudo-likelihood of a bidirectional window network, trained in numpy.

Every word is predicted from the ``WINDOW`` words on either side of it, with the
word itself masked. Words (A-Z lower-cased, runs of digits, ASCII letters and
characters beyond ASCII) fall into ``CLASSES * CLASSES`` kinds by their hash. The
network gives the probability of the word's kind: the context words' vectors (one
table per place) are summed through a tanh into class scores and, within the
class, kind scores. The word's share of its kind comes from the corpus's own
vocabulary, counted as a distributed table of a row a distinct word: n(word) /
(words of the kind + distinct words of the kind); what is left is the probability
of a word that the corpus doesn't hold (Witten-Bell). A document's score is the
sum of the conditional log-probabilities of all its words.

The words of the corpus are taken once and written in blocks of a step of text:
distinct 64-bit hashes, their counts, and each word's place among them. Vocabulary,
training and scores come from the blocks. In each of ``ROUNDS`` rounds every task
trains a copy of the network on its share of that round's documents (each document
belongs to one round, by a hash of its words) and the copies are averaged, weighted
by words, in a tree of shuffles of at most ``FAN`` copies a group. A word stands
once in a block, however often it occurs, so no word is a hot key where counts are
joined back. What is gathered grows with the input, a task holds a network and a
few blocks, and the driver sees one averaged network a round and ``CLASSES *
CLASSES`` totals.

Defined results: a null or wordless text has no words and log-probability 0; a
context beyond the text's ends is a padding word; a text of any length is one row
of one block; an empty table trains nothing and scores nothing. Repeated rows get
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from .common import bucketed, col, drop, ready, small_batches, steps, with_uid, written
from .words import U64, mix, words

CLASSES = 64
WINDOW = 2
WIDTH = 16
ROUNDS = 2
BATCH = 16_384
RATE = 0.1
FAN = 64
#: Bytes of text whose words make a block, and rows that are looked at for it: a word counts once in a larger block.
BLOCK_BYTES = 8 << 20
TEXT_ROWS = 4096
#: Blocks that a Python worker is handed at a time.
BLOCK_ROWS = 2
_CHUNK = 8192
_V = CLASSES * CLASSES
_BITS = _V.bit_length() - 1


@dataclass
class Network:
    """Parameters as one flat vector with views on it."""

    flat: np.ndarray

    def __post_init__(self):
        at, shapes = 0, {"place": (2 * WINDOW, _V + 1, WIDTH), "hidden": (WIDTH,), "to_class": (WIDTH, CLASSES),
                         "class_bias": (CLASSES,), "to_word": (CLASSES, WIDTH, CLASSES), "word_bias": (CLASSES, CLASSES)}
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + n].reshape(shape))
            at += n
        assert at == len(self.flat)

    @staticmethod
    def size() -> int:
        return (2 * WINDOW * (_V + 1) * WIDTH + WIDTH + WIDTH * CLASSES + CLASSES + CLASSES * WIDTH * CLASSES + _V)

    @staticmethod
    def start(counts: np.ndarray, seed: int = 0) -> Network:
        """Small random vectors; output biases say what the ids' counts say."""
        net = Network(np.random.default_rng(seed).normal(0, 0.1, Network.size()).astype(np.float32))
        p = np.log((counts + 0.5).reshape(CLASSES, CLASSES))
        total = np.log(np.exp(p).sum(1))
        net.hidden[:] = 0
        net.class_bias[:] = total - np.log(np.exp(total).sum())
        net.word_bias[:] = p - total[:, None]
        return net


@dataclass
class Model:
    """The network, the corpus's vocabulary (word, n) and, for each kind, its words and its distinct words."""

    net: Network
    vocabulary: DataFrame
    totals: np.ndarray
    distinct: np.ndarray


def contexts(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ids around each (padding beyond a row's ends), one line a place."""
    around = np.full((2 * WINDOW, len(ids)), _V, dtype=np.int64)
    for line, k in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        n = len(ids) - abs(k)
        if n <= 0:
            continue
        to, of = (slice(-k, None), slice(0, n)) if k < 0 else (slice(0, n), slice(k, None))
        around[line, to] = np.where(rows[to] == rows[of], ids[of], _V)
    return around


def kinds(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - _BITS)).astype(np.int64)


def ids_and_contexts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of all words, their rows, and the kinds around each."""
    w = words(texts, "plain")
    ids, rows = kinds(w.hashes), w.rows()
    return ids, rows, contexts(ids, rows)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, the log-probability of one place."""
    most = x.max(1)
    return x[np.arange(len(x)), at] - most - np.log(np.exp(x - most[:, None]).sum(1))


def _hidden(net: Network, around: np.ndarray) -> np.ndarray:
    total = net.hidden + net.place[0][around[0]]
    for k in range(1, len(around)):
        total += net.place[k][around[k]]
    return np.tanh(total)


def log_probabilities(net: Network, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each id given those around it."""
    out = np.empty(len(ids))
    for i in range(0, len(ids), BATCH):
        part, h = ids[i:i + BATCH], _hidden(net, around[:, i:i + BATCH])
        c, word = part // CLASSES, part % CLASSES
        order = np.argsort(c, kind="stable")
        ends = np.searchsorted(c[order], np.arange(CLASSES + 1))
        p = _log_softmax_at(h @ net.to_class + net.class_bias, c)
        for k in range(CLASSES):
            at = order[ends[k]:ends[k + 1]]
            if len(at):
                p[at] += _log_softmax_at(h[at] @ net.to_word[k] + net.word_bias[k], word[at])
        out[i:i + BATCH] = p
    return out


def _gradient(net: Network, ids: np.ndarray, around: np.ndarray) -> Network:
    """Gradient of the mean log-loss."""
    grad = Network(np.zeros_like(net.flat))
    n = len(ids)
    h = _hidden(net, around)
    c, word = ids // CLASSES, ids % CLASSES
    d = _softmax(h @ net.to_class + net.class_bias)
    d[np.arange(n), c] -= 1
    grad.to_class[:], grad.class_bias[:] = h.T @ d / n, d.mean(0)
    dh = d @ net.to_class.T
    order = np.argsort(c, kind="stable")
    ends = np.searchsorted(c[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        at = order[ends[k]:ends[k + 1]]
        if len(at):
            hk = h[at]
            d = _softmax(hk @ net.to_word[k] + net.word_bias[k])
            d[np.arange(len(at)), word[at]] -= 1
            grad.to_word[k], grad.word_bias[k] = hk.T @ d / n, d.sum(0) / n
            dh[at] += d @ net.to_word[k].T
    dh *= (1 - h * h) / n
    grad.hidden[:] = dh.sum(0)
    each = np.ascontiguousarray(dh.T, dtype=np.float64)
    for place in range(len(around)):
        for j in range(WIDTH):
            grad.place[place][:, j] = np.bincount(around[place], weights=each[j], minlength=_V + 1)
    return grad


def train(net: Network, squares: np.ndarray, ids: np.ndarray, around: np.ndarray, rate: float = RATE) -> None:
    """One pass of Adagrad steps over the given words; ``squares`` holds the sums of squared gradients."""
    for i in range(0, len(ids), BATCH):
        g = _gradient(net, ids[i:i + BATCH], around[:, i:i + BATCH]).flat
        squares += g * g
        net.flat -= rate * g / (np.sqrt(squares) + 1e-8)


def word_log_shares(n: np.ndarray, totals: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Log-probability of words within their kinds, by their counts and the kinds' totals; 0 counts as unseen."""
    unseen = np.maximum(distinct, 1)
    return np.log(np.where(n > 0, n, unseen) / (totals + unseen))


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _place_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, size=BLOCK_BYTES):
        w = words(col(b, "text"), "plain")
        coded = pa.array(w.hashes).dictionary_encode()
        found, places = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        docs = pa.StructArray.from_arrays([col(b, "_in"), pa.array(w.counts, pa.int64())], ["_in", "_words"])
        yield pa.RecordBatch.from_arrays(
            [_one(docs), _one(pa.array(found.view(np.int64))), _one(pa.array(np.bincount(places, minlength=len(found)), pa.int64())),
             pa.array([places.astype(_place_type(len(found))).tobytes()], pa.binary())], ["docs", "words", "counts", "places"])


def word_blocks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Words of all ``docs``, a row a block: ``docs`` (the ``keep`` columns and the number of words of each), ``words``
    (distinct hashes), ``counts`` and ``places`` (each word's place among them, document after document)."""
    spark = ready(docs.sparkSession)
    named = docs.select(F.struct(*keep).alias("_in"), F.col("text").cast("string").alias("text"))
    doc = StructType([named.schema["_in"], StructField("_words", LongType())])
    schema = StructType([StructField("docs", ArrayType(doc)), StructField("words", ArrayType(LongType())),
                         StructField("counts", ArrayType(LongType())), StructField("places", BinaryType())])
    return bucketed(with_uid(named.mapInArrow(_blocks, schema), "block"), "words", "block",
                    int(spark.conf.get("spark.sql.shuffle.partitions")), TEXT_ROWS)


def _of_block(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a block, the place of each of its words among them, and the words' documents."""
    found = col(b, "words")[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    sizes = col(b, "sizes")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
    body = col(b, "places")[i].as_py()
    places = np.frombuffer(body, dtype=_place_type(len(found))) if body else np.zeros(0, dtype=np.int64)
    return found, places, np.repeat(np.arange(len(sizes)), sizes)


def rounds_of(found: np.ndarray, places: np.ndarray, rows: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """The round of each of n documents, by its words, wherever it lies."""
    marks = np.zeros(len(places) + 1, dtype=U64)
    np.cumsum(mix(found + U64(1))[places], out=marks[1:])
    ends = np.searchsorted(rows, np.arange(n), side="right")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return (mix(marks[ends] - marks[starts] + (ends - starts).astype(U64)) >> U64(33)) % U64(rounds)


def _train(net, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares, seen = Network(net.value.copy()), np.zeros(Network.size(), dtype=np.float32), 0
        held, many = [], 0

        def step():
            nonlocal seen
            ids, around = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], axis=1)
            train(own, squares, ids, around)
            seen += len(ids)

        for b in batches:
            for i in range(b.num_rows):
                found, places, rows = _of_block(b, i)
                mine = (rounds_of(found, places, rows, len(col(b, "sizes")[i]), rounds) == turn)[rows]
                ids = kinds(found)[places[mine]]
                held.append((ids, contexts(ids, rows[mine])))
                many += len(ids)
                if many >= BATCH:
                    step()
                    held, many = [], 0
        if many:
            step()
        if seen:
            for k, i in enumerate(range(0, len(own.flat), _CHUNK)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([float(seen)]), pa.array([own.flat[i:i + _CHUNK].tobytes()], pa.binary())],
                    ["chunk", "weight", "body"])

    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    weight = rows["weight"].to_numpy()
    total = np.zeros(len(rows["body"].iloc[0]) // 4)
    for w, body in zip(weight, rows["body"]):
        total += w * np.frombuffer(body, dtype=np.float32)
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1] // FAN, "weight": [weight.sum()],
                         "body": [(total / weight.sum()).astype(np.float32).tobytes()]})


def fit(docs: DataFrame, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """The model of all of ``docs``."""
    blocks = word_blocks(docs.select(F.lit(0).alias("none"), "text"), ["none"])
    model = fit_blocks(blocks, rounds, seed)
    drop(blocks)
    return model


def fit_blocks(blocks: DataFrame, rounds: int = ROUNDS, seed: int = 0) -> Model:
    spark = blocks.sparkSession
    vocabulary = written(blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(
        F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n")), "vocabulary")
    totals, distinct = np.zeros(_V, dtype=np.int64), np.zeros(_V, dtype=np.int64)
    for r in vocabulary.groupBy(F.shiftrightunsigned("word", 64 - _BITS).alias("id")).agg(
            F.sum("n").alias("n"), F.count("*").alias("distinct")).collect():  # _V rows at most
        totals[r.id], distinct[r.id] = r.n, r.distinct
    net = Network.start(totals, seed)
    given = blocks.select("words", "places", F.col("docs._words").alias("sizes"))
    for turn in range(rounds):
        copies = (given.mapInArrow(_train(spark.sparkContext.broadcast(net.flat), turn, rounds),
                                   "chunk long, weight double, body binary")
                  .withColumn("part", F.spark_partition_id().cast("long")))
        with small_batches(spark, BLOCK_ROWS):
            of_tasks = copies = written(copies, "networks")
        most = copies.agg(F.max("part")).first()[0]
        if most is None:
            drop(of_tasks)
            continue
        while True:
            copies = copies.withColumn("of", F.expr(f"part div {FAN}")).groupBy("chunk", "of").applyInPandas(
                lambda rows: _average(rows), "chunk long, part long, weight double, body binary")
            most //= FAN
            if most == 0:
                break
        chunks = {r.chunk: np.frombuffer(r.body, dtype=np.float32) for r in copies.collect()}  # one network
        net = Network(np.concatenate([chunks[k] for k in sorted(chunks)]))
        drop(of_tasks)
    return Model(net, vocabulary, totals, distinct)


def _score(net, totals, distinct):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(net.value)
        for b in batches:
            for i in range(b.num_rows):
                found, places, rows = _of_block(b, i)
                id_of, n = kinds(found), np.zeros(len(found), dtype=np.int64)
                seen = col(b, "seen")[i].values
                if seen is not None and len(seen):
                    n[seen.field("at").to_numpy()] = seen.field("n").to_numpy()
                shares = word_log_shares(n, totals.value[id_of], distinct.value[id_of])
                ids, docs = id_of[places], col(b, "docs")[i].values
                p = log_probabilities(own, ids, contexts(ids, rows)) + shares[places]
                yield pa.RecordBatch.from_arrays(
                    [docs.field("_in"), docs.field("_words"),
                     pa.array(np.bincount(rows, weights=p, minlength=len(docs)), pa.float64())], ["_in", "n_words", "log_prob"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (``doc_id`` by default), n_words and log_prob of every document."""
    blocks = word_blocks(docs, keep or ["doc_id"])
    out = score_blocks(blocks, model)
    drop(blocks)
    return out


def score_blocks(blocks: DataFrame, model: Model) -> DataFrame:
    spark = blocks.sparkSession
    send = spark.sparkContext.broadcast
    own = blocks.select("block", F.posexplode("words").alias("at", "word"))
    seen = written(own.join(model.vocabulary, "word").groupBy("block").agg(
        F.collect_list(F.struct("at", "n")).alias("seen")), "seen")
    told = blocks.select("block", "docs", "words", "places", F.col("docs._words").alias("sizes")).join(seen, "block", "left")
    of_doc = blocks.schema["docs"].dataType.elementType["_in"]
    schema = StructType([of_doc, StructField("n_words", LongType()), StructField("log_prob", DoubleType())])
    with small_batches(spark, BLOCK_ROWS):
        out = written(told.drop("block").mapInArrow(
            _score(send(model.net.flat), send(model.totals), send(model.distinct)), schema), "scores")
    drop(seen)
    return out.select("_in.*", "n_words", "log_prob")


def fitted_scores(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``score`` of ``docs`` by the model of ``docs``, from the same blocks."""
    blocks = word_blocks(docs, keep or ["doc_id"])
    model = fit_blocks(blocks)
    out = score_blocks(blocks, model)
    drop(blocks, model.vocabulary)
    return out
