"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Each document becomes bags of hashed n-grams: its blank-separated words, its
plain words (see ``words``), its runs of ASCII punctuation, and whether each
plain word repeats the one before. Two generative models are counted over the
fitting sample: the target (documents labelled good and not toxic) and the raw
text (all labelled documents as they come). A segment's importance is the
summed log ratio of the two models over ``segment`` words; a document weighs as
little as its worst segment, so a few insults aren't outvoted by a long clean
rest. The least of many segments is low by chance, so what clean text of as many
segments loses is given back: ``drift`` times the log of their number, fitted on
held-out clean documents (the least of n draws from an exponential tail falls by
the log of n). Documents are then resampled without replacement: log weight plus Gumbel
noise (scaled by ``temperature``), top k. k is what a cut-off, chosen on
held-out labelled documents, lets through.

Bounds: fitting takes at most ``SAMPLE`` labelled documents (the smallest hashes
of doc_id; two thirds count, one third calibrates); their ids, the models
(``2**BITS`` buckets) and two histograms of 65,536 counts are all that the
driver sees. Scoring and selection cover all rows and all text.

Defined results: null, empty or wordless texts have weight 0; label rows with a
null are ignored, several rows of one doc_id count as their worst; of documents
with one doc_id, one text is counted and one weight calibrates; without both
good and bad labels everything is kept; rows tied at the k-th place all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, col, ready, steps, unboxed, written
from .words import RULES, U64, mix, words

BITS = 20
SEGMENT = 24
PRIOR = 1.0
TEMPERATURE = 0.25
SAMPLE = 60_000
_BLOCK_BITS = 12
#: A clean document lost weighs as much as so many bad ones kept, when the cut-off is chosen.
CLEAN_WEIGHT = 2.0


def _marks_rule() -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(256, dtype=bool)
    for a, b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
        inside[a:b] = True
    return inside, np.arange(256, dtype=np.uint8)


RULES.setdefault("marks", _marks_rule())


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its buckets, the row of each and its place in the row."""
    out = []
    for salt, rule in enumerate(("blank", "plain", "marks")):
        w = words(texts, rule)
        rows = w.rows()
        place = np.arange(len(rows)) - w.offsets[rows]
        out.append(((mix(w.hashes + U64(salt + 1)) >> U64(64 - BITS)).astype(np.int64), rows, place))
        if rule == "plain":
            again = np.zeros(len(rows), dtype=np.int64)
            again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (place[1:] > 0)
            out.append((again, rows, place))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    good = np.zeros(1 << BITS, dtype=np.int64)
    every = np.zeros(1 << BITS, dtype=np.int64)
    for b in steps(batches):
        is_good = col(b, "good").to_numpy(zero_copy_only=False).astype(bool)
        for bucket, rows, _ in features(col(b, "text")):
            every += np.bincount(bucket, minlength=1 << BITS)
            good += np.bincount(bucket[is_good[rows]], minlength=1 << BITS)
    at = np.flatnonzero(every)
    for i in range(0, len(at), 50_000):
        part = at[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(good[part]), pa.array(every[part])],
                                         ["bucket", "good", "every"])


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of consecutive buckets as one value, so few rows go to the driver."""
    counts = np.zeros((2, 1 << _BLOCK_BITS), dtype=np.int64)
    block = int(rows["bucket"].iloc[0]) >> _BLOCK_BITS
    counts[:, rows["bucket"].to_numpy() - (block << _BLOCK_BITS)] = rows[["good", "every"]].to_numpy().T
    return pd.DataFrame({"block": [block], "counts": [counts.tobytes()]})


def log_ratio(good: np.ndarray, every: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(target probability / raw probability) of each bucket, shrunk to 0 where there is little to count."""
    share = good.sum() / max(1, every.sum())
    return np.log((good + prior * share) / ((every + prior) * share)).astype(np.float32)


def weigh(texts: pa.Array, ratio: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The smallest summed log ratio of each row's segments."""
    return worst_segments(texts, ratio, segment)[0]


def worst_segments(texts: pa.Array, ratio: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """``weigh`` of each row, and its number of segments."""
    kinds = features(texts)
    n = np.ones(len(texts), dtype=np.int64)
    for _, rows, place in kinds:
        if len(rows):
            np.maximum(n, np.bincount(rows, minlength=len(texts)) // segment + 1, out=n)
    first = np.concatenate([[0], np.cumsum(n)])
    total = np.zeros(first[-1])
    for bucket, rows, place in kinds:
        total += np.bincount(first[rows] + place // segment, weights=ratio[bucket], minlength=len(total))
    # a segment past the end of the text has no n-grams and sums to 0: it isn't the worst one unless all are better
    used = np.zeros(len(total), dtype=bool)
    for _, rows, place in kinds:
        used[first[rows] + place // segment] = True
    total[~used] = np.inf
    worst = np.minimum.reduceat(total, first[:-1]) if len(texts) else total
    return np.where(np.isfinite(worst), worst, 0.0), n


def drift(worst: np.ndarray, segments: np.ndarray) -> float:
    """By how much clean documents' worst segments fall with the log of the number of segments; 0 if they don't."""
    x = np.log(segments)
    if len(x) < 2 or not np.ptp(x):
        return 0.0
    return max(0.0, -float(np.polyfit(x, worst, 1)[0]))


def _weigh(ratio, segment: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            worst, n = worst_segments(col(b, "text"), ratio.value, segment)
            yield pa.RecordBatch.from_arrays(
                [*(col(b, c) for c in keep), pa.array(worst, pa.float64()), pa.array(n, pa.int64())],
                [*keep, "_worst", "_segments"])

    return run


def labelled(labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` labelled ids: doc_id, good, held (a third is held out for the cut-off)."""
    h = F.xxhash64("doc_id", F.lit(9))
    return (labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
            .agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
            .orderBy(h, "doc_id").limit(limit)
            .select("doc_id", "good", (F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(3)) == 0).alias("held")))


def fit(docs: DataFrame, sample: DataFrame, prior: float = PRIOR) -> np.ndarray:
    """Log ratio of the two models by bucket. ``sample`` (bounded) is the side that is broadcast."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # one text a labelled id, however many rows share it
    fitted = (texts.join(F.broadcast(sample.where("not held")), "doc_id").groupBy("doc_id", "good")
              .agg(F.min("text").alias("text")).select("text", "good"))
    sums = (fitted.mapInArrow(_count, "bucket long, good long, every long").groupBy("bucket")
            .agg(F.sum("good").alias("good"), F.sum("every").alias("every"))
            .groupBy(F.shiftright("bucket", _BLOCK_BITS).alias("block")).applyInPandas(_block, "block long, counts binary"))
    good, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in sums.collect():  # 2**(BITS - _BLOCK_BITS) rows at most
        at = slice(r.block << _BLOCK_BITS, (r.block + 1) << _BLOCK_BITS)
        good[at], every[at] = np.frombuffer(r.counts, dtype=np.int64).reshape(2, -1)
    if not good.any() or (good == every).all():
        return np.zeros(1 << BITS, dtype=np.float32)
    return log_ratio(good, every, prior)


def gumbel(temperature: float = TEMPERATURE, seed: int = 0) -> F.Column:
    """log_weight plus Gumbel noise drawn from a hash of the row, the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "log_weight", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return (F.col("log_weight") - temperature * F.log(-F.log(u))).cast("float")


def _key(score: F.Column) -> F.Column:
    """The score in steps of 1/65536 as a number from 0 to 2**32 - 1."""
    return F.floor((F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), score)) + 32768.0) * 65536.0).cast("long")


def _place(counts: dict[int, int], k: int) -> tuple[int, int]:
    """The bin that holds the k-th largest, and how many lie in the bins above it."""
    above = 0
    for b in sorted(counts, reverse=True):
        if above + counts[b] >= k:
            return b, above
        above += counts[b]
    return -1, above


def top_k(scored: DataFrame, k: int) -> F.Column:
    """Whether ``score`` is among the k largest, by two histograms of 65,536 bins; no sort, no rows to the driver."""
    if k <= 0:
        return F.lit(False)
    high = F.shiftright("key", 16)
    keys = scored.select(_key(F.col("score")).alias("key"))
    bins = {r[0]: r[1] for r in keys.groupBy(high.alias("h")).count().collect()}
    at, above = _place(bins, k)
    low = keys.where(high == at).groupBy(F.col("key").bitwiseAND(F.lit(65535)).alias("l")).count().collect()
    rest, _ = _place({r[0]: r[1] for r in low}, k - above)
    return _key(F.col("score")) >= (at * 65536 + rest if at >= 0 else 0)


def cut_off(held: np.ndarray, good: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> float:
    """The score that best parts good from bad held-out documents; -inf if either is missing."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(held, kind="stable")
    x, g = held[order], good[order].astype(float)
    lost = np.concatenate([[0.0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0.0], np.cumsum(1 - g)]) / (1 - g).sum()
    edge = np.concatenate([[True], x[1:] > x[:-1], [True]])  # a cut never parts equal scores
    at = int(np.argmax(np.where(edge, caught - clean_weight * lost, -np.inf)))
    if at == 0:
        return float("-inf")
    return float((x[at - 1] + x[at]) / 2) if at < len(x) else float("inf")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE,
             sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """A row per document: the ``keep`` columns (``doc_id`` by default), log_weight, score and kept.

    ``k`` documents are kept; None: as many as score above the cut-off.
    """
    spark = ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    known = written(labelled(labels, sample), "labelled")
    ratio = spark.sparkContext.broadcast(fit(docs, known))

    def weights(columns: list[str]) -> DataFrame:
        schema = docs.select(*columns).schema.simpleString()[len("struct<"):-1]
        named = docs.select(*columns, *[F.col("text").cast("string").alias("text")] * ("text" not in columns))
        return named.mapInArrow(_weigh(ratio, SEGMENT, columns), f"{schema}, _worst double, _segments long")

    weighed = written(weights(["doc_id"]), "weighed")
    held = (weighed.join(F.broadcast(known.where("held")), "doc_id").groupBy("doc_id", "good")
            .agg(F.min(F.struct("_worst", "_segments")).alias("row")).select("doc_id", "good", "row.*"))
    clean = held.where("good").select("_worst", "_segments").toPandas()
    by = drift(clean["_worst"].to_numpy(dtype=float), clean["_segments"].to_numpy(dtype=float))

    def with_score(df: DataFrame) -> DataFrame:
        return (df.withColumn("log_weight", F.col("_worst") + F.lit(by) * F.log("_segments"))
                .withColumn("score", gumbel(temperature)))

    scored = with_score(weighed).drop("_worst", "_segments")
    if k is None:
        seen = with_score(held).select("score", "good").toPandas()
        cut = cut_off(seen["score"].to_numpy(dtype=float), seen["good"].to_numpy(dtype=bool))
        k = scored.where(F.col("score") >= F.lit(cut)).count()
    kept = top_k(scored, k)
    if keep != ["doc_id"]:  # weighed once more instead of being written with all their columns
        scored = with_score(weights(keep)).drop("_worst", "_segments")
    return scored.withColumn("kept", kept)


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that resampling keeps, with all their columns."""
    box = docs.select(*boxed(docs)).select("_in", "text", "_in.doc_id")
    return unboxed(resample(box, labels, keep=["_in", "text", "doc_id"]).where("kept"), docs.columns)
