"""Importance resampling towards a target text's distribution, on Arrow kernels.

A step of texts is lower-cased (``ascii_lower``, A-Z only), split at what isn't
part of a word (``split_pattern_regex``), laid end to end (``list_flatten``) and
``dictionary_encode``d. N-grams are shifted dictionary indices; only the distinct
ones are spelled out, joined by one space, and hashed: bucket = CRC-32 of the
UTF-8 bytes modulo ``buckets``. One pass counts buckets of the raw table, one of
the target; a bucket's gain is floor(1000 * ln of the smoothed ratio of its two
shares). A document weighs the floored mean of the gains of its n-grams: a
``take`` of gains by dictionary index, then a sum over each document's segment.

The draw: weight plus Gumbel noise from the document's id, both in thousandths,
and of the documents with ``least`` words the highest ``percent`` per cent. The
integer scores are counted (their range is bounded by their formula), the rows at
or above the last score that fits are sorted by range partitions, and ranks are a
partition's offset plus the place in it: no task sees more than its range.

Bounds: the driver sees two arrays of ``buckets`` counts, a row a distinct score
and a row a partition of the sort. Words and texts are looked at whole.

Defined results: a null, empty or wordless text has no n-grams and weight 0; a
null doc_id hashes as the empty string and comes last among ties; repeated rows
are documents of their own, and ties beyond doc_id go by row; an empty table has
no result rows, an empty target makes all gains follow from smoothing alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, ready, steps, with_uid, written

#: What stands between words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the index of every word, and where each row's words begin and end."""
    # Lower-cased before it is widened: a widened slice keeps the bytes before it, which ascii_lower doesn't skip.
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    split = pc.split_pattern_regex(texts, BETWEEN)
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    coded = pc.dictionary_encode(pc.list_flatten(split))
    index, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    if "" in names:  # before a leading and after a trailing separator
        word = index != names.index("")
        bounds = np.concatenate([[0], np.cumsum(word)])[bounds]
        index = index[word]
    return names, index, bounds


def _crc_buckets(grams: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(g.encode()) % buckets for g in grams), dtype=np.int64, count=len(grams))


def gram_buckets(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of 1 to ``longest`` words, the row of each, and the number of words of each row."""
    names, index, bounds = coded_words(texts)
    size = np.diff(bounds)
    rows = np.repeat(np.arange(len(size)), size)
    out, of = [_crc_buckets(names, buckets)[index]], [rows]
    code, spelled = index, names  # of the (n - 1)-gram that begins at each word
    for n in range(2, longest + 1):
        code, tail = code[:-1], index[n - 1:]
        whole = rows[:-(n - 1) or None][:len(tail)] == rows[n - 1:]
        pair = code[:len(tail)] * (len(names) + 1) + tail
        distinct, code = np.unique(pair, return_inverse=True)
        head, last = np.divmod(distinct, len(names) + 1)
        spelled = [f"{spelled[i]} {names[j]}" for i, j in zip(head.tolist(), last.tolist())]
        out.append(_crc_buckets(spelled, buckets)[code[whole]])
        of.append(rows[:len(tail)][whole])
    return np.concatenate(out), np.concatenate(of), size


def _count(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in steps(batches):
            total += np.bincount(gram_buckets(col(b, "text"), longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of ``docs`` fall into each bucket."""
    ready(docs.sparkSession)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(longest, buckets), "bucket long, n long")
    counts = np.zeros(buckets, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        counts[r.bucket] = r.n
    return counts


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    t, s, n = target.astype(np.float64), raw.astype(np.float64), float(len(raw))
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(texts: pa.Array, gain: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, number of n-grams and floored mean gain of each row."""
    bucket, rows, words = gram_buckets(texts, longest, len(gain))
    n = np.bincount(rows, minlength=len(words))
    if longest > 1:
        order = np.argsort(rows, kind="stable")
        bucket = bucket[order]
    taken = gain[bucket]
    total = np.zeros(len(words), dtype=np.int64)
    full = np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(taken, (np.cumsum(n) - n)[full])
    return words, n, total // np.maximum(n, 1)


def _weigh(gain, longest: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = weigh(col(b, "text"), gain.value, longest)
            yield pa.RecordBatch.from_arrays([*(col(b, c) for c in keep), *(pa.array(x, pa.int64()) for x in found)],
                                             [*keep, "n_words", "n_features", "weight"])

    return run


def noise(seed: int = SEED) -> F.Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of SHA-256 of ``seed:doc_id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(eligible: DataFrame, k: int) -> DataFrame:
    """(uid, rank) of the k highest scores; ties to the smaller doc_id, a null one last, then to the smaller uid."""
    at_score = {r[0]: r[1] for r in eligible.groupBy("score").count().collect()}  # integers of a bounded range
    above, last = 0, None
    for last in sorted(at_score, reverse=True):
        above += at_score[last]
        if above >= k:
            break
    place = F.monotonically_increasing_id()
    order = written(eligible.where(F.col("score") >= last).select("uid", "doc_id", "score")
                    .orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
                    .select("uid", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")),
                    "order")
    before, offsets = 0, []
    for r in sorted(order.groupBy("part").count().collect()):  # a row a partition of the sort
        offsets.append((r[0], before))
        before += r[1]
    part = eligible.sparkSession.createDataFrame(offsets, "part long, before long")
    return (order.join(F.broadcast(part), "part").select("uid", (F.col("before") + F.col("nth") + 1).alias("rank"))
            .where(F.col("rank") <= k))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """A row per document: the ``keep`` columns (``doc_id`` by default), n_words, n_features, weight, score, and rank
    (1, 2, 3 ... from the highest score; null if not drawn)."""
    spark = ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    gain = spark.sparkContext.broadcast(gains(bucket_counts(target, longest, buckets), bucket_counts(docs, longest, buckets)))
    schema = docs.select(*keep).schema.simpleString()[len("struct<"):-1]
    named = docs.select(*keep, *[F.col("text").cast("string").alias("text")] * ("text" not in keep))
    weighed = named.mapInArrow(_weigh(gain, longest, keep), f"{schema}, n_words long, n_features long, weight long")
    scored = written(with_uid(weighed).withColumn("score", F.col("weight") + noise(seed)), "scored")
    eligible = scored.where(F.col("n_words") >= least)
    k = percent * eligible.count() // 100
    if not k:
        return scored.drop("uid").withColumn("rank", F.lit(None).cast("long"))
    return scored.join(written(_ranked(eligible, k), "ranks"), "uid", "left").drop("uid")
