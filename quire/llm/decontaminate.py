"""Benchmark decontamination by winnowing.

Words of a text: A-Z lower-cased, runs of digits, ASCII letters and characters
beyond ASCII. A benchmark item's windows are its runs of ``window`` words; an
item of fewer words, but not none, is one window. Every text keeps, in each
window, the rightmost smallest hash of the window's k-grams (winnowing), so two
equal windows keep the same fingerprint at the same place. Fingerprints of
documents and benchmark are joined, the words behind equal hashes are compared
and the hit is extended word by word to both sides: no shared window is missed
and no hash collision counts.

Defined results: a null or wordless document has no words and no hits; a
wordless or null item has no windows; an item with a null id counts as an item
with an empty id; items with one id count once; repeated documents (equal or
null ids too) are judged row by row; an empty benchmark leaves all clean. Extra
columns of the inputs are ignored here and kept by ``clean_documents``.

Scale: the benchmark's fingerprints become a bitmap of a fixed ``2**FILTER_BITS``
bits, the only broadcast. Documents are read once, no text is shuffled, and only
fingerprints in the bitmap reach the (sort-merge, skew-split) join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, col, ready, steps, unboxed, with_uid, written
from .words import U64, Words, words

WINDOW = 13
GRAM = 8
FILTER_BITS = 24
_BLOCK_BITS = 15

_MARKS = "level int, fp bigint, pos bigint, before array<string>, gram string, after array<string>"
_MARK_TYPE = pa.list_(pa.struct([("level", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()),
                                 ("before", pa.list_(pa.string())), ("gram", pa.string()),
                                 ("after", pa.list_(pa.string()))]))


def winnow(w: Words, level: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places and hashes of the k-grams kept for windows of ``level`` words (k = ``gram``, at most ``level``)."""
    k = min(gram, level)
    whole = np.flatnonzero(w.full(level)[:max(0, len(w.starts) - level + 1)])
    if not len(whole):
        return whole, np.zeros(0, dtype=U64)
    g = w.grams(k) ^ U64(level)
    best, at = g[whole], whole.copy()
    for t in range(1, level - k + 1):
        other = g[whole + t]
        better = other <= best
        best[better], at[better] = other[better], whole[better] + t
    at = np.unique(at)
    return at, g[at]


def _marks(w: Words, levels: list[int], gram: int, bitmap: np.ndarray | None) -> list[list[dict]]:
    """Per row the kept fingerprints with the words that a window around each could take in."""
    out: list[list[dict]] = [[] for _ in range(len(w.offsets) - 1)]
    for level in levels:
        k = min(gram, level)
        at, fp = winnow(w, level, gram)
        if bitmap is not None and len(at):
            bit = fp >> U64(64 - FILTER_BITS)
            known = (bitmap[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1
            at, fp = at[known == 1], fp[known == 1]
        rows = np.searchsorted(w.offsets, at, side="right") - 1
        for i, h, r in zip(at.tolist(), fp.astype(np.int64).tolist(), rows.tolist()):
            first, end = int(w.offsets[r]), int(w.offsets[r + 1])
            out[r].append({
                "level": level, "fp": h, "pos": i - first,
                "before": [w.text(x) for x in range(i - 1, max(first, i - (level - k)) - 1, -1)],
                "gram": w.text(i, i + k),
                "after": [w.text(x) for x in range(i + k, min(end, i + level))]})
    return out


def _scan(levels: list[int], gram: int, ids: list[str], bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for b in steps(batches):
            w = words(col(b, "text"), "plain")
            yield pa.RecordBatch.from_arrays(
                [*(col(b, c) for c in ids), pa.array(w.counts, pa.int64()),
                 pa.array(_marks(w, levels, gram, bits), _MARK_TYPE)], [*ids, "n_words", "marks"])

    return run


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        yield pa.RecordBatch.from_arrays([pa.array(words(col(b, "text"), "plain").counts, pa.int64())], ["n"])


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << _BLOCK_BITS, dtype=np.uint8)
    bits[rows["low"].to_numpy()] = 1
    return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _bitmap(marks: DataFrame) -> np.ndarray:
    """``2**FILTER_BITS`` bits, set for every fingerprint: its size doesn't follow the benchmark's."""
    bit = F.shiftrightunsigned(F.col("fp"), 64 - FILTER_BITS)
    blocks = (marks.select(F.shiftright(bit, _BLOCK_BITS).alias("block"),
                           bit.bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("low"))
              .distinct().groupBy("block").applyInPandas(_block, "block bigint, bits binary"))
    size = (1 << _BLOCK_BITS) // 8
    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in blocks.collect():  # at most 2**(FILTER_BITS - _BLOCK_BITS) rows
        out[r.block * size:(r.block + 1) * size] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _same_run(a: str, b: str) -> F.Column:
    """How many leading words of two lists agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  keep: list[str] | None = None) -> DataFrame:
    """A row per document: the ``keep`` columns (``doc_id`` by default), n_words, n_hit, items (sorted ids as
    strings, null if none) and ``uid``, a row id."""
    spark = ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.col("text").cast("string").alias("text"))
    levels = sorted(r.level for r in items.select("text").mapInArrow(_item_windows, "n long").where("n > 0")
                    .select(F.least("n", F.lit(window)).cast("int").alias("level")).distinct().collect())
    # An item has windows of one level only: its own length, or `window` if it is longer.
    marks = written(
        items.mapInArrow(_scan(levels, gram, ["item"], None), f"item string, n_words long, marks array<struct<{_MARKS}>>")
        .select("item", F.least("n_words", F.lit(window)).alias("own"), F.explode("marks").alias("m"))
        .where(F.col("m.level") == F.col("own")).select("m.*", "item")
        .groupBy("level", "fp", "gram", "before", "after").agg(F.collect_set("item").alias("items")), "item-marks")
    bitmap = spark.sparkContext.broadcast(_bitmap(marks))

    schema = docs.select(*keep).schema.simpleString()[len("struct<"):-1]
    named = docs.select(*keep, *[F.col("text").cast("string").alias("text")] * ("text" not in keep))
    scanned = written(with_uid(named.mapInArrow(
        _scan(levels, gram, keep, bitmap), f"{schema}, n_words long, marks array<struct<{_MARKS}>>")), "doc-marks")

    d = scanned.where(F.size("marks") > 0).select("uid", F.explode("marks").alias("m")).select(
        "uid", *(F.col(f"m.{c}").alias(c) for c in ("level", "fp", "gram", "pos")),
        F.col("m.before").alias("d_before"), F.col("m.after").alias("d_after"))
    hit = (d.join(marks, ["level", "fp", "gram"])
           .withColumn("left", _same_run("d_before", "before")).withColumn("right", _same_run("d_after", "after"))
           .withColumn("k", F.least(F.col("level"), F.lit(gram)))
           .where(F.col("left") + F.col("k") + F.col("right") >= F.col("level"))
           .select("uid", (F.col("pos") - F.col("left")).alias("s"),
                   (F.col("pos") + F.col("k") + F.col("right")).alias("e"), "items"))
    ahead = Window.partitionBy("uid").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = (hit.groupBy("uid", "s").agg(F.max("e").alias("e"))
               .withColumn("reach", F.coalesce(F.max("e").over(ahead), F.col("s")))
               .groupBy("uid").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach"))).alias("n_hit")))
    found = (hit.select("uid", F.explode("items").alias("item")).distinct()
             .groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    return (scanned.drop("marks").join(covered.join(found, "uid"), "uid", "left")
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))))


def contaminated() -> F.Column:
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    judged = contamination(docs.select(*boxed(docs)), benchmark, keep=["_in", "text"])
    return unboxed(judged.where(~contaminated()), docs.columns)
