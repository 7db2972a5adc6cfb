"""Exact substring deduplication by fixed-block anchors.

Words are runs of anything but ASCII blanks, unchanged. A window is ``window``
consecutive words of one document; every word of a window whose words also start
anywhere else, in another document or in the same one, is covered and removed. All
occurrences go, the first one too.

1. Index: each document's non-overlapping blocks of ``(window + 1) // 2`` words. Any
   window holds a whole one of them, whatever its place.
2. Probe: every rolling run of that many words. Blocks and probes meet by hash in
   ``buckets``, packed as 32-bit arrays, a row a step and bucket: about five bytes a
   word are shuffled. A task reads a bucket's blocks, then streams its probes; a block
   with two probes or more is an anchor, and the documents that hold it are told. Until
   the second probe one is held back for each block, so memory follows the blocks of a
   bucket, not the copies of a passage.
3. Extend: of the anchors in a window the one with the least hash stands for it (equal
   windows have the same one). Consecutive windows of one anchor form a span, up to a
   window to both sides of it: spans that occur twice are repeats to their whole length,
   and chains of them are the maximal repeats. Spans that are alone in the corpus lie at
   a repeat's edge: their windows are compared one by one with those of the other spans
   of the anchor, each kind of span once, however often it occurs.
4. Covered words are cut out.

No pairs of occurrences are made: a passage with m copies costs m rows. Texts are
written once, bucketed, and later steps bring what they need to them, so no text is
shuffled. Spans and windows are known by 128 bits (the anchor's hash and their own).

Defined results: a null or blank text has no words; a document shorter than a window
loses nothing; texts are looked at whole; repeated rows are documents of their own, so
they remove each other wholly; repeats that overlap themselves count; an empty table
has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_BITS, co_located, col, drop, ready, steps, text_table, with_chunk, written
from .words import U64, Words, mix, words

WINDOW = 35
#: Bytes of text a bucket of blocks and probes is to stand for, and most buckets (so that a row of a step and bucket
#: holds some tens of probes).
BUCKET_BYTES = 24 << 20
MOST_BUCKETS = 1 << 14
_NONE = np.iinfo(np.uint64).max


def block_words(window: int) -> int:
    """The longest block of which every window holds a whole one at a multiple of its length."""
    return (window + 1) // 2


def _keys(w: Words, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit hash of the run of ``block`` words that begins at each word."""
    g = w.grams(block)
    return (((g >> U64(40)) * U64(buckets)) >> U64(24)).astype(np.int32), (g & U64(0xFFFFFFFF)).astype(np.uint32)


def packed_places(places: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising places within rows (which begin at ``begins``) as bytes of their steps, 255 standing for a step that goes on;
    and the bytes' bounds by row."""
    step = np.diff(places, prepend=0)
    step[begins] = places[begins]
    more, rest = np.divmod(step, 255)
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = rest
    return out, np.concatenate([(ends - more - 1)[begins], ends[-1:]])


def unpacked_places(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, dtype=np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        chunk = col(b, "chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for s, e in zip(cuts, cuts[1:]):
            yield b.slice(s, e - s)


def _index_and_probes(window: int, buckets: int):
    block = block_words(window)

    def rows(bucket, hashes, places=None, chunk=None):
        begins = np.flatnonzero(np.diff(bucket, prepend=-1))
        bounds = np.concatenate([begins, [len(bucket)]])
        n = len(begins)
        body = pa.nulls(n, pa.binary())
        if places is not None:
            packed, at = packed_places(places, begins)
            body = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[begins], pa.int32()), pa.array(np.full(n, places is not None)), pa.array(np.full(n, chunk or 0, np.int64)),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int32))), body],
            ["bucket", "probe", "chunk", "hashes", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_chunk(batches):
            w = words(col(b, "text"), "blank")
            at = np.flatnonzero(w.full(block) & np.repeat(w.counts >= window, w.counts))
            if not len(at):
                continue
            bucket, low = _keys(w, block, buckets)
            place = col(b, "uid").to_numpy() & ((1 << ROW_BITS) - 1)
            row = w.rows()[at]
            # rows of a chunk come in the order of their ids from one file; sorted in any case
            order = np.lexsort((place[row], bucket[at]))
            at, row = at[order], row[order]
            fixed = (at - w.offsets[row]) % block == 0
            yield rows(bucket[at][fixed], low[at][fixed])
            yield rows(bucket[at], low[at], place[row], int(col(b, "chunk")[0].as_py()))

    return run


class Bucket:
    """Blocks of one bucket, and which of them two probes or more have hit."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.blocks: np.ndarray | None = None

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(hashes)

    def probe(self, hashes: np.ndarray, uids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(uid, hash) of probes of anchors, as far as they are known by now."""
        if self.blocks is None:
            self.blocks = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, dtype=np.uint32)
            self.parts = []
            self.times = np.zeros(len(self.blocks), dtype=np.int8)  # 0, 1, or 2 for more
            self.held = np.zeros(len(self.blocks), dtype=np.int64)
        if not len(self.blocks):
            return uids[:0], hashes[:0]
        at = np.minimum(np.searchsorted(self.blocks, hashes), len(self.blocks) - 1)
        hit = self.blocks[at] == hashes
        at, uids = at[hit], uids[hit]
        found, first, n = np.unique(at, return_index=True, return_counts=True)
        before = self.times[found]
        self.times[found] = np.minimum(before + np.minimum(n, 2), 2)
        alone = found[(before == 0) & (n == 1)]
        self.held[alone] = uids[first[(before == 0) & (n == 1)]]
        freed = found[before == 1]
        tell = self.times[at] == 2
        return np.concatenate([uids[tell], self.held[freed]]), self.blocks[np.concatenate([at[tell], freed])]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, blocks before probes -> the documents of anchors."""
    now, held = None, Bucket()
    for b in batches:
        bucket, probe, chunk = (col(b, c).to_numpy(zero_copy_only=False) for c in ("bucket", "probe", "chunk"))
        hashes, places = col(b, "hashes"), col(b, "places")
        for i in range(b.num_rows):
            if bucket[i] != now:
                now, held = bucket[i], Bucket()
            values = hashes[i].values.to_numpy().view(np.uint32)
            if not probe[i]:
                held.add(values)
                continue
            uids, found = held.probe(values, (int(chunk[i]) << ROW_BITS) | unpacked_places(places[i].as_py()))
            if not len(uids):
                continue
            order = np.lexsort((found, uids))
            uids, found = uids[order], found[order]
            new = np.concatenate([[True], (uids[1:] != uids[:-1]) | (found[1:] != found[:-1])])
            uids, found = uids[new], found[new]
            begins = np.flatnonzero(np.diff(uids, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids[begins]), pa.array(np.full(len(begins), now, np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(begins, len(uids)), pa.int32()), pa.array(found.view(np.int32)))],
                ["uid", "bucket", "hashes"])


def _prefix(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Running sums that give the hash of any run of words (see ``run_hash``)."""
    n = len(w.starts)
    up = np.full(n + 1, 0x9E3779B97F4A7C15, dtype=U64)
    down = np.full(n + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), dtype=U64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    return np.concatenate([[U64(0)], np.cumsum(mix(w.hashes + U64(5)) * up[:n], dtype=U64)]), down


def run_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, n) -> np.ndarray:
    """Hash of the n words from ``start`` on, the same wherever they stand."""
    total, down = prefix
    return mix((total[start + n] - total[start]) * down[start] + np.asarray(n).astype(U64)).astype(np.int64)


def spans(w: Words, hit: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor (a word's index) of each span; ``hit``: where anchors begin."""
    block = block_words(window)
    best = np.where(hit, w.grams(block), _NONE)
    full = w.full(window)
    n = len(best)
    least, at = best.copy(), np.arange(n)
    for k in range(1, window - block + 1):
        less = best[k:] < least[:n - k]
        least[:n - k][less] = best[k:][less]
        at[:n - k][less] = np.flatnonzero(less) + k
    some = np.flatnonzero(full & (least != _NONE))
    if not len(some):
        return some, some, some
    new = np.ones(len(some), dtype=bool)
    new[1:] = (some[1:] != some[:-1] + 1) | (at[some[1:]] != at[some[:-1]])
    begins = np.flatnonzero(new)
    return some[begins], np.diff(np.append(begins, len(some))), at[some[begins]]


def _extend(window: int, buckets: int):
    block = block_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = words(col(b, "text"), "blank")
            told = col(b, "hits").flatten()
            sizes = told.field("hashes").value_lengths().to_numpy(zero_copy_only=False)
            known = (np.repeat(told.field("bucket").to_numpy().astype(np.int64), sizes) << 32) | \
                told.field("hashes").flatten().to_numpy().view(np.uint32)
            bucket, low = _keys(w, block, buckets)
            hit = w.full(block) & np.isin((bucket.astype(np.int64) << 32) | low, known)
            start, n, anchor = spans(w, hit, window)
            if not len(start):
                continue
            row = w.rows()[start]
            yield pa.RecordBatch.from_arrays(
                [col(b, "uid").take(pa.array(row)), pa.array(start - w.offsets[row]), pa.array(n.astype(np.int64)),
                 pa.array(w.grams(block)[anchor].astype(np.int64)), pa.array(run_hash(_prefix(w), start, n + window - 1))],
                ["uid", "start", "windows", "anchor", "hash"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = words(col(b, "text"), "blank")
            asked = col(b, "asked")
            of = np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            asked = asked.flatten()
            start, n = asked.field("start").to_numpy(), asked.field("windows").to_numpy()
            each = np.repeat(np.arange(len(start)), n)
            place = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            row = of[each]
            yield pa.RecordBatch.from_arrays(
                [col(b, "uid").take(pa.array(row)), pa.array(place), asked.field("anchor").take(pa.array(each)),
                 pa.array(run_hash(_prefix(w), w.offsets[row] + place, window)), asked.field("n").take(pa.array(each))],
                ["uid", "start", "anchor", "hash", "n"])

    return run


def joined_words(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the kept words, a blank after each, and the bounds of each row's."""
    start, size = w.starts[keep], (w.ends - w.starts)[keep] + 1
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = np.append(w.data, np.uint8(0x20))[at]
    out[ends - 1] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
    return out, np.concatenate([[0], ends])[kept]


def _cut(keep: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = words(col(b, "text"), "blank")
            covered = col(b, "covered")
            of = np.repeat(np.arange(b.num_rows), np.nan_to_num(covered.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            flat = covered.flatten()
            depth = np.zeros(len(w.starts) + 1, dtype=np.int64)
            first = w.offsets[of] + flat.field("start").to_numpy()
            np.add.at(depth, first, 1)
            np.add.at(depth, first + flat.field("words").to_numpy(), -1)
            stay = np.cumsum(depth[:-1]) == 0
            body, bounds = joined_words(w, stay)
            left = np.diff(np.concatenate([[0], np.cumsum(stay)])[w.offsets])
            whole = memoryview(body.tobytes())
            texts = [whole[s:max(s, e - 1)] for s, e in zip(bounds.tolist(), bounds[1:].tolist())]
            out = [*(col(b, c) for c in keep), pa.array(w.counts, pa.int64()), pa.array(w.counts - left, pa.int64()),
                   pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            if with_text:
                out.append(pa.array([bytes(t).decode() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    return run


def cut_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """A row per document: the ``keep`` columns (``doc_id`` by default), n_words, n_removed, kept_sha256 (of the kept words
    joined by one space) and, if asked for, ``kept``, those words themselves."""
    spark = ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    boxed = docs.select(F.struct(*keep).alias("_in"), F.col("text").cast("string").alias("text"))
    texts = text_table(boxed)
    narrow = texts.select("chunk", "uid", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(at_least, -(-total // BUCKET_BYTES)))

    met = (narrow.mapInArrow(_index_and_probes(window, buckets),
                             "bucket int, probe boolean, chunk long, hashes array<int>, places binary")
           .repartition(buckets, "bucket").sortWithinPartitions("bucket", "probe"))
    hits = met.mapInArrow(_anchors, "uid long, bucket int, hashes array<int>")
    hits = written(with_chunk(hits.groupBy("uid").agg(F.collect_list(F.struct("bucket", "hashes")).alias("hits"))), "anchors")
    with co_located(spark):
        found = written(narrow.join(hits, ["chunk", "uid"]).select("uid", "text", "hits").mapInArrow(
            _extend(window, buckets), "uid long, start long, windows long, anchor long, hash long"), "spans")
    kinds = written(found.groupBy("anchor", "hash").agg(F.count("*").alias("n"), F.min(F.struct("uid", "start", "windows")).alias("of")),
                    "kinds")
    open_ = (kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
             .where("kinds > 1 and least = 1").select("anchor"))
    asked = with_chunk(kinds.join(open_, "anchor").groupBy("of.uid").agg(
        F.collect_list(F.struct("of.start", "of.windows", "anchor", "n")).alias("asked")))
    with co_located(spark):
        edges = written(narrow.join(asked, ["chunk", "uid"]).select("uid", "text", "asked").mapInArrow(
            _windows(window), "uid long, start long, anchor long, hash long, n long"), "edges")
    again = edges.groupBy("anchor", "hash").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "hash")
    size = F.lit(window).cast("long")
    covered = (found.join(kinds.where("n > 1").select("anchor", "hash"), ["anchor", "hash"])
               .select("uid", "start", (F.col("windows") + size - 1).alias("words"))
               .unionByName(edges.where("n = 1").join(again, ["anchor", "hash"]).select("uid", "start", size.alias("words"))))
    covered = written(with_chunk(covered.groupBy("uid").agg(F.collect_list(F.struct("start", "words")).alias("covered"))), "covered")
    drop(hits, found, kinds, edges)
    schema = docs.select(*keep).schema.simpleString()[len("struct<"):-1]
    with co_located(spark):
        out = written(texts.join(covered, ["chunk", "uid"], "left").select("_in.*", "text", "covered").mapInArrow(
            _cut(keep, with_text), f"{schema}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text),
            "kept")
    drop(texts, covered)
    return out
