"""N-gram Jaccard join: MinHash banding, then exact comparison of full n-gram sets.

Words: A-Z lower-cased, runs of digits, ASCII letters and characters beyond
ASCII. A text's set holds the 64-bit hashes of its ``n``-word shingles; a text of
fewer words, but at least one, has its whole word run as the only shingle. Two
documents are linked if the Jaccard similarity of their sets is at least
``threshold``; a document without words has no link.

1. Documents with equal sets form a class of copies (128-bit digest of the set);
   only its first document goes on.
2. ``banding`` picks rows and bands for the target recall; a shuffle on band
   hashes finds buckets of two or more representatives.
3. Buckets are not turned into pairs. Every representative gets the smallest
   member over its buckets as a label; a label's members are dealt by hash into
   blocks bounded in rows and in shingles. Each block is compared with itself, and
   blocks that meet in a bucket with each other, as two matrices inside a task, all
   pairs of them exactly; that gives one row a document: its number of links and
   its root among the rows seen. So a group of m texts gives m / BLOCK rows a text,
   never m * m rows, and no partner is dropped.
4. Where only classes are asked for (``distinct_documents``), blocks that meet are
   compared only if they hold more than one class by then: after each block's own
   comparison, one text of each class of a label's blocks is compared with the
   label's others. A group whose texts are all alike costs its own blocks alone.
5. Roots are joined into connected classes by hash-free label spreading with
   pointer jumping; every round is written to the shared folder.

Texts are written once, bucketed by row; the shingles of what meets are read from
there without shuffling texts. Intermediate tables go after their last use.

Result per document: class_id, the smallest doc_id of its class (null if all are
null), and n_links, how many other documents it is linked to; copies count,
without being expanded. Null and repeated ids stay rows of their own (``uid``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, co_located, col, drop, ready, steps, text_table, unboxed, with_chunk, written
from .words import U64, mix, words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
#: Most representatives, and shingles on average, that a block is to hold.
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
#: Blocks of a bucket that a task pairs with all others of the bucket.
MEET = 64
_COLUMNS = 1024
#: Shingles of at most so many of the sets compared are counted pair by pair, the others as columns of a matrix.
_RARE = 8


def banding(threshold: float = THRESHOLD, recall: float = RECALL, stray: float = 0.3, most: int = 128) -> tuple[int, int]:
    """(bands, rows) of at most ``most`` hashes: recall at the threshold is reached, and texts of
    similarity ``stray`` meet as rarely as that allows."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        meet = 1 - (1 - stray**rows) ** bands
        if bands * rows <= most and (best is None or meet < best[0]):
            best = (meet, bands, rows)
    if best is None:
        raise ValueError(f"no banding of {most} hashes reaches recall {recall}")
    return best[1], best[2]


def _multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, end to end, and the bounds of each row's."""
    w = words(texts, "plain")
    rows = w.rows()
    at = w.full(n)
    if len(at):
        at[max(0, len(at) - n + 1):] = False
    g = w.grams(n)[at]
    r = rows[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(w.text(int(w.offsets[i]), int(w.offsets[i + 1])).encode(),
                                                         digest_size=8).digest(), "little") for i in short], dtype=U64)
        g, r = np.concatenate([g, whole]), np.concatenate([r, short])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    if len(g):
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[new], r[new]
    return g, np.searchsorted(r, np.arange(len(texts) + 1))


def band_hashes(g: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row a set with shingles, one column a band: hashes of ``rows`` minima each, under multiplicative permutations."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(full), bands), dtype=U64)
    if not len(full):
        return out
    low = (g >> U64(32)).astype(np.uint32) ^ g.astype(np.uint32)
    first = bounds[:-1][full]
    for i, by in enumerate(_multipliers(bands * rows)):
        mixed = low * by
        mixed ^= mixed >> np.uint32(15)
        band = i // rows
        out[:, band] = mix(out[:, band] ^ np.minimum.reduceat(mixed * np.uint32(0x85EBCA6B), first).astype(U64))
    return mix(out + np.arange(bands, dtype=U64))


def _bytes(g: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    body, cut = g.tobytes(), (bounds * 8).tolist()
    return [body[s:e] for s, e in zip(cut, cut[1:])]


def _load(n: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield pa.RecordBatch.from_arrays(
                [*(col(b, c) for c in keep), pa.array(_bytes(*shingle_sets(col(b, "text"), n)), pa.binary())],
                [*keep, "shingles"])

    return run


def _scan(n: int, bands: int, rows: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            g, bounds = shingle_sets(col(b, "text"), n)
            size = np.diff(bounds)
            sig = np.zeros((len(size), bands), dtype=np.int64)
            sig[size > 0] = band_hashes(g, bounds, bands, rows).astype(np.int64)
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in _bytes(g, bounds)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands), pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(col(b, c) for c in keep), pa.array(digests, pa.binary()), pa.array(size, pa.int64()), lists],
                [*keep, "digest", "n_shingles", "bands"])

    return run


def linked(a: list[bytes], b: list[bytes] | None, threshold: float) -> np.ndarray:
    """Which sets of ``a`` are linked to which of ``b`` (of ``a`` itself without its diagonal, if None), exactly."""
    if b is not None and not (a and b):
        return np.zeros((len(a), len(b)), dtype=bool)
    sets = [np.frombuffer(x, dtype=U64) for x in a + (b or [])]
    size = np.array([len(x) for x in sets], dtype=np.float64)
    value, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    m = len(a)
    other = m if b is not None else 0
    common = np.zeros((m, len(sets) - other))
    order = np.argsort(code, kind="stable")
    owner, first = owner[order], np.cumsum(count) - count
    flat = []
    for n in range(2, _RARE + 1):
        near = owner[first[count == n][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(i + 1, n):
                x, y = near[:, i], near[:, j]
                if b is None:
                    flat += [x * common.shape[1] + y, y * common.shape[1] + x]
                else:
                    apart = (x < m) & (y >= m)
                    flat.append(x[apart] * common.shape[1] + y[apart] - m)
    if sum(map(len, flat)):
        common += np.bincount(np.concatenate(flat), minlength=common.size).reshape(common.shape)
    wide = np.flatnonzero(count > _RARE)
    number = np.full(len(count), -1)
    number[wide] = np.arange(len(wide))
    column = np.repeat(number, count)
    owner, column = owner[column >= 0], column[column >= 0]
    for start in range(0, len(wide), _COLUMNS):
        s, e = np.searchsorted(column, [start, start + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        part[owner[s:e], column[s:e] - start] = 1
        common += part[:m] @ part[other:].T
    either = size[:m, None] + size[None, other:] - common
    out = common >= threshold * either - 1e-9
    if b is None:
        np.fill_diagonal(out, False)
    return out


def _roots(uid: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest uid of each one's connected part."""
    root = uid.copy()
    while True:
        near = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, near)
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        uid, copies = rows["uid"].to_numpy(), rows["copies"].to_numpy()
        right = rows["right"].to_numpy()
        sets = rows["shingles"].tolist()
        if not right.any():
            link = linked(sets, None, threshold)
        else:
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            part = linked([sets[i] for i in a], [sets[i] for i in b], threshold)
            link = np.zeros((len(sets), len(sets)), dtype=bool)
            link[np.ix_(a, b)] = part
            link[np.ix_(b, a)] = part.T
        out = pd.DataFrame({"uid": uid, "links": link @ copies, "root": _roots(uid, link)})
        return out[out["links"] > 0]

    return run


def _spread(edges: DataFrame) -> DataFrame:
    """(uid, root): the smallest uid of each connected part of the (uid, root) edges."""
    both = written(edges.unionByName(edges.select(F.col("root").alias("uid"), F.col("uid").alias("root")))
                   .where("uid != root").distinct(), "edges")
    label = written(both.groupBy("uid").agg(F.min("root").alias("root")).select("uid", F.least("uid", "root").alias("root")),
                    "labels")
    while True:
        near = (both.select("uid", F.col("root").alias("at")).join(label.withColumnRenamed("uid", "at"), "at")
                .groupBy("uid").agg(F.min("root").alias("near")))
        better = label.join(near, "uid").select("uid", F.least("root", "near").alias("up"), F.col("root").alias("old"))
        jump = label.select(F.col("uid").alias("up"), F.col("root").alias("top"))
        new = written(better.join(jump, "up", "left").select(
            "uid", F.least("up", F.coalesce("top", "up")).alias("root"), "old"), "labels")
        if new.where("root != old").isEmpty():
            return new.drop("old")
        label = new.drop("old")


def meeting(met: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of blocks (label, part) that share a bucket (band, hash): a row a pair, several times at most.

    Of buckets with the same blocks, told by their number and 128 bits, one is taken. A bucket's blocks on one side are
    dealt to salts, ``MEET`` a salt on average, so neither a row nor a task holds all pairs of a bucket.
    """
    digest = [F.bit_xor(F.xxhash64("label", "part", F.lit(k))).alias(f"digest{k}") for k in (0, 1)]
    kinds = met.groupBy("band", "hash").agg(F.count("*").alias("n"), *digest).where("n > 1")
    taken = (kinds.groupBy("n", "digest0", "digest1").agg(F.min(F.struct("band", "hash")).alias("of"))
             .select("of.band", "of.hash", F.ceil(F.col("n") / MEET).alias("salts")))
    rows = written(met.join(taken, ["band", "hash"]), "meeting")
    place = F.struct("label", "part")
    left = rows.select("band", "hash", F.pmod(F.xxhash64("label", "part"), F.col("salts")).alias("salt"), place.alias("a"))
    right = rows.select("band", "hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
                        place.alias("b"))
    return left.join(right, ["band", "hash", "salt"]).where("a < b").select("a", "b")


_LINKS = "uid long, links long, root long"


def _within(loaded: DataFrame, threshold: float) -> DataFrame:
    """Links inside each block."""
    return loaded.withColumn("right", F.lit(False)).groupBy("label", "part").applyInPandas(_compare(threshold), _LINKS)


def _between(pair: DataFrame, loaded: DataFrame, threshold: float) -> DataFrame:
    """Links between the blocks of each pair (a, b), a < b."""
    ends = [F.struct(F.col(f"{x}.label").alias("label"), F.col(f"{x}.part").alias("part"), F.lit(right).alias("right"))
            for x, right in (("a", False), ("b", True))]
    side = pair.select("a", "b", F.explode(F.array(*ends)).alias("s")).select("a", "b", "s.*")
    return (side.join(loaded, ["label", "part"]).select("a", "b", "uid", "right", "copies", "shingles")
            .groupBy("a", "b").applyInPandas(_compare(threshold), _LINKS))


def _undecided(pair: DataFrame, block: DataFrame, loaded: DataFrame, own: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of the pairs of blocks, those that hold more than one class after one text of each class of a label's blocks has been
    compared with the others of the label; and the links found by that."""
    known = _spread(own.select("uid", "root"))
    classed = written(block.join(known, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "classed")
    many = block.groupBy("label").agg(F.max("part").alias("most")).where("most > 0").select("label")
    heads = classed.join(many, "label").groupBy("label", "part", "root").agg(F.min("uid").alias("uid"))
    sized = heads.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    heads = heads.join(sized, "label").select("uid", "label", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("parts")).alias("part"))
    more = written(_within(loaded.drop("label", "part").join(heads, "uid"), threshold), "heads")
    known = _spread(own.select("uid", "root").unionByName(more.select("uid", "root")))
    held = (block.join(known, "uid", "left").groupBy("label", "part")
            .agg(F.min(F.coalesce("root", "uid")).alias("low"), F.max(F.coalesce("root", "uid")).alias("high")))
    for x in ("a", "b"):
        side = held.select(F.struct("label", "part").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
        pair = pair.join(side, x)
    return pair.where("least(a_low, b_low) != greatest(a_high, b_high)").select("a", "b"), more


def _classes(docs: DataFrame, threshold: float, n: int, recall: float, links: bool) -> tuple[DataFrame, DataFrame]:
    """The bucketed texts, and (chunk, uid, class_uid, n_links, n_shingles) of every row; without ``links``, n_links may
    leave out links inside a class."""
    spark = ready(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    texts = text_table(docs)
    scanned = written(texts.select("uid", "text").mapInArrow(
        _scan(n, bands, rows, ["uid"]), "uid long, digest binary, n_shingles long, bands array<long>"), "signatures")

    member = scanned.where("n_shingles > 0")
    first = written(member.groupBy("digest").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")), "classes")

    banded = (member.select("uid", "bands").join(first.select("uid"), "uid", "left_semi")
              .select("uid", F.posexplode("bands").alias("band", "hash")))
    met = banded.groupBy("band", "hash").agg(F.min("uid").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    bucket = written(banded.join(met, ["band", "hash"]).select("uid", "band", "hash", "least"), "buckets")

    label = bucket.groupBy("uid").agg(F.min("least").alias("label"))
    sized = label.join(scanned.select("uid", "n_shingles"), "uid")
    parts = sized.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK),
                                                  F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    block = written(sized.join(parts, "label").select(
        "uid", "label", F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part")), "blocks")

    # Which blocks meet, besides each with itself: those that share a bucket.
    shared = written(bucket.join(block, "uid").select("band", "hash", "label", "part").distinct(), "met")
    drop(bucket)
    pair = written(meeting(shared).distinct(), "pairs")

    side = with_chunk(block.join(first.select("uid", "copies"), "uid"))
    with co_located(spark):
        loaded = written(texts.select("chunk", "uid", "text").join(side, ["chunk", "uid"]).drop("chunk").mapInArrow(
            _load(n, ["uid", "label", "part", "copies"]),
            "uid long, label long, part long, copies long, shingles binary"), "sets")
    found = [written(_within(loaded, threshold), "own")]
    if not pair.isEmpty():
        if not links:
            pair, more = _undecided(pair, block, loaded, found[0], threshold)
            found.append(more)
        found.append(written(_between(pair, loaded, threshold), "between"))
    drop(loaded)
    compared = found[0]
    for more in found[1:]:
        compared = compared.unionByName(more)

    total = compared.groupBy("uid").agg(F.sum("links").alias("links"))
    root = _spread(compared.select("uid", "root"))
    known = (first.join(total, "uid", "left").join(root, "uid", "left")
             .select("digest", F.coalesce("root", "uid").alias("class_uid"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    narrow = scanned.select("uid", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"), "n_shingles")
    return texts, with_chunk(narrow.join(known, "digest", "left").select(
        "uid", F.coalesce("class_uid", "uid").alias("class_uid"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "n_shingles"))


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL,
         keep: list[str] | None = None) -> DataFrame:
    """A row per document: uid, the ``keep`` columns (``doc_id`` by default), class_uid (the class's smallest uid),
    n_links and n_shingles."""
    keep = keep or ["doc_id"]
    boxed_docs = docs.select(F.struct(*keep).alias("_in"), F.col("text").cast("string").alias("text"))
    texts, known = _classes(boxed_docs, threshold, n, recall, True)
    with co_located(docs.sparkSession):
        out = written(texts.select("chunk", "uid", "_in").join(known, ["chunk", "uid"])
                      .select("uid", "_in.*", "class_uid", "n_links", "n_shingles"), "joined")
    drop(texts)
    return out


def with_class_id(joined: DataFrame) -> DataFrame:
    """``class_id``: the smallest doc_id of each class, from what ``join`` gives (written by it)."""
    least = written(joined.groupBy("class_uid").agg(F.min("doc_id").alias("class_id")), "least")
    # Both sides are plain exchanges, so a class with many documents can be split over tasks.
    return joined.join(least, "class_uid")


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that with the smallest row id, with all its columns; those without words stay."""
    texts, known = _classes(docs.select(*boxed(docs)), threshold, SHINGLE, RECALL, False)
    with co_located(docs.sparkSession):
        out = written(texts.join(known.where("uid = class_uid").select("chunk", "uid"), ["chunk", "uid"]).select("_in", "text"),
                      "distinct")
    drop(texts)
    return unboxed(out, docs.columns)
