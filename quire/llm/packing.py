"""Packing token sequences by first-fit decreasing in randomised groups of documents.

A document's ids, then ``end_id``, are cut at every ``length`` ids; a full piece
is a sequence of its own. The rest, one piece a document, are dealt by a hash of
the piece's number into groups of about ``GROUP`` and each group is packed by
itself: longest first, into the first open sequence with room, found by descent
in a tournament tree over the sequences' free room. Each group leaves a few
unfilled sequences, so the padding falls as GROUP grows; the group bounds memory
and time of a task at any input size.

Pieces are written to the shared folder once, so tokenizing isn't repeated and
groups don't change when an executor is lost. A null text has ``end_id`` alone.
Repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, ready, steps, with_uid, written
from .tokens import token_ids

LENGTH = 2048
END_ID = 1
GROUP = 4096


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken by falling size (equal ones in the order given); none is larger than ``room``."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1)).bit_length()
    tree = [room] * (2 * leaves)  # the largest free room below each node; leaves are bins
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, room - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
    return bins, offsets


def _pieces(path: str, length: int, end_id: int, keep: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            ids, bounds = token_ids(col(b, "text"), path)
            bounds = bounds + np.arange(len(bounds))
            whole = np.full(int(bounds[-1]), end_id, dtype="<u4")
            inside = np.ones(len(whole), dtype=bool)
            inside[bounds[1:] - 1] = False
            whole[inside] = ids
            size = np.diff(bounds)
            n = -(-size // length)
            row = np.repeat(np.arange(len(size)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
            long = np.minimum(size[row] - start, length)
            at = bounds[row] + start
            spans = [whole[s:s + k] for s, k in zip(at.tolist(), long.tolist())]
            rows = pa.array(row)
            out = [*(col(b, c).take(rows) for c in keep), pa.array(start), pa.array(long),
                   pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(size[row])]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [*keep, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


def _pack(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return pd.DataFrame({"piece": rows["piece"], "sequence_id": ((rows["group"].to_numpy() << 32) + bins) * 2,
                             "offset": offsets})

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP,
         keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: the ``keep`` columns (``doc_id`` by default), start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves if asked for."""
    ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.simpleString()[len("struct<"):-1]
    pieces = docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(tokenizer, length, end_id, keep, with_ids),
        f"{schema}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    pieces = written(with_uid(pieces, "piece"), "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < length).count() // group))
    dealt = pieces.where(F.col("length") < length).select("piece", "length", F.pmod(
        F.xxhash64("piece", F.lit(7)), F.lit(groups)).alias("group"))
    placed = dealt.groupBy("group").applyInPandas(_pack(length), "piece long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == length).withColumns(
        {"sequence_id": F.col("piece") * 2 + 1, "offset": F.lit(0).cast("long")})
    return pieces.join(placed, "piece").unionByName(full).drop("piece")
