"""Line deduplication by content-defined chunks of lines.

A text is cut into chunks of consecutive lines: after a line whose rolling hash
(over its own hash and the line before) is divisible by ``DIVISOR``, after
``MOST_LINES`` lines, and around a line of ``LONG_WORDS`` words or more, which is
a chunk of its own. Boundaries depend on lines alone, so an insertion or a
shift changes the chunks around it and no others. Of chunks with equal bytes,
over the whole table and within a document, the first by (doc_id, row, place)
stays and the others are removed, if a chunk has two lines or more with
``MIN_WORDS`` words together, or one long line. Line ends between chunks belong
to the chunk before and aren't compared.

Chunks are found by a 64-bit hash, grouped by hash and bytes, and once more
compared with the repeated chunk's bytes when they are taken out, so a collision
removes nothing.

With ``passage`` words, as the query and the pipeline have it, every run of
consecutive lines with more words than that goes too where it occurred before,
wherever it begins and whatever its lines and neighbours are. From each line on,
and up to each line, the shortest run of over ``passage`` words is taken: a
longer repeated run is the union of such shortest ones, so nothing has to be
extended. A shorter text that has a fitting chunk is one more run, so a copy of
it leaves no fragment. Runs are looked for by 128 bits made of their lines' BLAKE2
digests; a run that overlaps its first occurrence stays. Then bytes decide: runs of
a text that stand in the same place of the same earlier text are put together, the
earlier text's lines are fetched, each stretch once however many texts repeat it,
and only lines whose bytes agree go. Line ends between lines aren't compared.
Texts are written once, bucketed, and aren't shuffled.

Defined results: null stays null; texts without lines to remove stay as they
are; a text whose every chunk or line is repeated elsewhere becomes empty; null
doc_ids come last in the order; repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, co_located, col, drop, ready, row_keys, steps, text_table, unboxed, with_chunk, written
from .words import RULES, U64, mix, words

DIVISOR = 2
MOST_LINES = 16
MIN_WORDS = 12
LONG_WORDS = 40
#: A repeated run of lines with more words than this is removed, whatever its chunks are.
PASSAGE = 50


def _line_rule() -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, dtype=bool)
    inside[0x0A] = False
    return inside, np.arange(256, dtype=np.uint8)


RULES.setdefault("lines", _line_rule())


class Chunks:
    """Chunks of all rows: bytes ``data[starts[i]:ends[i]]`` (``until[i]`` with the line ends after it), row and place."""

    def __init__(self, texts: pa.Array):
        lines = words(texts, "lines")
        self.data = lines.data
        n = len(lines.starts)
        row = lines.rows()
        blank = words(texts, "blank")
        at = np.searchsorted(blank.starts, lines.starts)
        size = np.diff(np.concatenate([at, [len(blank.starts)]]))
        h = lines.hashes
        first = np.zeros(n, dtype=bool)
        first[lines.offsets[:-1][lines.counts > 0]] = True
        before = np.concatenate([np.zeros(1, dtype=U64), h[:-1]]) if n else h
        before[first] = 0
        roll = mix(before * U64(0x9E3779B97F4A7C15) + h)
        long = size >= LONG_WORDS
        begins = first.copy()
        if n:
            begins[1:] |= (roll[:-1] % U64(DIVISOR) == 0) | long[:-1] | long[1:]
        head = np.flatnonzero(begins)
        length = np.diff(np.concatenate([head, [n]]))
        place_in = np.arange(n) - np.repeat(head, length)
        begins |= place_in % MOST_LINES == 0
        head = np.flatnonzero(begins)
        tail = np.concatenate([head[1:], [n]]) - 1 if len(head) else head
        self.row = row[head]
        self.bounds = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.place = np.arange(len(head)) - self.bounds[self.row]
        self.starts, self.ends = lines.starts[head], lines.ends[tail]
        self.lines, self.head, self.tail = lines, head, tail
        n_lines = tail - head + 1
        total = np.concatenate([[0], np.cumsum(size)])
        n_words = total[tail + 1] - total[head]
        self.total = total
        self.fit = ((n_lines > 1) & (n_words >= MIN_WORDS)) | (n_words >= LONG_WORDS)
        part = np.concatenate([[U64(0)], np.cumsum(mix(h + place_in.astype(U64) * U64(0xD6E8FEB86659FD93)), dtype=U64)])
        self.hash = mix(part[tail + 1] - part[head] + n_lines.astype(U64)).astype(np.int64) if len(head) else h.astype(np.int64)

    def bytes(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & ((1 << 64) - 1), dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def runs(texts: pa.Array, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Runs of lines to compare: row, first and last line in the row, and two 64-bit hashes of each."""
    c = Chunks(texts)
    lines, total, n = c.lines, c.total, len(c.lines.starts)
    row, line = lines.rows(), np.arange(n)
    first, end = lines.offsets[:-1][row], lines.offsets[1:][row]
    to = np.searchsorted(total, total[:-1] + passage, side="right") - 1
    since = np.searchsorted(total, total[1:] - passage, side="left") - 1
    onward, back = to < end, since >= first
    has = np.zeros(len(texts), dtype=bool)
    has[c.row[c.fit]] = True
    bounds = lines.offsets
    short = np.flatnonzero(has & (total[bounds[1:]] - total[bounds[:-1]] <= passage))
    i = np.concatenate([line[onward], since[back], c.head[c.fit], bounds[short]]).astype(np.int64)
    j = np.concatenate([to[onward], line[back], c.tail[c.fit], bounds[short + 1] - 1]).astype(np.int64)
    i, j = np.divmod(np.unique(i * (n + 1) + j), n + 1)
    raw = lines.data.tobytes()
    digests = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest()
                        for s, e in zip(lines.starts.tolist(), lines.ends.tolist())])
    hashes = []
    for lane, base in zip(np.frombuffer(digests, dtype=U64).reshape(-1, 2).T, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
        up, down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        part = np.concatenate([[U64(0)], np.cumsum(lane * up[:n], dtype=U64)])
        hashes.append(mix((part[j + 1] - part[i]) * down[i] + (j - i + 1).astype(U64)).astype(np.int64))
    return row[i], i - first[i], j - first[i], hashes


def _cut_runs(passage: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            row, place, until, hashes = runs(col(b, "text"), passage)
            yield pa.RecordBatch.from_arrays(
                [*(col(b, k).take(pa.array(row)) for k in keep), pa.array(place), pa.array(until), *map(pa.array, hashes)],
                [*keep, "place", "until", "hash", "more"])

    return run


def stretches(place: np.ndarray, until: np.ndarray, source: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one text that stand in the same place of the same earlier text, put together where they touch; without those
    that lie inside another. Place, last line, earlier text and place in it of each."""
    shift = at - place
    order = np.lexsort((-until, place, shift, source))
    place, until, source, shift = place[order], until[order], source[order], shift[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])
    lane = np.cumsum(new)
    far = np.maximum.accumulate(until + lane * (int(until.max(initial=0)) + 2)) - lane * (int(until.max(initial=0)) + 2)
    new[1:] |= place[1:] > far[:-1] + 1
    head = np.flatnonzero(new)
    if len(head):
        until = np.maximum.reduceat(until, head)
    place, source, shift = place[head], source[head], shift[head]
    order = np.lexsort((-until, place))
    before = np.concatenate([[-1], np.maximum.accumulate(until[order])[:-1]]) if len(order) else until
    keep = order[until[order] > before]
    return place[keep], until[keep], source[keep], place[keep] + shift[keep]


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            drops = col(b, "drops")[i].values
            found = stretches(*(drops.field(k).to_numpy() for k in ("place", "until", "source", "at")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found[0]), col(b, "uid")[i].as_py(), np.int64)), *map(pa.array, found)],
                ["uid", "place", "until", "source", "at"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked lines of each text, a line end between them."""
    for b in steps(batches):
        texts, asked = col(b, "text"), col(b, "asked")
        for r in range(b.num_rows):
            w = words(texts.slice(r, 1), "lines")
            lines = [w.data[s:e].tobytes() for s, e in zip(w.starts.tolist(), w.ends.tolist())]
            at, n = (asked[r].values.field(k).to_numpy() for k in ("at", "lines"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), col(b, "uid")[r].as_py(), np.int64)), pa.array(at), pa.array(n),
                 pa.array([b"\n".join(lines[i:i + k]) for i, k in zip(at.tolist(), n.tolist())], pa.binary())],
                ["source", "at", "lines", "body"])


def strip_lines(texts: pa.Array, drops: list[list[dict] | None]) -> tuple[list[str | None], list[int]]:
    """Texts without the lines ``place`` up to ``until`` of each drop that equal those of its ``body``; and how many went."""
    out, gone = texts.to_pylist(), [0] * len(texts)
    for r, drop_ in enumerate(drops):
        if not drop_ or out[r] is None:
            continue
        w = words(texts.slice(r, 1), "lines")
        raw, starts = out[r].encode(), w.starts.tolist()
        lines = [w.data[s:e].tobytes() for s, e in zip(starts, w.ends.tolist())]
        bad = np.zeros(len(starts), dtype=bool)
        for d in drop_:
            span = lines[d["place"]:d["until"] + 1]
            if b"\n".join(span) == d["body"]:
                bad[d["place"]:d["until"] + 1] = True
        if not bad.any():
            continue
        left = b"".join([raw[s:e] for s, e, x in zip(starts, [*starts[1:], len(raw)], bad.tolist()) if not x])
        out[r], gone[r] = (left.rstrip(b"\n") if bad[-1] else left).decode(), int(bad.sum())
    return out, gone


def _cut(with_text: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            c = Chunks(col(b, "text"))
            at = np.flatnonzero(c.fit)
            rows = pa.array(c.row[at])
            out = [*(col(b, k).take(rows) for k in keep), pa.array(c.place[at]), pa.array(c.hash[at])]
            if with_text:
                out.append(pa.array([c.bytes(i) for i in at], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [*keep, "place", "hash", *["chunk"] * with_text])

    return run


def strip_chunks(texts: pa.Array, drops: list[list[dict] | None]) -> tuple[list[str | None], list[int]]:
    """Texts without the chunks that ``drops`` lists (place, chunk), where the bytes agree; and how many went."""
    out, gone = texts.to_pylist(), [0] * len(texts)
    for r, drop in enumerate(drops):
        if not drop or out[r] is None:
            continue
        c = Chunks(texts.slice(r, 1))
        raw = out[r].encode()
        starts = c.starts.tolist()
        bad = {d["place"] for d in drop if c.bytes(d["place"]) == d["chunk"]}
        keep = [raw[s:e] for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(raw)])) if i not in bad]
        if bad:
            left = b"".join(keep)
            out[r], gone[r] = (left.rstrip(b"\n") if len(starts) - 1 in bad else left).decode(), len(bad)
    return out, gone


def _strip(strip):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            texts, gone = strip(col(b, "text"), col(b, "_drops").to_pylist())
            names = [n for n in b.schema.names if n not in ("text", "_drops")]
            yield pa.RecordBatch.from_arrays(
                [*(col(b, n) for n in names), pa.array(texts, pa.string()), pa.array(gone, pa.int64())],
                [*names, "text", "n_removed"])

    return run


def _without_runs(docs: DataFrame, passage: int) -> DataFrame:
    """``without_repeats`` with a ``passage``, written."""
    spark = docs.sparkSession
    texts = text_table(docs.select(*boxed(docs)))
    kind = dict(docs.dtypes)["doc_id"]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "place")
    found = texts.select("_in.doc_id", "uid", "text").mapInArrow(
        _cut_runs(passage, ["doc_id", "uid"]), f"doc_id {kind}, uid long, place long, until long, hash long, more long")
    repeated = written(found.groupBy("hash", "more").agg(F.count("*").alias("n"), F.min(order).alias("first"))
                       .where("n > 1").select("hash", "more", F.col("first.uid").alias("source"), F.col("first.place").alias("at")),
                       "repeated")
    places = texts.select("uid", "text").mapInArrow(
        _cut_runs(passage, ["uid"]), "uid long, place long, until long, hash long, more long")
    told = (places.join(repeated, ["hash", "more"])
            .where("not (source = uid and place <= at + until - place)").groupBy("uid")
            .agg(F.collect_list(F.struct("place", "until", "source", "at")).alias("drops")))
    runs_ = written(told.mapInArrow(_put_together, "uid long, place long, until long, source long, at long")
                    .withColumn("lines", F.col("until") - F.col("place") + 1), "runs")
    drop(repeated)
    asked = with_chunk(runs_.select(F.col("source").alias("uid"), "at", "lines").distinct().groupBy("uid").agg(
        F.collect_list(F.struct("at", "lines")).alias("asked")))
    with co_located(spark):
        bodies = written(texts.select("chunk", "uid", "text").join(asked, ["chunk", "uid"]).select("uid", "text", "asked").mapInArrow(
            _fetch, "source long, at long, lines long, body binary"), "bodies")
    drops = with_chunk(runs_.join(bodies, ["source", "at", "lines"]).groupBy("uid").agg(
        F.collect_list(F.struct("place", "until", "body")).alias("_drops")))
    schema = texts.select("_in").schema.simpleString()[len("struct<"):-1]
    with co_located(spark):
        out = written(texts.join(drops, ["chunk", "uid"], "left").select("_in", "text", "_drops").mapInArrow(
            _strip(strip_lines), f"{schema}, text string, n_removed long"), "stripped")
    drop(texts, runs_, bodies)
    return out


def without_repeats(docs: DataFrame, passage: int | None = None) -> DataFrame:
    """A row per document: ``_in``, a struct of all other columns, ``text`` without repeated chunks, and n_removed,
    how many chunks went. With ``passage``, runs of lines with more words than that go as well, and lines are counted."""
    ready(docs.sparkSession)
    if passage is not None:
        return _without_runs(docs, passage)
    keyed = row_keys(docs, boxed(docs))
    key = ["_file", "_row"]
    kind = dict(docs.dtypes)["doc_id"]
    narrow = keyed.select("_in.doc_id", *key, "text")
    schema = keyed.select("_in").schema.simpleString()[len("struct<"):-1]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key, "place")
    repeated = (narrow.mapInArrow(_cut(True, ["doc_id", *key]),
                                  f"doc_id {kind}, _file long, _row long, place long, hash long, chunk binary")
                .groupBy("hash", "chunk").agg(F.count("*").alias("n"), F.min(order).alias("first"))
                .where("n > 1").drop("n"))
    repeated = written(repeated, "repeated")
    places = narrow.select(*key, "text").mapInArrow(_cut(False, key), "_file long, _row long, place long, hash long")
    drops = (places.join(repeated, "hash")
             .where(~((F.col("first._file") == F.col("_file")) & (F.col("first._row") == F.col("_row"))
                      & (F.col("first.place") == F.col("place"))))
             .groupBy(*key).agg(F.collect_list(F.struct("place", "chunk")).alias("_drops")))
    joined = keyed.join(drops, key, "left").select("_in", "text", "_drops")
    return joined.mapInArrow(_strip(strip_chunks), f"{schema}, text string, n_removed long")


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages and chunks and without the documents that nothing is left of; n_chars is counted anew."""
    out = without_repeats(docs, PASSAGE).where("n_removed = 0 or text != ''")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("_in", F.col("_in").withField("n_chars", F.when(
            F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("_in.n_chars"))))
    return unboxed(out, docs.columns)
