"""Alignment of two tokenizers over the same text by token spans and decoded bytes.

Side A is a byte-level BPE file of the ``tokenizers`` library and encodes a space
and the text; side B is a ``sentencepiece`` model, which puts that space itself.
Both give spans: A character offsets, B the byte spans of its proto (the library
gives them by ``return_type="proto"``; the older name of the same result was
``immutable_proto``). Spans are the coarse cuts. Where a character of several bytes
is shared by tokens of A, or falls back to byte pieces of B (whose spans are
empty but for the last), cuts are refined with the tokens' decoded bytes. Places
where tokens of both sides end cut the text into groups; the two tokens that end
there are a link.

A text is encoded in units, cut where neither side's tokens can reach across: before
white space that begins with a space and follows something else, and between ASCII
letters, digits and marks, if A's pattern parts them (it parts kinds of characters,
but for apostrophes) and no piece of B holds the two characters next to each other
(its pieces are looked through). So ids equal those of the whole text (tests compare
them), and a unit is encoded once a step and remembered.

Corpus counts: documents are written in blocks of about ``BLOCK_BYTES`` of text,
with their units and the block's distinct id pairs, as a table bucketed by block. Pairs are counted by one
shuffle of a row a block and pair; each block then gets the counts of its own
pairs back. A pair that is everywhere is a row a block, and both sides of that join
are written first, so Spark can split it. Nothing is broadcast.

Defined results: a null or empty text, and one whose tokens' bytes joined differ
from a space and the text on either side (a model that normalises, or the text
holds B's mark for a space) have no tokens: zeros and an empty hash. Texts are
encoded to their ends; a text larger than a block is one of its own. Repeated
rows are documents of their own, each counted.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, col, ready, steps, with_uid, written

#: Bytes of text of a block: the larger, the fewer units are encoded again.
BLOCK_BYTES = 4 << 20
#: Units that a Python worker remembers from one turn of its memory (see ``tokens``), and how long they may be.
REMEMBERED = 150_000
UNIT_CHARS = 64
#: Fixed value: the mark that B's pieces have for a space.
MARK = "▁"
#: Stands before a unit that has no space of its own; no piece of B may hold it, it falls back to its byte.
GUARD = "\n"
#: Kinds of ASCII characters that A's pattern parts: letters, digits, marks, and other blanks than the space.
_KINDS = {c: "letter" if c.isalpha() else "digit" if c.isdigit() else "blank" if c in "\t\n\v\f\r" else "mark"
          for c in map(chr, range(128)) if c not in " '"}
_A_SHIFT = 32
#: Units encoded by one call, and what marks those not seen before.
_AT_ONCE = 4096
_NEW = ()


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the other bytes
    in rising order for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def refined(ends: list[int], inside: list[bool], sizes: list[int]) -> list[int]:
    """Byte ends of tokens: the coarse ``ends``, but the decoded ``sizes`` where a cut lies inside a character."""
    out, at = [], 0
    for end, within, size in zip(ends, inside, sizes):
        at = at + size if within else end
        out.append(at)
    return out


class Aligner:
    """Units of text to tokens, cuts and links; one a Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_level_alphabet()
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in token):
                self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self.b_bytes, beside = [], set()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[1:-1], 16)]))
                continue
            self.b_bytes.append(piece.replace(MARK, " ").encode())
            beside.update(zip(piece, piece[1:]))
        #: By id, as the hot loops take them from lists: A's bytes, and ids as text.
        n_a = 1 + max(self.a.get_vocab(with_added_tokens=True).values(), default=-1)
        self.a_parts = [self.a_bytes.get(i, b"") for i in range(n_a)]
        self.names = [str(i) for i in range(max(n_a, len(self.b_bytes)))]
        self.cuts_at_spaces = not any(y == MARK and x != MARK for x, y in beside)
        #: Whether a unit may begin at a byte, by the byte before it and its own.
        self.cuts = np.zeros((256, 256), dtype=bool)
        if not any(GUARD in pair for pair in beside):
            for x, kind in _KINDS.items():
                for y, other in _KINDS.items():
                    self.cuts[ord(x), ord(y)] = kind not in (other, "blank") and (x, y) not in beside
        self.known: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def a_tokens(self, unit: str, raw: bytes) -> tuple[list[int], list[int]] | None:
        """Ids and byte ends, or None if the bytes aren't the unit's."""
        found = self.a.encode(unit, add_special_tokens=False)
        ids, spans = found.ids, found.offsets
        of = self.a_parts
        parts = [of[i] for i in ids]
        if b"".join(parts) != raw:
            return None
        ends = [e for _, e in spans]
        if len(raw) != len(unit):
            place = list(accumulate([1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in unit],
                                    initial=0))
            inside = [begin < end for (begin, _), end in zip(spans[1:], ends)]
            ends = [place[e] for e in ends]
            if True in inside:
                ends = refined(ends, [*inside, False], [len(p) for p in parts])
        return ids, ends

    def b_tokens(self, unit: str, raw: bytes, pieces) -> tuple[list[int], list[int]] | None:
        """Ids and byte ends from the proto's ``pieces`` of ``b_text(unit)``, or None if the bytes aren't the unit's."""
        shift = 1
        if unit[0] != " ":
            if len(pieces) < 2 or self.b_bytes[pieces[1].id] != GUARD.encode():
                return None
            pieces, shift = pieces[2:], -len(GUARD)
        ids = [p.id for p in pieces]
        parts = [self.b_bytes[i] for i in ids]
        if b"".join(parts) != raw:
            return None
        ends = [p.end + shift for p in pieces]
        if len(raw) != len(unit):
            inside = [p.begin == p.end for p in pieces]
            if True in inside:
                ends = refined(ends, inside, [len(x) for x in parts])
        return ids, ends

    def align(self, unit: str, pieces) -> tuple[int, int, str, bytes] | None:
        """Number of tokens on either side, the groups as text, and the linked pairs (A's id above B's 32 bits)."""
        raw = unit.encode()
        if unit == " ":  # an empty text
            return None
        found_a, found_b = self.a_tokens(unit, raw), self.b_tokens(unit, raw, pieces)
        if found_a is None or found_b is None:
            return None
        (a, a_ends), (b, b_ends) = found_a, found_b
        names, groups, pairs = self.names, [], array("q")
        n_a, n_b = len(a), len(b)
        i = j = i0 = j0 = 0
        while i < n_a and j < n_b:
            x, y = a_ends[i], b_ends[j]
            if x == y:
                pairs.append(a[i] << _A_SHIFT | b[j])
                left = names[a[i]] if i == i0 else ",".join([names[k] for k in a[i0:i + 1]])
                right = names[b[j]] if j == j0 else ",".join([names[k] for k in b[j0:j + 1]])
                groups.append(f"{left}|{right}")
                i0 = i = i + 1
                j0 = j = j + 1
            elif x < y:
                i += 1
            else:
                j += 1
        return n_a, n_b, ";".join(groups), pairs.tobytes()

    def records(self, units: list[str]) -> list[tuple | None]:
        """``align`` of every unit; one that is remembered isn't encoded again."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        found = [known.get(u, _NEW) for u in units]
        late = [i for i, r in enumerate(found) if r is _NEW]
        for i in late:
            found[i] = before.get(units[i], _NEW)
        new = [i for i in late if found[i] is _NEW]
        for s in range(0, len(new), _AT_ONCE):
            part = new[s:s + _AT_ONCE]
            told = self.b.encode([b_text(units[i]) for i in part], return_type="proto", num_threads=1)
            for i, x in zip(part, told):
                found[i] = self.align(units[i], x.pieces)
        for i in late:
            if len(units[i]) <= UNIT_CHARS:
                known[units[i]] = found[i]
        return found


def b_text(unit: str) -> str:
    """What B is given for a unit: it puts the first space itself; a unit that begins without one stands behind a guard."""
    return unit[1:] if unit[0] == " " else GUARD + unit


#: White space beyond ASCII by its last three UTF-8 bytes (two-byte ones by their last two).
_WIDE_BLANKS = tuple(c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                                   0x3000)))
_ASCII_BLANKS = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def unit_bounds(data: np.ndarray, at: np.ndarray, tool: Aligner) -> np.ndarray:
    """Where units begin in ``data``, whose rows (each beginning with a space) begin at ``at[:-1]``."""
    if not tool.cuts_at_spaces or not len(data):
        return at[:-1]
    spaces = np.flatnonzero(data == 0x20)
    # a row's last space alone is no unit: B has its mark for a space only before or after something
    spaces = spaces[(spaces > 0) & ~np.isin(spaces + 1, at[1:])]
    last = data[spaces - 1]
    good = ~_ASCII_BLANKS[last]
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        place = spaces[wide]
        before = [data[np.maximum(place - k, 0)] for k in (1, 2, 3)]
        for blank in _WIDE_BLANKS:
            same = np.ones(len(place), dtype=bool)
            for k, byte in enumerate(reversed(blank)):
                same &= before[k] == byte
            good[wide[same]] = False
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = tool.cuts[data[:-1], data[1:]]
    begins[spaces[good]] = True
    begins[at[:-1]] = True
    return np.flatnonzero(begins)


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def aligned_block(texts: pa.Array, tool: Aligner) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray,
                                                           np.ndarray]:
    """One step of texts: per row the results that need no corpus, the bounds of its units and every unit's code; per unit
    the bounds and numbers of its pairs; the distinct pairs; and how often each is linked in the step."""
    given = pc.fill_null(texts.cast(pa.large_string()), "")
    full = pc.binary_length(given).to_numpy(zero_copy_only=False) > 0
    led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), given, pa.scalar(" ", pa.large_string()))
    if isinstance(led, pa.ChunkedArray):
        led = led.combine_chunks()
    _, offsets, body = led.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[led.offset:led.offset + len(led) + 1]
    data = np.frombuffer(body, dtype=np.uint8)[at[0]:at[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    begins = unit_bounds(data, at, tool)
    ends = np.concatenate([begins[1:], [len(data)]])
    units = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.concatenate([begins, ends[-1:]]).astype(np.int64)),
                                             pa.py_buffer(np.ascontiguousarray(data)))
    coded = units.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    records = tool.records(coded.dictionary.to_pylist())
    bad = np.array([r is None for r in records], dtype=bool)
    none = (0, 0, "", b"")
    n_a, n_b, groups, pairs = (list(x) for x in zip(*(r or none for r in records)))
    links = np.array([len(p) // 8 for p in pairs], dtype=np.int64)
    distinct, number = np.unique(np.frombuffer(b"".join(pairs), dtype=np.int64), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(links)])

    bounds = np.searchsorted(begins, at)
    first = bounds[:-1]

    def summed(values) -> np.ndarray:
        return np.add.reduceat(np.asarray(values, dtype=np.int64)[codes], first)

    ok = full & (summed(bad) == 0)
    hashes = np.array(groups, dtype=object)
    digests = []
    for s, e, fine in zip(first.tolist(), bounds[1:].tolist(), ok.tolist()):
        digests.append(hashlib.sha256(";".join(hashes[codes[s:e]].tolist()).encode()).hexdigest() if fine else "")
    n_links = np.where(ok, summed(links), 0)
    rows = {"n_a": np.where(ok, summed(n_a), 0), "n_b": np.where(ok, summed(n_b), 0), "n_groups": n_links, "n_links": n_links,
            "groups_sha256": np.array(digests, dtype=object)}
    used = np.repeat(ok, np.diff(bounds))
    times = np.bincount(codes[used], minlength=len(records))
    totals = np.bincount(number, weights=np.repeat(times, links), minlength=len(distinct)).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(bounds), 0))])
    return rows, kept, codes[used], cut, number, np.stack([distinct, totals])


_ROW = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(a_path: str, b_path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for b in steps(batches, size=BLOCK_BYTES):
            rows, bounds, codes, cut, number, pairs = aligned_block(col(b, "text"), tool)
            docs = pa.StructArray.from_arrays(
                [*(col(b, c) for c in keep), *(pa.array(rows[c], pa.int64()) for c in _ROW),
                 pa.array(rows["groups_sha256"].tolist(), pa.string()), pa.array(np.diff(bounds), pa.int32())],
                [*keep, *_ROW, "groups_sha256", "_units"])
            one = [_lists(x, [0, len(x)]) for x in (docs, pa.array(codes, pa.int32()), pa.array(np.diff(cut), pa.int32()),
                                                    pa.array(number, pa.int32()), pa.array(pairs[0]), pa.array(pairs[1]))]
            yield pa.RecordBatch.from_arrays(one, ["docs", "codes", "sizes", "numbers", "pairs", "totals"])

    return run


def _told(keep: list[str]):
    """Rows of the documents of each block, with what the corpus says of its pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                def values(name, k=i):
                    return col(b, name)[k].values

                docs, codes = values("docs"), values("codes").to_numpy()
                sizes, numbers = values("sizes").to_numpy(), values("numbers").to_numpy()
                table = values("counts")
                count = np.zeros(len(values("pairs")), dtype=np.int64)
                best = np.zeros(len(count), dtype=np.int64)
                if table is not None and len(table):
                    at = table.field("at").to_numpy()
                    count[at], best[at] = table.field("n").to_numpy(), table.field("best").to_numpy(zero_copy_only=False)
                unit = np.repeat(np.arange(len(sizes)), sizes)
                by_unit = [np.bincount(unit, weights=x[numbers], minlength=len(sizes)).astype(np.int64) if len(numbers)
                           else np.zeros(len(sizes), dtype=np.int64) for x in (best, count)]
                row = np.repeat(np.arange(len(docs)), docs.field("_units").to_numpy())
                told = []
                for x in by_unit:
                    total = np.zeros(len(docs), dtype=np.int64)
                    np.add.at(total, row, x[codes] if len(codes) else np.zeros(0, dtype=np.int64))
                    told.append(pa.array(total))
                names = [*keep, *_ROW, "groups_sha256"]
                yield pa.RecordBatch.from_arrays([*(docs.field(c) for c in names), *told], [*names, "n_best", "count_sum"])

    return run


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, at, pair, n) of every block, and (pair, n, best) of the corpus: ``best`` if no pair with its B id has more."""
    own = written(blocks.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("at", "x")).select(
        "block", "at", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n")).where("n > 0"), "pairs")
    total = written(own.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << _A_SHIFT) - 1))
    most = total.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # one row an id of B's vocabulary: the side that is small by the vocabulary's size
    return own, written(total.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
                        "pair-table")


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None) -> DataFrame:
    """A row per document: the ``keep`` columns (``doc_id`` by default), n_a, n_b, n_groups, n_links, groups_sha256,
    n_best and count_sum."""
    ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    named = docs.select(*keep, *[F.col("text").cast("string").alias("text")] * ("text" not in keep))
    schema = docs.select(*keep).schema.simpleString()[len("struct<"):-1]
    rows = f"{schema}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    struct = ", ".join(f"{c}:{t}" for c, t in [*docs.select(*keep).dtypes, *((c, "bigint") for c in _ROW),
                                               ("groups_sha256", "string"), ("_units", "int")])
    blocks = bucketed(with_uid(named.mapInArrow(
        _blocks(a_path, b_path, keep), f"docs array<struct<{struct}>>, codes array<int>, sizes array<int>, "
        "numbers array<int>, pairs array<bigint>, totals array<bigint>"), "block"), "blocks", "block",
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own, total = pair_counts(blocks)
    counts = written(own.join(total.withColumnRenamed("n", "of"), "pair").groupBy("block").agg(
        F.collect_list(F.struct("at", F.col("of").alias("n"), "best")).alias("counts")), "block-counts")
    return blocks.drop("totals").join(counts, "block", "left").drop("block").mapInArrow(
        _told(keep), f"{rows}, n_best bigint, count_sum bigint")
