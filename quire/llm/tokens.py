"""Token ids of whole Arrow text columns by a word-level BPE file of the ``tokenizers`` library.

For tokenizers whose splits fall at white space at least (as those that drop it
do): every distinct word of a step is encoded once and remembered, and the ids
of all words are then laid out by numpy. Ids equal those of encoding the whole
text (tests compare them).
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a Python worker remembers from one turn of its memory; beyond them a new turn begins, and words of the
#: last turn are still known (and taken over) while it lasts.
REMEMBERED = 250_000
#: Marks that a word may end in without changing the ids before them.
_TAIL = ".,;:!?"
#: What must stand before them: letters and digits that normalising leaves as such.
_SURE = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]$"

_loaded: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = (Tokenizer.from_file(path), {}, {})
    return _loaded[path]


def _encode(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the bounds of each word's."""
    tokenizer, known, before = _tokenizer(path)
    if len(known) > REMEMBERED:
        before, known = known, {}
        _loaded[path] = (tokenizer, known, before)
    found = []
    for w in words:
        ids = known.get(w)
        if ids is None:
            ids = before.get(w)
            if ids is None:
                # Word by word: Spark runs a task per core, so the library's threads would only wait for each other.
                ids = array("I", tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
            known[w] = ids
        found.append(ids)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4)])
    return np.frombuffer(b"".join(found), dtype=np.uint32), bounds


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _laid(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[bounds[c]:bounds[c + 1]]`` for each code c, end to end, and their bounds."""
    size = np.diff(bounds)[codes]
    ends = np.cumsum(size)
    at = np.repeat(bounds[:-1][codes] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], np.concatenate([[0], ends]).astype(np.int64)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and the bounds of each row's; a null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    raw = coded.dictionary
    if not len(raw):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
    body = pc.utf8_rtrim(raw, characters=_TAIL)
    body = pc.if_else(pc.match_substring_regex(body, _SURE), body, raw)
    cut_off = pc.binary_length(raw).to_numpy() - pc.binary_length(body).to_numpy()
    has = np.flatnonzero(cut_off)
    ended = raw.take(pa.array(has)).to_numpy(zero_copy_only=False)
    tail = np.full(len(raw), "", dtype=object)
    tail[has] = [w[-n:] for w, n in zip(ended, cut_off[has].tolist())]  # one byte a mark
    tail = pa.array(tail, pa.large_string())
    plain = pc.and_(pc.string_is_ascii(body), pc.invert(pc.match_substring(body, "<|")))
    body = pc.if_else(plain, pc.ascii_lower(body), body)
    bodies, tails = body.dictionary_encode(), tail.dictionary_encode()
    flat, cut = _encode(path, [*_strings(bodies.dictionary), *_strings(tails.dictionary)])
    pairs = np.stack([bodies.indices.to_numpy(), tails.indices.to_numpy() + len(bodies.dictionary)], axis=1).ravel()
    flat, cut = _laid(flat, cut, pairs)
    codes = coded.indices.to_numpy()
    ids, ends = _laid(flat, cut[::2], codes)
    return ids, ends[bounds - bounds[0]]
