"""Quality rules as learned decision lists.

Statistics of whole texts are counted in the tasks; then sequential covering on
labelled statistics grows conjunctions of thresholds by information gain on two
thirds of the rows, prunes each on the last third, and takes the rows it covers
out before the next. The ordered rules become one Spark conditional expression,
so the verdict on all rows is plain column code.

Words are runs of anything but blank, tab, line feed, vertical tab, form feed
and carriage return. Repeats (lines, windows of 8 words) are found by 64-bit
hashes within a text.

Bound: at most ``SAMPLE`` labelled documents (smallest hashes of doc_id) come to
the driver as a few numbers each; statistics and verdicts cover all rows.

Defined results: a null text has no words (its counts are 0) and fails the base
rules; label rows with a null are ignored, several rows of one doc_id count as
the worst; without both qualities among the labels no rule is learned and only
the base rules reject; repeated rows are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, ready, steps, written
from .linechunks import RULES  # holds the line rule
from .words import U64, mix, words

SAMPLE = 20_000
WINDOW = 8
MOST_RULES = 12
MOST_CONDITIONS = 4
THRESHOLDS = 48
#: A rule must be right this often on the rows it was pruned on.
PRECISION = 0.9

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def _member(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars.encode())] = 1
    return out


_SYMBOL = _member("#*$%&|<>")
_MARK = _member("".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()))
_UPPER = _member("".join(chr(c) for c in range(0x41, 0x5B)))
_FIRST = np.array([(b & 0xC0) != 0x80 for b in range(256)], dtype=np.int64)  # bytes that begin a code point


def _later(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether an equal hash comes before in the same row."""
    key = mix(hashes + rows.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of every row."""
    assert "lines" in RULES
    n = len(texts)
    w, lines = words(texts, "blank"), words(texts, "lines")
    per = lambda rows, of=None: np.bincount(rows, weights=of, minlength=n).astype(np.int64)
    rows = w.rows()
    out = {"n_words": w.counts}

    def inside(member: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(member[w.data])])
        return per(rows, total[w.ends] - total[w.starts])

    out["word_chars"], out["n_symbols"] = inside(_FIRST), inside(_SYMBOL)  # symbols only occur in words
    out["n_marks"], out["n_upper"] = inside(_MARK), inside(_UPPER)
    line_rows = lines.rows()
    at = np.searchsorted(w.starts, lines.starts)
    wordy = np.diff(np.concatenate([at, [len(w.starts)]])) > 0
    out["n_lines"] = per(line_rows[wordy])
    out["n_dup_lines"] = per(line_rows[wordy], _later(line_rows[wordy], lines.hashes[wordy]))
    full = np.flatnonzero(w.full(WINDOW)[:max(0, len(rows) - WINDOW + 1)])
    _, code, often = np.unique(mix(w.grams(WINDOW)[full] + rows[full].astype(U64) * U64(0x9E3779B97F4A7C15)),
                               return_inverse=True, return_counts=True)
    twice = full[often[code] > 1]
    edge = np.zeros(len(rows) + 1, dtype=np.int64)
    edge[twice] += 1
    np.subtract.at(edge, twice + WINDOW, 1)
    out["n_repeat_words"] = per(rows, np.cumsum(edge[:-1]) > 0)
    return {c: out[c] for c in COUNTS}


def _scan(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = counts(col(b, "text"))
            yield pa.RecordBatch.from_arrays([*(col(b, c) for c in keep), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                                             [*keep, *COUNTS])

    return run


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (``doc_id`` by default) and ``COUNTS`` of every document."""
    ready(docs.sparkSession)
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.simpleString()[len("struct<"):-1]
    named = docs.select(*keep, *[F.col("text").cast("string").alias("text")] * ("text" not in keep))
    return named.mapInArrow(_scan(keep), schema + "".join(f", {c} long" for c in COUNTS))


def measures() -> dict[str, Column]:
    """What rules are made of, computed alike for learning and for the verdict."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"), "marks_per_word": share("n_marks", "n_words"),
            "upper_per_char": share("n_upper", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"), "words_per_line": share("n_words", "n_lines")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.measure)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = measures()[self.measure]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.covers(x, names)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> Rule:
    rule: list[Condition] = []
    at = np.ones(len(x), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (at & ~bad).any():
        p, n = (at & bad).sum(), (at & ~bad).sum()
        best = (0.0, None)
        for j, name in enumerate(names):
            for above in (True, False):
                v = x[at, j]
                hit = v[:, None] > cuts[j] if above else v[:, None] <= cuts[j]
                pos, neg = (hit & bad[at, None]).sum(0), (hit & ~bad[at, None]).sum(0)
                gain = pos * (np.log2((pos + 1e-9) / (pos + neg + 1e-9)) - np.log2(p / (p + n)))
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(cuts[j][k])))
        if best[1] is None:
            break
        rule.append(best[1])
        at &= best[1].covers(x, names)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    at = covered(rule, x, names)
    p, n = (at & bad).sum(), (at & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], prune: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows. ``prune`` marks the rows that rules are pruned and accepted on."""
    if not len(x):
        return []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, THRESHOLDS))) for j in range(x.shape[1])]
    left, out = np.ones(len(x), dtype=bool), []
    while len(out) < MOST_RULES:
        grow, check = left & ~prune, left & prune
        if not (grow & bad).any() or not (grow & ~bad).any() or not (check & bad).any():
            break
        rule = _grow(x[grow], bad[grow], names, cuts)
        if not rule:
            break
        tries = [rule[:k] for k in range(1, len(rule) + 1)]
        worth = [_worth(r, x[check], bad[check], names) for r in tries]
        rule = tries[int(np.argmax(worth))]
        at = covered(rule, x, names)
        good_enough = (at & check & bad).sum() >= PRECISION * max(1, (at & check).sum())
        if not good_enough or not (at & check).any():
            break
        out.append(rule)
        left &= ~at
    return out


def verdict(rules: list[Rule]) -> Column:
    """False where the first fitting rule rejects, true where none fits."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        fits = rule[0].column()
        for c in rule[1:]:
            fits = fits & c.column()
        out = out.when(fits, F.lit(False))
    return out.otherwise(F.lit(True))


def fitted_rules(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    known = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg((F.min("quality") == 0).alias("bad")).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample))
    names = list(measures())
    # one row a labelled id, however many share it
    once = (stats.where(~base_failed()).join(F.broadcast(known), "doc_id").groupBy("doc_id", "bad")
            .agg(F.min(F.struct(*COUNTS)).alias("row")).select("doc_id", "bad", "row.*"))
    rows = (once.select(*(c.alias(k) for k, c in measures().items()), "bad",
                    (F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(3)) == 0).alias("prune"), F.xxhash64("doc_id").alias("h"))
            .orderBy("h", *names).limit(sample).toPandas())
    return learn(rows[names].to_numpy(dtype=float), rows["bad"].to_numpy(dtype=bool), names, rows["prune"].to_numpy(dtype=bool))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[Rule]]:
    """doc_id, ``COUNTS``, base_failed and kept of every document; and the rules learned."""
    stats = written(statistics(docs), "statistics")
    rules = fitted_rules(stats, labels, sample)
    return stats.withColumns({"base_failed": base_failed(), "kept": verdict(rules)}), rules
