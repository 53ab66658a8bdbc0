"""Quality rules by repetition coverage.

For each text the share of word characters that lie inside repeated n-grams (of words, of several lengths, and of
signs, all hashed by one rolling hash in numpy) and the share that lies in repeated lines decide whether it is kept.
An n-gram of signs is a run of characters without a letter or digit that isn't white space and ordinary punctuation
alone, so prose and dialogue have none, while signs strewn over the words are covered by them. The limits on words
are wide: texts with a few repeated passages are ordinary. The limit on signs lies between what labelled good texts
and labelled bad ones show.

Defined cases: a null text has no words and fails the base rule, as does an empty one; rows are judged one by
one, so ties, repeated rows and extra columns change nothing; an empty table gives an empty table; a text of any
length is judged whole, in a numpy block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .store import lean, read

#: n-gram length -> largest allowed share of word characters inside n-grams that occur twice or more.
COVERAGE = {3: 0.50, 5: 0.48, 7: 0.46, 10: 0.45}
#: Largest allowed share of word characters in lines equal to an earlier line.
LINE_COVERAGE = 0.30
#: Length of the n-grams of signs, and the largest allowed share of word characters inside those that occur twice or more.
SIGNS, SIGN_COVERAGE = 3, 0.025
_ORDINARY = np.zeros(256, bool)  # white space and punctuation of prose
_ORDINARY[list(b" \t\n\v\f\r.,;:!?'\"()-")] = True
_PLAIN = np.ones(256, bool)  # letters and digits, and all bytes beyond ASCII
_PLAIN[:128] = [chr(c).isalnum() for c in range(128)]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_gram_shares array<double>, dup_sign_share double, failed_rule string"
)


def measure(buf: np.ndarray, off: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """All measures of one block of texts."""
    n = len(off) - 1
    start, end, doc = tb.word_spans(buf, off)
    chars = tb.code_points(buf)
    spans = tb.Spans(buf)
    size = chars[end] - chars[start]
    words = spans.hash(start, end)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": tb.per_text(size, doc, n)}
    hits = np.flatnonzero(_SYMBOLS[buf])
    out["n_symbols"] = np.bincount(np.searchsorted(off, hits, side="right") - 1, minlength=n).astype(np.int64)

    salt = tb.mix(np.arange(1, n + 1, dtype=np.uint64))  # equal grams of different texts must differ
    for k in lengths:
        first, keys = tb.windows(words, doc, k)
        twice = tb.repeated(keys ^ salt[doc[first]])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, first[twice], 1)
        np.add.at(edge, first[twice] + k, -1)
        inside = np.cumsum(edge[:-1]) > 0
        out[f"words_{k}"] = tb.per_text(inside, doc, n)
        out[f"chars_{k}"] = tb.per_text(np.where(inside, size, 0), doc, n)

    sign = ~_PLAIN[buf]
    mark = sign & ~_ORDINARY[buf]
    signs, marks = np.append(0, np.cumsum(sign)), np.append(0, np.cumsum(mark))
    first = np.flatnonzero((signs[SIGNS:] - signs[:-SIGNS] == SIGNS) & (marks[SIGNS:] > marks[:-SIGNS])) if len(buf) >= SIGNS else np.zeros(0, np.int64)
    owner = np.searchsorted(off, first, side="right") - 1
    first, owner = (x[first + SIGNS <= off[owner + 1]] for x in (first, owner))
    twice = first[tb.repeated(spans.hash(first, first + SIGNS) ^ salt[owner])]
    edge = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + SIGNS, -1)
    inside = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & mark)
    out["sign_chars"] = np.bincount(np.searchsorted(off, inside, side="right") - 1, minlength=n).astype(np.int64)

    breaks = np.flatnonzero(buf == 10)
    line_start = np.union1d(off[:-1][np.diff(off) > 0], breaks + 1)
    line_start = line_start[line_start < len(buf)]
    line_doc = np.searchsorted(off, line_start, side="right") - 1
    line_end = np.minimum(off[line_doc + 1], np.append(breaks, len(buf))[np.searchsorted(breaks, line_start)])
    before = np.searchsorted(start, line_start)
    after = np.searchsorted(start, line_end)
    worded = after > before
    line_start, line_end, line_doc, before, after = (x[worded] for x in (line_start, line_end, line_doc, before, after))
    keys = spans.hash(line_start, line_end) ^ salt[line_doc]
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order][1:] == keys[order][:-1]
    total = np.append(0, np.cumsum(size))
    out["n_dup_lines"] = tb.per_text(later, line_doc, n)
    out["line_chars"] = tb.per_text(np.where(later, total[after] - total[before], 0), line_doc, n)
    return out


@dataclass
class Limits:
    """Largest allowed shares of word characters in repeated n-grams by length, in repeated lines and in repeated n-grams of signs; least words."""

    coverage: dict[int, float] = field(default_factory=lambda: dict(COVERAGE))
    line: float = LINE_COVERAGE
    signs: float = SIGN_COVERAGE
    min_words: int = 50

    @property
    def lengths(self) -> tuple[int, ...]:
        return tuple(sorted({3, *self.coverage}))

    def judge(self, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Base verdict, the rule that a text fails ("" if none), and shares in lines, n-grams and n-grams of signs of measured texts."""
        chars = np.maximum(m["word_chars"], 1)
        shares = np.stack([m[f"chars_{k}"] / chars for k in self.lengths], 1)
        lines, signs = m["line_chars"] / chars, m["sign_chars"] / chars
        base = (m["n_words"] < self.min_words) | (100 * m["words_3"] > 50 * m["n_words"])
        rule = np.full(len(chars), "", object)
        for k, most in sorted(self.coverage.items(), reverse=True):
            rule[shares[:, self.lengths.index(k)] > most] = f"gram_{k}"
        rule[lines > self.line] = "line"
        rule[signs > self.signs] = f"sign_{SIGNS}"
        rule[base] = "base"
        return base, rule, lines, shares, signs


def repetition_coverage(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): measures, base verdict and verdict. No shuffle; one pass."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.blocks(batch.column(1)):
                m = measure(buf, off, limits.lengths)
                base, rule, lines, shares, signs = limits.judge(m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        *(pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "words_3")),
                        pa.array(base),
                        pa.array(rule == ""),
                        pa.array(lines),
                        pa.array(list(shares), pa.list_(pa.float64())),
                        pa.array(signs),
                        pa.array([r or None for r in rule], pa.string()),
                    ],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)


def drop_repetitive(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs that pass, with all their columns. No shuffle; one pass."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i, j, buf, off in tb.blocks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(limits.judge(measure(buf, off, limits.lengths))[1] == ""))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(read(spark, sf_dir, "documents"))


