"""Toxicity by noisy-channel deobfuscation.

A word that looks disguised (digits or signs among letters, letters three times in a row, single letters set apart
by spaces or signs) is a lattice: every sign may stand for a letter, a repeated letter or a separator may be noise.
Viterbi finds the reading that a character trigram model of the corpus likes best. The restored words are then
scored by weights of whole words and word beginnings that are significantly more frequent in toxic texts. All steps
are linear in the length of a text, whatever its words look like.

The character model counts all texts of the corpus. The weights are fitted on at most FIT_ROWS labelled rows. Of
these, a row is left out only if a row with a smaller doc_id was found to be a near copy of it (COPY or more of the
Jaccard similarity of their three-word runs), so that the words of one copied text don't pass for evidence.

Defined cases: null and empty texts score as a text without evidence; without labelled rows the score is 0 to 1 by
the prior alone; repeated rows score alike; a null doc_id counts as not held out and its label isn't learnt; a
label is 1 (toxic) or 0 (clean), a null or any other one is none; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .store import PART, lean, map_texts, materialize, read

#: Bound of the fit: labelled rows looked at. All that is collected from it is bounded by these rows.
FIT_ROWS = 30_000
#: Jaccard similarity of three-word runs from which a labelled row is a near copy, and minima that find candidates.
COPY, MINIMA = 0.8, 8
#: Log-likelihood ratio that a feature must reach (one in a million would by chance, and then some).
SIGNIFICANCE = 16.0
PREFIXES = (4, 5, 6)
CACHE = 400_000

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou"}
SEPARATORS = ".-_*'~ "
CHANNEL = {"same": 0.0, "leet": -1.0, "wild": -3.0, "repeat": -0.5, "separator": -0.5, "literal": -9.0}

N_SYMBOLS = 28  # 0: a boundary, 1-26: a-z, 27: any other letter
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xC0:] = 27

# Each of these is searched once, without a way back over a long run.
_LETTER = r"[^\W\d_]"
_SIGN = "[0-9@$!|+(€*#]"
_MIXED = re.compile(rf"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}|({_LETTER})\1\1")
_APART = re.compile(r"(?:.[.\-_*'~]){2,}.")
_ANY_LETTER = re.compile(_LETTER)
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
_OUTER = " \t\n.,;:?\"“”()[]{}<>/\\"
_MARK = re.compile(r"[^\w\s]")
_THRICE = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")


def char_counts(docs: DataFrame) -> DataFrame:
    """Counts of all symbol trigrams of the corpus: at most N_SYMBOLS**3 rows, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, buf, off in tb.blocks(batch.column(0)):
                buf = buf[(buf & 0xC0) != 0x80]  # one byte for each character
                s = np.concatenate([[0, 0], _SYMBOL[buf], [0]]).astype(np.int32)
                total += np.bincount((s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | two before it), with backing off to the pair and the symbol."""
    counts = np.zeros(N_SYMBOLS**3)
    for row in char_counts(docs).toLocalIterator():
        counts[row.gram] = row.n
    tri = counts.reshape((N_SYMBOLS,) * 3)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + N_SYMBOLS)
    bi = tri.sum(0)
    bi = (bi + 5 * uni) / (bi.sum(1, keepdims=True) + 5)
    return np.log((tri + 5 * bi) / (tri.sum(2, keepdims=True) + 5))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def readings(word: str, i: int) -> tuple[list[tuple[str, float]], float | None]:
    """What the i-th sign of a lower-case word may stand for, each with its cost, and the cost of its being noise."""
    c = word[i]
    reads = [(c, CHANNEL["same"])] if c.isalpha() else [(x, CHANNEL["wild" if c in "*#" else "leet"]) for x in LEET.get(c, "")]
    if not c.isalpha():
        reads.append((c, CHANNEL["literal"]))
    if i and (c == word[i - 1] or LEET.get(c, c)[0] == LEET.get(word[i - 1], word[i - 1])[0]):
        return reads, CHANNEL["repeat"]
    return reads, CHANNEL["separator"] if c in SEPARATORS else None


def restore(word: str, model: np.ndarray) -> str:
    """The best reading of a disguised word; a state is the last two symbols of what has been read.

    A reading is a chain of its signs from the last to the first, so a step costs the same at any length.
    """
    word = word.lower()
    log = _table(model)
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i in range(len(word)):
        reads, skip = readings(word, i)
        symbols = [(x, cost, _symbol(x)) for x, cost in reads]
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in beams.items():
            if skip is not None and ((a, b) not in after or score + skip > after[a, b][0]):
                after[a, b] = (score + skip, chain)
            row = log[a][b]
            for x, cost, s in symbols:
                total = score + cost + row[s]
                if (b, s) not in after or total > after[b, s][0]:
                    after[b, s] = (total, (x, chain))
        beams = after
    _, chain = max(((score + log[a][b][0], chain) for (a, b), (score, chain) in beams.items()), key=lambda found: found[0])
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return "".join(reversed(out))


_tables: list[tuple[np.ndarray, list]] = []


def _table(model: np.ndarray) -> list:
    """The model as nested lists, whose numbers are read faster one by one; the last model's is kept."""
    if not _tables or _tables[0][0] is not model:
        _tables[:] = [(model, model.tolist())]
    return _tables[0][1]


def is_disguised(core: str) -> bool:
    """Signs next to letters, a letter three times in a row, or single letters set apart."""
    return bool(_MIXED.search(core) or (_APART.match(core) and _ANY_LETTER.search(core)))


def words_of(chunk: str, model: np.ndarray) -> str:
    """The restored word in a chunk between white space, or an empty string. Signs three times at its end are no letters."""
    core = chunk.strip(_OUTER)
    if core.isalpha():
        return (restore(core, model) if _THRICE.search(core) else core).lower()
    if core and _MARK.match(core[-1]) and len(cut := core.rstrip(core[-1])) <= len(core) - 3:
        core = cut.strip(_OUTER)
    if not core.isalpha() and is_disguised(core):
        core = restore(core, model)
    found = _CORE.search(core.lower())
    return found[0] if found else ""


def features(word: str) -> list[str]:
    """The word and its beginnings; a beginning is marked so that it isn't taken for a word."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def restored_words(text: str | None, model: np.ndarray, cache: dict[str, str]) -> set[str]:
    """The distinct restored words of a whole text, with those spelt out letter by letter."""
    if not text:
        return set()
    if len(cache) > CACHE:
        cache.clear()
    out = set()
    for chunk in set(text.split()):
        word = cache.get(chunk)
        if word is None:
            word = cache[chunk] = words_of(chunk, model)
        out.add(word)
    for run in _SPACED.finditer(text):
        letters = words_of("".join(run[0].split()), model)
        out.update(letters[i:j] for i in range(len(letters)) for j in range(i + 4, min(len(letters), i + 20) + 1))
    out.discard("")
    return out


def _runs(texts: pa.Array, n_words: int = 3) -> list[np.ndarray]:
    """Per text the ascending hashes of its distinct runs of n_words words; none for a shorter text."""
    out = []
    for i, j, buf, off in tb.blocks(texts):
        start, end, doc = tb.word_spans(buf, off)
        first, keys = tb.windows(tb.Spans(tb.lowered(buf)).hash(start, end), doc, n_words)
        bounds = np.searchsorted(doc[first], np.arange(j - i + 1))
        out += [np.unique(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _minima(runs: np.ndarray, n: int = MINIMA) -> list[int]:
    """A print of the whole set, then the least of n hash functions over it: some are equal for near copies, most likely."""
    if not len(runs):
        return []
    with np.errstate(over="ignore"):
        every = tb.mix(runs).sum()
    return (np.array([every, *(tb.mix(runs ^ seed).min() for seed in tb.mix(np.arange(1, n + 1, dtype=np.uint64)))]) >> np.uint64(1)).astype(np.int64).tolist()


def copies(sample: DataFrame, threshold: float = COPY) -> DataFrame:
    """sample(doc_id, sketch, runs): the doc_ids of rows of which a row with a smaller doc_id is a near copy.

    A row meets the least doc_id of each of its MINIMA + 1 buckets, and each such pair is verified on all runs.
    """
    spread = sample.select("doc_id", F.posexplode("sketch").alias("k", "value"))
    pairs = spread.join(spread.groupBy("k", "value").agg(F.min("doc_id").alias("first")), ["k", "value"]).where("doc_id > first").select("doc_id", "first").distinct()
    size = sample.select("doc_id", F.size("runs").alias("size"))
    alike = (
        pairs.join(size, "doc_id").join(size.select(F.col("doc_id").alias("first"), F.col("size").alias("other")), "first")
        .where(F.least("size", "other") >= threshold * F.greatest("size", "other")).select("doc_id", "first")
    )
    sets = alike.join(sample.select("doc_id", "runs"), "doc_id").join(sample.select(F.col("doc_id").alias("first"), F.col("runs").alias("others")), "first")
    common = F.size(F.array_intersect("runs", "others"))
    return sets.where(common >= threshold * (F.size("runs") + F.size("others") - common)).select("doc_id").distinct()


class Scorer:
    """Weights, and a logistic curve over the logarithm of the sum of the weights of a text's words."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], intercept: float, slope: float):
        self.model, self.weights, self.intercept, self.slope = model, weights, intercept, slope
        self.heads = {f[:3] for f in weights}  # most words begin like no feature
        self._cache: dict[str, tuple[str, float] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def weigh(self, word: str) -> float:
        if word[:3] not in self.heads:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def evidence(self, text: str | None) -> float:
        if not text:
            return 0.0
        cache = self._cache
        if len(cache) > CACHE:
            cache.clear()
        found: dict[str, float] = {}
        chunks = set(text.split())
        for chunk in chunks.difference(cache):
            word = words_of(chunk, self.model)
            weight = self.weigh(word)
            cache[chunk] = (word, weight) if weight else None
        found.update(filter(None, map(cache.__getitem__, chunks)))
        for run in _SPACED.finditer(text):
            letters = words_of("".join(run[0].split()), self.model)
            for i in range(len(letters)):
                for j in range(i + 4, min(len(letters), i + 20) + 1):
                    if weight := self.weights.get(letters[i:j], 0.0):
                        found[letters[i:j]] = weight
        return sum(found.values())

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * math.log1p(self.evidence(text)))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """docs(doc_id, text) and labels(doc_id, toxic): train rows only. fit_rows bounds the labelled rows."""
    model = char_model(docs)
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")  # at most fit_rows small rows

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        for frame in frames:
            words, runs = [sorted(restored_words(t, model, cache)) for t in frame.text], _runs(pa.array(frame.text, pa.string()))
            yield pd.DataFrame({"doc_id": frame.doc_id, "toxic": frame.toxic, "words": words, "sketch": [_minima(r) for r in runs], "runs": [r.view(np.int64) for r in runs]})

    sample = materialize(texts.mapInPandas(lean(prepare), "doc_id long, toxic int, words array<string>, sketch array<long>, runs array<long>"), "labelled")
    single = materialize(sample.join(copies(sample), "doc_id", "left_anti").select("toxic", "words"), "labelled", fold=True)

    n_toxic, n_all = single.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("toxic")).first()
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:
        return Scorer(model, {}, -2.0 if not n_toxic else 2.0, 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[toxic].update({f for w in words.as_py() for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][f] for f in part], pa.int64()), pa.array([seen[1][f] for f in part], pa.int64())], names=["feature", "clean", "toxic"])

    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = t / (t + c)
    prior = n_toxic / n_all
    gain = t * F.log(share / prior) + F.when(c > 0, c * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    rows = (
        single.mapInArrow(lean(count), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("toxic > 1").where((share > 2 * prior) & (share > 0.8) & (gain > SIGNIFICANCE)).collect()
    )  # features of many toxic rows of the sample: no more than its words
    weights = {r.feature: math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1)) for r in rows}
    weights = {f: w for f, w in weights.items() if w > 0}
    draft = Scorer(model, weights, 0.0, 1.0)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = [sum(map(draft.weigh, words)) for words in frame.words]
            yield pd.DataFrame({"toxic": frame.toxic, "x": np.round(np.log1p(sums), 1)})

    curve = single.mapInPandas(lean(weigh), "toxic int, x double").groupBy("x").agg(F.sum("toxic").alias("t"), F.count("toxic").alias("n")).collect()  # a row for each tenth
    x, hits, n = (np.array([float(r[i]) for r in curve]) for i in range(3))
    return Scorer(model, weights, *_logistic(x, hits, n))


def _logistic(x: np.ndarray, hits: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a weak prior on both."""
    design = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (hits - n * p) - ridge * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def train_rows(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def score_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs. No shuffle."""

    def judge(text: str | None) -> tuple[float, int]:
        score = scorer.score(text)
        return score, int(score >= 0.5)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return map_texts(docs, judge, "score double, predicted int", held_out)


def drop_toxic(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs that score below one half, with all their columns."""
    schema = docs.schema

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for k in range(0, batch.num_rows, PART):
                part = batch.slice(k, PART)
                yield part.filter(pa.array([scorer.score(t) < 0.5 for t in part["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), schema)


def op4_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, train_rows(read(spark, sf_dir, "labels"))))
