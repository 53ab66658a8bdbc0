"""LM scoring with a hidden Markov model over words.

Every word belongs to one class: frequent words are classes of their own, the others share classes by their last
bytes. Latent states emit classes; within a class a word has its smoothed share of the class's corpus count. So an
emission is P(class | state) * P(word | class), the alphabet of the states is bounded, and the counts behind it are
those of the whole training corpus. Baum-Welch runs over all training texts, each of them whole: tasks compute
expected counts by scaled forward and backward recursions, Spark adds them up, the driver holds states x classes
numbers. It stops after ITERATIONS rounds, or when a round gains less than TOLERANCE of log likelihood a token. The
backward recursion goes over HOLD positions at a time, whose forward vectors it computes again from a checkpoint, so
a text of any length fits. Scoring runs the scaled forward recursion over each whole text, which gives its exact
likelihood.

Corpus counts are one shuffle of distinct words. The TOP most frequent words (a fixed number) are sent to all
tasks; the rarer words of a text meet their counts in a join on the word: one row for each text and distinct rare
word, and one for each word. A word below the TOP may still have many rows in a large corpus, as many as texts hold
it; the join is one that adaptive execution splits where a key is hot.

Defined cases: a null or empty text is the end token alone; a word never seen has the share of one unknown word of
its class; repeated rows score alike; a null doc_id counts as held out of nothing and is trained on; an empty table
gives an empty one; without training texts all counts are 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .store import lean, materialize, read

#: Words whose counts all tasks know; words with a class of their own; classes of the others.
TOP, OWN, SHARED = 32_768, 2_047, 256
STATES, ITERATIONS, TOLERANCE = 8, 6, 1e-4
#: Tokens of the texts that a task trains on at once, and positions whose forward vectors it holds.
GROUP, HOLD = 200_000, 200_000
#: Added to each expected count.
SMOOTH_EMIT, SMOOTH_MOVE = 0.01, 1.0
CLASSES = 1 + OWN + SHARED  # class 0 is the end token
_SALT = np.uint64(0x5851F42D4C957F2D)


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and shared class of every word, A-Z lower-cased."""
    buf = tb.lowered(buf)
    start, end, doc = tb.word_spans(buf, off)
    words = tb.Spans(buf).hash(start, end)
    last = buf[end - 1].astype(np.uint64) if len(end) else np.zeros(0, np.uint64)
    before = np.where(end - start > 1, buf[np.maximum(end - 2, 0)], 0).astype(np.uint64) if len(end) else last
    shared = (tb.mix(last * np.uint64(256) + before + _SALT) % np.uint64(SHARED)).astype(np.int32)
    return doc, words, shared


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), shared (its class among the rare), n: corpus counts. Tasks merge their counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            words, shared, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words)
            words, shared, n = words[order], shared[order], n[order]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(shared[first]), pa.array(np.add.reduceat(n, first))], names=["word", "shared", "n"])

        for batch in batches:
            for _, _, buf, off in tb.blocks(batch.column(0)):
                _, words, shared = _words(buf, off)
                if not len(words):
                    continue
                found, at, n = np.unique(words, return_index=True, return_counts=True)
                held.append((found, shared[at], n.astype(np.int64)))
                size += len(found)
                if size > 3_000_000:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    return (
        docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "word long, shared int, n long")
        .groupBy("word").agg(F.min("shared").alias("shared"), F.sum("n").alias("n"))
    )


@dataclass
class Lexicon:
    """The frequent words by ascending hash, and corpus totals; its size is fixed by TOP and SHARED."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray  # 0 where the word has no class of its own
    tokens: int
    types: int
    end: int
    shared_tokens: np.ndarray
    shared_types: np.ndarray


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """counts: a materialized word_counts; texts: the number of training texts, each with one end token."""
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()  # TOP rows of three numbers
    own = counts.sparkSession.createDataFrame([(r.word,) for r in top[:OWN]], "word long")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    shared_tokens, shared_types = np.zeros(SHARED), np.zeros(SHARED)
    for r in counts.join(F.broadcast(own), "word", "left_anti").groupBy("shared").agg(F.sum("n").alias("n"), F.count("n").alias("types")).collect():  # SHARED rows
        shared_tokens[r.shared], shared_types[r.shared] = r.n, r.types
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    classes = np.where(np.arange(len(top)) < OWN, np.arange(len(top)) + 1, 0).astype(np.int32)
    n = np.array([r.n for r in top], np.int64)
    return Lexicon(words[order], n[order], classes[order], total[0] + texts, total[1] + (texts > 0), texts, shared_tokens, shared_types)


_SEQUENCES = "row string, doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, share_part double, rare_tokens long, classes binary, rare binary, rare_n binary"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """docs(doc_id, held_out, text) as class sequences, with what the frequent words add to both scores, and the rare words left to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(lex.tokens + 0.5 * (lex.types + 1))
        shared_scale = np.log10(lex.shared_tokens + 0.5 * (lex.shared_types + 1))
        end_score = np.log10(lex.end + 0.5) - scale
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, buf, off in tb.blocks(batch.column(2)):
                n = j - i
                doc, words, shared = _words(buf, off)
                at = np.searchsorted(lex.words, words)
                at[at == len(lex.words)] = 0
                known = lex.words[at] == words if len(lex.words) else np.zeros(len(words), bool)
                count = np.where(known, lex.counts[at], 0) if len(lex.words) else np.zeros(len(words), np.int64)
                own = np.where(known, lex.classes[at], 0) if len(lex.words) else np.zeros(len(words), np.int32)
                log_count = np.log10(count + 0.5)
                size = np.bincount(doc, minlength=n)
                # words with a class of their own have share 1 of it; of a rare word only the divisor is known here
                base = np.bincount(doc, weights=np.where(known, log_count, 0.0) - scale, minlength=n) + end_score
                share = np.bincount(doc, weights=np.where(own > 0, 0.0, np.where(known, log_count, 0.0) - shared_scale[shared]), minlength=n)
                n_known = np.bincount(doc, weights=known, minlength=n).astype(np.int64) + (lex.end > 0)
                seq = np.where(own > 0, own, 1 + OWN + shared).astype("<u2")
                cut = np.append(0, np.cumsum(size))
                rare_doc, rare = doc[~known], words[~known]
                order = np.lexsort((rare, rare_doc))
                rare_doc, rare = rare_doc[order], rare[order]
                first = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1]))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rare))).astype("<i4")
                rare, rare_doc = rare[first], rare_doc[first]
                edge = np.searchsorted(rare_doc, np.arange(n + 1))
                rare_tokens = np.bincount(rare_doc, weights=times, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{task}-{serial + k}" for k in range(n)]), batch.column(0).slice(i, n), batch.column(1).slice(i, n),
                        pa.array(size.astype(np.int64) + 1), pa.array(n_known), pa.array(base), pa.array(share), pa.array(rare_tokens),
                        pa.array([seq[cut[k] : cut[k + 1]].tobytes() + b"\0\0" for k in range(n)]),
                        pa.array([rare[edge[k] : edge[k + 1]].tobytes() for k in range(n)]),
                        pa.array([times[edge[k] : edge[k + 1]].tobytes() for k in range(n)]),
                    ], names=[f.split()[0] for f in _SEQUENCES.split(", ")]
                )
                serial += n

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(lean(run), _SEQUENCES)


@dataclass
class Hmm:
    """start: states, move: states x states, emit: states x classes; all are probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_guess(states: int, classes: int, seed: int = 7) -> Hmm:
    rng = np.random.default_rng(seed)
    emit = rng.dirichlet(np.full(classes, 1.0), states) + 0.5 / classes
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


class _Steps:
    """Sequences side by side, the longest first: the symbols of all that reach a position stand together, so a
    recursion goes on by slices. Parts are runs of positions of about hold symbols."""

    def __init__(self, sequences: list[np.ndarray], hmm: Hmm, hold: int):
        size = np.array([len(s) for s in sequences])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.hmm, self.likely, self.count = hmm, np.ascontiguousarray(hmm.emit.T), len(size)
        self.reach = np.searchsorted(-size, -np.arange(size[0]), side="left")  # how many sequences have this position
        self.offset = np.append(0, np.cumsum(self.reach))
        rank = np.repeat(np.arange(len(size)), size)
        position = np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size))[:-1], size)
        self.symbols = np.empty(len(rank), np.int32)
        self.symbols[self.offset[position] + rank] = np.concatenate([sequences[k] for k in self.order])
        part = self.offset[:-1] // hold
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(self.reach)).tolist()
        self.parts = list(zip(edges, edges[1:], strict=False))

    def forward(self, first: int, end: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled forward vectors and scales of positions first to end; before is the vectors at the position before."""
        place = (self.offset[first : end + 1] - self.offset[first]).tolist()
        emitted = self.likely[self.symbols[self.offset[first] : self.offset[end]]]
        alpha, norm = np.empty_like(emitted), np.empty((len(emitted), 1))
        move, ones = self.hmm.move, np.ones((len(self.hmm.move), 1))
        for k in range(end - first):
            at, to = place[k], place[k + 1]
            now, scale = alpha[at:to], norm[at:to]
            if first + k:
                np.dot(before[: to - at], move, out=now)
            else:
                now[:] = self.hmm.start
            now *= emitted[at:to]
            np.dot(now, ones, out=scale)
            now /= scale
            before = now
        return emitted, alpha, norm


def forward_scores(sequences: list[np.ndarray], hmm: Hmm, hold: int = HOLD) -> np.ndarray:
    """Natural log of the exact likelihood of each class sequence, by the scaled forward recursion."""
    if not sequences:
        return np.zeros(0)
    steps = _Steps(sequences, hmm, hold)
    total, before = np.zeros(steps.count), np.zeros((0, 0))
    for first, end in steps.parts:
        _, alpha, norm = steps.forward(first, end, before)
        before = alpha[-steps.reach[end - 1] :]
        reach = steps.reach[first:end]
        rank = np.arange(len(norm)) - np.repeat(np.append(0, np.cumsum(reach))[:-1], reach)
        total += np.bincount(rank, weights=np.log(norm[:, 0]), minlength=len(total))
    out = np.empty(len(total))
    out[steps.order] = total
    return out


def expected_counts(sequences: list[np.ndarray], hmm: Hmm, hold: int = HOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of start, moves and emissions, and the log likelihood, of whole class sequences.

    Vectors are kept for one part of about hold positions at a time. Parts are walked from the last to the first; all
    but the last are computed again from the forward vectors before them, so the counts don't depend on hold.
    """
    states, classes = hmm.emit.shape
    steps = _Steps(sequences, hmm, hold)
    before, log_likelihood = [np.zeros((0, states))], 0.0
    for first, end in steps.parts:
        kept = steps.forward(first, end, before[-1])
        before.append(kept[1][-steps.reach[end - 1] :].copy())
        log_likelihood += float(np.log(kept[2]).sum())
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    back, beta = np.ascontiguousarray(hmm.move.T), np.ones((0, states))
    for number in range(len(steps.parts) - 1, -1, -1):
        first, end = steps.parts[number]
        ahead, alpha, norm = kept if number == len(steps.parts) - 1 else steps.forward(first, end, before[number])
        ahead /= norm
        gamma = np.empty_like(alpha)
        place = (steps.offset[first : end + 1] - steps.offset[first]).tolist()
        for k in range(end - first - 1, -1, -1):
            at, to = place[k], place[k + 1]
            if len(beta) < to - at:  # sequences that end here
                beta = np.concatenate([beta, np.ones((to - at - len(beta), states))])
            gamma[at:to] = beta
            now = ahead[at:to]
            now *= beta
            beta = np.dot(now, back)
        gamma *= alpha
        gamma /= gamma.sum(1, keepdims=True)
        # The vector before each position: of the position before it in this part, or of the end of the part before.
        later = steps.reach[first + 1 : end]
        alpha_before = alpha[np.arange(place[1], place[-1]) - np.repeat(steps.reach[first : end - 1], later)]
        if first:
            moves += before[number][: place[1]].T @ ahead[: place[1]]
        else:
            starts = gamma[: place[1]].sum(0)
        moves += alpha_before.T @ ahead[place[1] :]
        symbols = steps.symbols[steps.offset[first] : steps.offset[end]]
        for state in range(states):
            emits[state] += np.bincount(symbols, weights=gamma[:, state], minlength=classes)
    return starts, hmm.move * moves, emits, log_likelihood


def grouped(sequences: Iterator[np.ndarray], size: int = GROUP) -> Iterator[list[np.ndarray]]:
    """Sequences of like length (within a factor of two) in groups of about size tokens: a step then serves many at once."""
    pools: dict[int, list[np.ndarray]] = {}
    held: dict[int, int] = {}
    for sequence in sequences:
        k = max(9, len(sequence).bit_length())
        pools.setdefault(k, []).append(sequence)
        held[k] = held.get(k, 0) + len(sequence)
        if held[k] >= size:
            yield pools.pop(k)
            del held[k]
    yield from pools.values()


def train(sequences: DataFrame, states: int = STATES, classes: int = CLASSES, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> Hmm:
    """Baum-Welch over all rows of sequences(classes binary), each a whole text."""
    hmm, likelihood = first_guess(states, classes), None
    for _ in range(iterations):
        now = hmm

        def count(batches: Iterator[pa.RecordBatch], now: Hmm = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states, 1 + states + classes + 2))
            texts = (np.frombuffer(raw.as_buffer(), "<u2").copy() for batch in batches for raw in batch.column(0))
            for group in grouped(texts):
                start, moves, emits, log_likelihood = expected_counts(group, now)
                total[:, 0] += start
                total[:, 1 : 1 + states] += moves
                total[:, 1 + states : -2] += emits
                total[0, -2:] += log_likelihood, sum(map(len, group))
            yield pa.RecordBatch.from_arrays([pa.array(range(states), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["state", "counts"])

        rows = (
            sequences.select("classes").mapInArrow(lean(count), "state int, counts array<double>")
            .select("state", F.posexplode("counts").alias("at", "n")).where("n <> 0").groupBy("state", "at").agg(F.sum("n").alias("n"))
        )
        total = np.zeros((states, 1 + states + classes + 2))
        for r in rows.collect():  # states x (3 + states + classes) numbers at most
            total[r.state, r.at] = r.n
        start, move, emit = total[:, 0] + SMOOTH_MOVE, total[:, 1 : 1 + states] + SMOOTH_MOVE, total[:, 1 + states : -2] + SMOOTH_EMIT
        hmm = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        reached = total[0, -2] / max(total[0, -1], 1.0)
        if likelihood is not None and reached - likelihood < tolerance:
            break
        likelihood = reached
    return hmm


def score_texts(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """docs(doc_id, held_out, text): a model of the rows that aren't held out, and the scores of all rows."""
    training = docs.where(~F.col("held_out"))
    counts = materialize(word_counts(training), "words", fold=True)
    lex = lexicon(counts, training.count())
    sequences = materialize(encode(docs, lex), "sequences")
    hmm = train(sequences.where(~F.col("held_out")), states, CLASSES, iterations)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                logs = forward_scores([np.frombuffer(raw.as_buffer(), "<u2") for raw in part.column(6)], hmm)
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(logs / np.log(10))], names=[*part.schema.names[:6], "path"])

    scored = sequences.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_part", "classes", "share_part").select(
        "row", "doc_id", "held_out", "n_tokens", "n_known", F.struct("base_part", "share_part").alias("parts"), "classes"
    ).mapInArrow(lean(forward), "row string, doc_id long, held_out boolean, n_tokens long, n_known long, parts struct<base_part:double,share_part:double>, path double")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            times = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(2)]
            row = np.repeat(np.arange(len(rare)), [len(x) for x in rare])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)), pa.array(np.concatenate(times) if times else np.zeros(0, np.int32))], names=["row", "word", "times"])

    rare = sequences.where("rare_tokens > 0").select("row", "rare", "rare_n").mapInArrow(lean(unpack), "row string, word long, times int")
    looked_up = (
        rare.join(counts.select("word", "n"), "word", "left")
        .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(looked_up, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("parts.base_part") + logs).alias("base_score"), (F.col("path") + F.col("parts.share_part") + logs).alias("score"),
    )


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out")
    return score_texts(read(spark, sf_dir, "documents").select("doc_id", held_out, "text"))
