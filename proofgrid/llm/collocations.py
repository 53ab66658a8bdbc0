"""Phrase collocation mining: exact counts of n-grams from deduplicated pieces, bucket by bucket in duckdb.

Texts are cut into pieces at punctuation and line ends. Equal pieces of one language become one row with a
multiplicity, so copies are counted once and weigh their number. Then the phrases of one word, of two and so on are
counted, a pass over the pieces for each length: a task sums up the phrases of a block of pieces and sends them,
sorted and packed, to the hash bucket of each phrase, where duckdb adds them up out of core and keeps those that
reach the least count. A phrase can only reach it if both phrases of one word less do that it begins and ends with, so
each pass leaves the others out by a Bloom filter of the phrases kept before. The filter has a fixed largest size;
what it wrongly lets through is counted and falls below the least count, so it changes the work and never the result.

A candidate's parts are phrases that were kept as well. Every cut of a candidate sends a lookup request for each part,
shuffled by language and part to where the counts are, and the answers go back to the candidate's row. What a
candidate's longer phrases say about it is summed up to their largest count before it meets the candidate. Scores are
whole numbers from decimal arithmetic.

duckdb spills to a scratch folder of its task, removed when the task ends; nothing else reads it.

Defined cases: a null text is empty, a null language is UNKNOWN; a text without a word has no piece; a piece of any
length is one row and counted whole; repeated rows count each; ties are ordered by phrase in UTF-8 byte order; an
empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .store import discard, lean, materialize, read

MAX_WORDS, LEAST, COVERED, TOP, SCALE, UNKNOWN = 4, 30, 80, 2000, 2_000_000, "und"
#: Bytes of pieces whose phrases are summed up at once.
BLOCK = 1 << 22
#: Bits of the filter for each phrase, and its largest size in bits (16 MB).
BITS_EACH, MOST_BITS, PROBES = 16, 1 << 27, 4
#: What duckdb may hold in memory before it spills.
MEMORY = "200MB"

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True
_PARTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _strings(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)))


def cut_pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text number, words joined by single spaces, and number of words of every piece of a block."""
    buf = tb.lowered(buf)
    start, end, doc = tb.word_spans(buf, off, _SEPARATORS)
    breaks = np.append(0, np.cumsum(_BREAKS[buf]))
    first = np.ones(len(start), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
    kept = ~_SEPARATORS[buf]
    joint = start[~first] - 1  # the last sign before a word that follows one in its piece
    kept[joint], buf[joint] = True, 0x20
    at = np.flatnonzero(first)
    place = np.append(0, np.cumsum(kept))
    return doc[at], _strings(buf[kept], np.append(place[start[at]], place[-1])), np.diff(np.append(at, len(start)))


def pieces(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> lang, piece, words, times: every distinct piece of a language with its multiplicity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.blocks(batch.column(1)):
                doc, text, n = cut_pieces(buf, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), text, pa.array(n.astype(np.int32))], names=["lang", "piece", "words"])

    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)), F.col("text").cast("string")).mapInArrow(lean(run), "lang string, piece string, words int")
    return cut.groupBy("lang", "piece", "words").agg(F.count(F.lit(1)).alias("times"))


class Filter:
    """A Bloom filter over 64-bit hashes; a hash that was put in is always found."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def slots(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            for k in range(PROBES):
                yield tb.mix(hashes + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(bits - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.slots(hashes, 64 * len(self.words)):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _salts(langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its language in this array, and for each language its salt."""
    coded = langs.dictionary_encode() if not isinstance(langs, pa.ChunkedArray) else langs.combine_chunks().dictionary_encode()
    salt = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in coded.dictionary.to_pylist()]
    return coded.indices.to_numpy().astype(np.int64), np.array(salt, np.uint64)


def filter_of(phrases: DataFrame) -> Filter:
    """A filter of phrases(lang, phrase): bits are set in the tasks and joined by an aggregate; its size is bounded."""
    bits = 1 << 10
    n = phrases.count()
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            code, salt = _salts(batch.column(0))
            for i, j, buf, off in tb.blocks(batch.column(1)):
                for at in Filter.slots(tb.Spans(buf).hash(off[:-1], off[1:]) ^ salt[code[i:j]], bits):
                    np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at].view(np.int64))], names=["at", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(lean(run), "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    words = np.zeros(bits // 64, np.uint64)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def _eight(buf: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n (up to 8) bytes from each place on as one number, the first byte as the highest, zeros after the end."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    value = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].copy().view(">u8").ravel().astype(np.uint64)
    return np.where(n >= 8, value, value & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(n, 7)).astype(np.uint64)))


def block_phrases(text: pa.Array, code: np.ndarray, salt: np.ndarray, times: np.ndarray, length: int, known: Filter | None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Per block of pieces: hash, language number, phrase and weight of its distinct phrases of length words, sorted by language and beginning."""
    for i, j, buf, off in tb.blocks(text, BLOCK):
        start, end, doc = tb.word_spans(buf, off)
        spans = tb.Spans(buf)
        salts = salt[code[i:j]]

        def hashes(first: np.ndarray, n: int, spans=spans, start=start, end=end, doc=doc, salts=salts) -> np.ndarray:
            return spans.hash(start[first], end[first + n - 1]) ^ salts[doc[first]]

        first = np.arange(max(0, len(start) - length + 1))
        first = first[doc[first] == doc[first + length - 1]]
        if known is not None:
            shorter = np.arange(max(0, len(start) - length + 2))
            inside = doc[shorter] == doc[shorter + length - 2]
            inside[inside] = known.has(hashes(shorter[inside], length - 1))
            first = first[inside[first] & inside[first + 1]]
        key = hashes(first, length)
        a, n = start[first], end[first + length - 1] - start[first]
        head, tail = _eight(buf, a, n), _eight(buf, np.maximum(a + n - 8, a), n)
        order = np.argsort(key, kind="stable")
        # Equal hashes of different phrases would only be rows of their own: length, beginning and end are compared as well.
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (key, n, head, tail)])
        at = np.flatnonzero(new)
        weight = np.add.reduceat(times[i:j][doc[first[order]]], at) if len(at) else np.zeros(0, np.int64)
        one = order[at]
        lang = code[i:j][doc[first[one]]]
        by = np.lexsort((head[one], lang))
        one, weight, lang = one[by], weight[by], lang[by]
        size = n[one]
        ends = np.cumsum(size)
        where = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64)
        where += np.repeat((a[one] - (ends - size)).astype(where.dtype), size)
        yield key[one], lang, _strings(buf[where], np.append(0, ends)), weight


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, _PARTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue()


def _gathered(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.Table]:
    """Batches joined to tables of about size bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def count_phrases(cut: DataFrame, length: int, known: Filter | None = None, least: int = LEAST) -> DataFrame:
    """pieces(lang, piece, times) -> lang, phrase, f for each phrase of length words that occurs least times or more."""
    buckets = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            if not len(table):
                continue
            code, salt = _salts(table["lang"])
            names = table["lang"].combine_chunks().dictionary_encode().dictionary
            for key, lang, phrase, weight in block_phrases(table["piece"].combine_chunks(), code, salt, table["times"].to_numpy(), length, known):
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows = pa.RecordBatch.from_arrays([names.take(pa.array(lang[order])), phrase.take(pa.array(order)), pa.array(weight[order])], schema=_PARTS)
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_packed(rows.slice(bounds[b], bounds[b + 1] - bounds[b])) for b in some.tolist()], pa.binary())], names=["bucket", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        unpacked = (rows for batch in batches for packed in batch.column(1) for rows in pa.ipc.open_stream(packed.as_buffer()))
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
            con.register("parts", pa.RecordBatchReader.from_batches(_PARTS, unpacked))
            yield from con.sql(f"SELECT lang, phrase, sum(n)::BIGINT AS f FROM parts GROUP BY lang, phrase HAVING sum(n) >= {least}").to_arrow_reader(10_000)

    sent = cut.select("lang", "piece", "times").mapInArrow(lean(split), "bucket int, rows binary").repartitionById(buckets, "bucket")
    return sent.mapInArrow(lean(add), "lang string, phrase string, f long")


def frequent_phrases(cut: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> list[DataFrame]:
    """Written tables lang, phrase, f of the phrases of 1 to max_words words that occur least times or more."""
    out = [materialize(count_phrases(cut, 1, None, least), "phrases-1", fold=True)]
    for n in range(2, max_words + 1):
        out.append(materialize(count_phrases(cut, n, filter_of(out[-1]), least), f"phrases-{n}", fold=True))
    return out


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(candidates: DataFrame, counts: DataFrame, max_words: int = MAX_WORDS, scale: int = SCALE) -> DataFrame:
    """candidates(lang, phrase, words, a) with l, r and score of their lowest-scoring cut.

    counts(lang, phrase, f) has every part. Each cut asks for its two parts; requests and counts meet by part.
    """
    k, words = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), ["lang", "phrase", "words", "a"]
    cuts = candidates.select(*words, k)
    side = lambda n, c: F.struct(F.lit(n).alias("side"), c.alias("part"))
    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - words)")
    requests = cuts.select(*words, "k", F.explode(F.array(side(0, first), side(1, rest))).alias("s")).select(*words, "k", "s.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    of = lambda k, n: F.max(F.when((F.col("k") == k) & (F.col("side") == n), F.col("f")))
    met = answers.groupBy(*words).agg(*[of(k, n).alias(f"{'lr'[n]}{k}") for k in range(1, max_words) for n in (0, 1)])
    score = lambda k: F.expr(f"(cast(a AS decimal(20,0)) * {scale}) div (cast(l{k} AS decimal(20,0)) + cast(r{k} AS decimal(20,0)))")
    lowest = F.array_min(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_words)]))
    return met.withColumn("cut", lowest).select(*words, "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """candidates(lang, phrase, words, a) without those inside a longer one that has covered % of their count or more."""
    w = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", "words", F.col("a").alias("longer"), w.alias("w"))
    spans = longer.select("lang", "longer", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    inner = spans.select("lang", "longer", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    inside = F.coalesce(_wide("longer") * 100 >= _wide("a") * covered, F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").where(~inside).drop("longer")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first top rows of each language by score, count and phrase, with their rank.

    Parts of a language are ranked first, so its rows don't meet in one task; what meets is top rows of each part.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score."""
    cut = materialize(pieces(docs), "cut")
    totals = materialize(cut.groupBy("lang").agg(F.sum(F.col("words") * F.col("times")).alias("n")), "words", fold=True)
    levels = frequent_phrases(cut, max_words, least)
    discard(cut)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    candidates = levels[1].withColumn("words", F.lit(2))
    for n, level in enumerate(levels[2:], 3):
        candidates = candidates.unionByName(level.withColumn("words", F.lit(n)))
    candidates = candidates.withColumnRenamed("f", "a")
    best = ranked(scored(uncovered(candidates, covered), counts, max_words, scale), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = f"""
WITH cut AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w, count(*) AS times FROM cut GROUP BY ALL),
totals AS (SELECT lang, sum(len(w) * times)::BIGINT AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, sum(times)::HUGEINT AS f FROM pieces, range(1, {MAX_WORDS + 1}) t(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) GROUP BY ALL HAVING sum(times) >= {LEAST}),
candidates AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE words > 1),
inside AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM candidates, range(2, {MAX_WORDS}) t(k), LATERAL (SELECT unnest(range(1, words - k + 2)) AS i) WHERE k < words GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE NOT coalesce(100 * i.longer >= {COVERED} * c.a, false)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM kept, range(1, {MAX_WORDS}) t(k) WHERE k < words),
scores AS (SELECT c.lang, c.phrase, c.a, min({{'score': {SCALE} * c.a // (x.f + y.f), 'k': k, 'l': x.f, 'r': y.f}}) AS best FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest GROUP BY c.lang, c.phrase, c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank FROM scores)
SELECT r.lang, rank, phrase, a::BIGINT AS a, best.l::BIGINT AS l, best.r::BIGINT AS r, n, best.score::BIGINT AS score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= {TOP}"""
