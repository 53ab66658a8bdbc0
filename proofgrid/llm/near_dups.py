"""MinHash near-duplicates with ProbMinHash.

A text is the multiset of its five-word shingles (lower-cased A-Z; a text of one to four words is one shingle).
Every shingle with weight w is a Poisson process of rate w whose arrivals fall on random registers; a register
keeps the shingle that arrives first, and a text's processes end as soon as no arrival can change a register. Two
texts agree in a register with their probability Jaccard similarity. Bands of registers give candidates, and every
candidate pair is verified on its whole shingle multisets. A text that repeats a shingle also has the bands of its
shingle set, all weights 1, in the same buckets: two texts meet in those with their set Jaccard similarity. A text
without repeats has equal bands for both.

Two texts are linked if their probability Jaccard similarity, or the Jaccard similarity of their shingle sets, is
THRESHOLD or more. A class is a connected component of links, named by its least doc_id. Rows are told apart by a
number that a written table gives them, not by doc_id: one row of each class is kept, that of the class's name.

No step emits the pairs of a group. Texts with equal multisets are one representative from the start. A bucket
links its members to its least one only. After these classes are known, only buckets that still hold several
classes are looked at again: those of at most SMALL members give pairs across classes; larger ones are dealt in
blocks of about BLOCK members, each pair of blocks to a task of its own, which intersects all its shingle sets at
once as a matrix product and emits the few links that join classes. Beyond WIDE members, where blocks would send each
text many times, a bucket gives way to buckets of rare shingles: shingles are ordered by how many texts of such
buckets have them, and a text goes to the buckets of its rarest ones, up to the point where what follows is less
than the threshold of its weight. Two texts that are linked share most of either's weight, so the rarest shingle that
they share is in that part of both. Pages of one template, which have the template's shingles in common and their
rare ones not, thus never meet. So every candidate pair of different classes that can be a link is verified,
whatever the size of its bucket.

Defined cases: a null or empty text, or one of white space, has no shingle and is a class of its own; a row with
null doc_id belongs to the class of its text like any other, and the class of such rows alone has no name (null);
repeated rows are copies of one another, of which one is kept; texts under one doc_id are texts of their own, so
their classes can have one name; an empty table gives an empty one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .graph import components
from .store import discard, lean, materialize, pick, read

WORDS, THRESHOLD = 5, 0.8
#: BANDS x ROWS registers: a pair at 0.8 of either similarity has no equal band with probability (1 - 0.8**ROWS)**BANDS = 5e-5.
BANDS, ROWS = 25, 5
#: Bands of the first pass, in which most links are found; the second pass takes all.
FIRST_BANDS = 6
#: Members up to which a bucket gives pairs, members of a block of a larger one, and members up to which there are blocks:
#: beyond, blocks would send each text more than 32 times, which is about what ordering its shingles costs.
SMALL, BLOCK, WIDE = 16, 256, 8192
_SKETCH = "row long, doc_id long, n int, print1 long, print2 long, bands array<long>"


def shingles(buf: np.ndarray, off: np.ndarray, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle of a block, by text and hash."""
    buf = tb.lowered(buf)
    start, end, doc = tb.word_spans(buf, off)
    words = tb.Spans(buf).hash(start, end)
    first, keys = tb.windows(words, doc, n_words)
    owner = doc[first]
    size = np.bincount(doc, minlength=len(off) - 1)
    for k in range(1, n_words):  # short texts are one shingle
        few = np.flatnonzero(size == k)
        if len(few):
            at, key = tb.windows(words, doc, k)
            mine = np.isin(doc[at], few)
            owner, keys = np.append(owner, doc[at[mine]]), np.append(keys, key[mine])
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], keys[at], np.diff(np.append(at, len(keys)))


def prob_min_hash(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers signature of weighted elements; rows of texts without elements are 0.

    Arrivals are drawn up to a time at which all registers are most likely hit; the texts that have an empty
    register then go on for half as long again, as often as needed.
    """
    slot_key = np.zeros(n * registers, np.uint64)
    if not len(keys):
        return slot_key.reshape(n, registers)
    total = np.bincount(owner, weights=weight, minlength=n)
    with np.errstate(divide="ignore"):
        limit = registers * (np.log(registers) + 1.0) / total
    slot_time = np.full(n * registers, np.inf)
    here = np.arange(len(keys))
    time, step = np.zeros(len(keys)), np.zeros(len(keys), np.uint64)
    slot = np.zeros(len(keys), np.int64)

    def advance(at: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            step[at] += np.uint64(1)
            draw = tb.mix(keys[at] + step[at] * np.uint64(0x9E3779B97F4A7C15))
        time[at] -= np.log((((draw >> np.uint64(24)).astype(np.float64)) + 0.5) / (1 << 40)) / weight[at]
        slot[at] = owner[at] * registers + (((draw & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64)

    advance(here)
    pending = here
    while len(pending):
        active = pending[time[pending] < limit[owner[pending]]]
        times, slots, who = [], [], []
        while len(active):
            times.append(time[active])
            slots.append(slot[active])
            who.append(active)
            advance(active)
            active = active[time[active] < limit[owner[active]]]
        if times:
            t, s, w = np.concatenate(times), np.concatenate(slots), np.concatenate(who)
            order = np.argsort(-t, kind="stable")  # the earliest is written last
            t, s, w = t[order], s[order], w[order]
            best = slot_time.copy()
            best[s] = t
            first = best[s] == t
            s, t, w = s[first], t[first], w[first]
            better = t < slot_time[s]
            slot_time[s[better]] = t[better]
            slot_key[s[better]] = keys[w[better]]
        unfilled = np.isinf(slot_time.reshape(n, registers)).any(1)
        limit = np.where(unfilled, limit * 1.5, 0.0)
        pending = here[unfilled[owner]]
    return slot_key.reshape(n, registers)


def probability_jaccard(keys_a: np.ndarray, count_a: np.ndarray, keys_b: np.ndarray, count_b: np.ndarray) -> tuple[float, float]:
    """Exact probability Jaccard and set Jaccard similarity of two multisets with ascending keys."""
    at = np.searchsorted(keys_b, keys_a)
    at[at == len(keys_b)] = 0
    both = keys_b[at] == keys_a if len(keys_b) else np.zeros(len(keys_a), bool)
    common = int(both.sum())
    union = len(keys_a) + len(keys_b) - common
    plain = common / union if union else 0.0
    if not common or (count_a.max() == 1 and count_b.max() == 1):
        return plain, plain
    wa, wb = count_a[both].astype(float), count_b[at[both]].astype(float)
    only_b = np.ones(len(keys_b), bool)
    only_b[at[both]] = False
    # The sum over all elements of max(a'/a, b'/b) depends on the ratio a/b alone, but for the factor 1/a.
    all_a = np.concatenate([wa, count_a[~both], np.zeros(int(only_b.sum()))])
    all_b = np.concatenate([wb, np.zeros(int((~both).sum())), count_b[only_b]])
    with np.errstate(divide="ignore"):
        ratio = np.where(all_b > 0, all_a / np.maximum(all_b, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio = ratio[order]
    below_b = np.append(0, np.cumsum(all_b[order]))
    above_a = np.append(0, np.cumsum(all_a[order]))
    r = wa / wb
    cut = np.searchsorted(ratio, r)
    total = (above_a[-1] - above_a[cut]) + r * below_b[cut]
    return float((wa / total).sum()), plain


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, n_words: int = WORDS) -> DataFrame:
    """docs(row, doc_id, text) -> row, doc_id, number of distinct shingles, a 128-bit print of the multiset, and the band hashes. No shuffle.

    Where a shingle is repeated, the bands of the shingle set follow those of the multiset; an equal one is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = tb.mix(np.arange(1, bands + 1, dtype=np.uint64))

        def hashes(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
            signature = prob_min_hash(owner, keys, weight, n, bands * rows).reshape(n, bands, rows)
            value = np.tile(seeds, (n, 1))
            with np.errstate(over="ignore"):
                for r in range(rows):
                    value = tb.mix(value * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, r])
            return value

        for batch in batches:
            for i, j, buf, off in tb.blocks(batch.column(2)):
                owner, keys, count = shingles(buf, off, n_words)
                n = j - i
                value = hashes(owner, keys, count, n)
                repeats = np.bincount(owner[count > 1], minlength=n) > 0
                mine = repeats[owner]
                plain = hashes((np.cumsum(repeats) - 1)[owner[mine]], keys[mine], np.ones(int(mine.sum())), int(repeats.sum()))
                both = np.concatenate([value, value], axis=1)
                both[repeats, bands:] = plain
                given = np.ones((n, 2 * bands), bool)
                given[:, bands:] = repeats[:, None]  # the others have only the first
                absent = np.zeros((n, 2 * bands), bool)
                absent[:, bands:] = both[:, bands:] == value
                with np.errstate(over="ignore"):
                    size = np.bincount(owner, minlength=n)
                    prints = []
                    bounds = np.append(np.searchsorted(owner, np.arange(n)), len(owner))
                    for salt in (1, 2):
                        each = np.append(np.uint64(0), np.cumsum(tb.mix(keys * np.uint64(2 * salt + 1) + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt))))
                        prints.append((each[bounds[1:]] - each[bounds[:-1]]).view(np.int64))
                flat = pa.array(both.view(np.int64)[given], mask=absent[given])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(given.sum(1))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(size.astype(np.int32)), *map(pa.array, prints), lists], names=["row", "doc_id", "n", "print1", "print2", "bands"])

    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), _SKETCH)


def _multisets(docs: DataFrame, n_words: int) -> DataFrame:
    """docs(row, text) -> row, ascending shingle hashes and counts as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tb.blocks(batch.column(1)):
                owner, keys, count = shingles(buf, off, n_words)
                bounds = np.append(np.searchsorted(owner, np.arange(j - i)), len(owner)).tolist()
                parts = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([keys[a:b].tobytes() for a, b in parts]), pa.array([count[a:b].astype("<i4").tobytes() if (count[a:b] > 1).any() else b"" for a, b in parts])], names=["row", "keys", "counts"]
                )

    return docs.mapInArrow(lean(run), "row long, keys binary, counts binary")


def _sets_of(ids: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """The multisets of some rows, by number: only their texts are hashed again. ids has no repeats."""
    ids = materialize(ids, "picked", fold=True)
    sets = materialize(_multisets(pick(docs.select("row", F.col("text").cast("string")), ids, "row"), n_words), "multisets", fold=True)
    discard(ids)
    return sets


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4") if raw else np.ones(n, np.int32)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links among candidate pairs (a, b)."""

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for row in frame.itertuples(index=False):
                ka, kb = np.frombuffer(row.keys_a, np.uint64), np.frombuffer(row.keys_b, np.uint64)
                keep.append(max(probability_jaccard(ka, _counts(row.counts_a, len(ka)), kb, _counts(row.counts_b, len(kb)))) >= threshold)
            yield frame.loc[keep, ["a", "b"]]

    side = lambda x: sets.select(F.col("row").alias(x), F.col("keys").alias(f"keys_{x}"), F.col("counts").alias(f"counts_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInPandas(lean(test), "a long, b long")


def intersections(keys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of ascending key sets, as products of slices of their incidence matrix."""
    size = np.array([len(k) for k in keys])
    values, column, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(keys)), size)
    shared = count[column] > 1  # a shingle of one text alone is in no intersection
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(keys),) * 2, np.float32)
    width = 4096
    for start in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((len(keys), width), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        out += part @ part.T
    np.fill_diagonal(out, size)
    return out.astype(np.int64)


def _upper_bound(keys: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """No pair's probability Jaccard is above this: shingles of equal weight w add w / U (U: the sum of the larger
    weights), one of weights a and b at most min(a, b) over the smaller total. Without repeats it is exact."""
    each = [np.repeat(k, c) for k, c in zip(keys, counts, strict=True)]
    turn = [np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in counts]
    with np.errstate(over="ignore"):
        unary = [np.sort(tb.mix(k + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for k, t in zip(each, turn, strict=True)]
        equal = [np.sort(tb.mix(k * np.uint64(3) + np.repeat(c, c).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for k, c, t in zip(each, counts, turn, strict=True)]
    least, same = intersections(unary), intersections(equal)
    total = np.diag(least)
    return same / (total[:, None] + total[None, :] - least) + (least - same) / np.minimum(total[:, None], total[None, :])


def _block_links(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links that join the classes within two blocks of one bucket; at most one for each member."""
    frame = frame.drop_duplicates("rep").reset_index(drop=True)
    keys = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
    counts = [_counts(c, len(k)) for c, k in zip(frame.counts, keys, strict=True)]
    ids, roots = frame.rep.to_numpy(), frame.root.to_numpy()
    common = intersections(keys)
    size = np.diag(common)
    union = size[:, None] + size[None, :] - common
    near = common >= threshold * union
    across = np.triu(roots[:, None] != roots[None, :], 1)
    doubt = ~near & across & (_upper_bound(keys, counts) >= threshold) if any(frame.counts) else np.zeros_like(near)
    parent = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for sure, where in ((True, near), (False, doubt)):
        for i, j in np.argwhere(where & across).tolist():
            x, y = find(int(roots[i])), find(int(roots[j]))
            if x != y and (sure or probability_jaccard(keys[i], counts[i], keys[j], counts[j])[0] >= threshold):
                parent[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _rare_buckets(reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """reps(rep, root) -> bucket (a shingle), rep, root: the buckets of rare shingles that hold several classes.

    A text's shingles travel once, with their weights, and their order is the number of texts that have them.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys), pa.array(_counts(counts, len(keys)))], names=["rep", "bucket", "weight"])

    mine = sets.join(reps.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "keys", "counts")
    shingled = materialize(mine.mapInArrow(lean(spread), "rep long, bucket long, weight int"), "shingled")
    often = materialize(shingled.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")), "often", fold=True)
    # A text's own shingles, from the rarest on; what lies after one is what a link may still share if it isn't shared.
    after = Window.partitionBy("rep").orderBy("texts", "bucket").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("rep")
    placed = shingled.join(often, "bucket").select(
        "rep", "bucket", "texts", (F.sum("weight").over(after) / F.sum("weight").over(whole)).alias("heavy"), (F.count(F.lit(1)).over(after) / F.count(F.lit(1)).over(whole)).alias("many"),
    )
    rare = placed.where((F.greatest("heavy", "many") >= threshold - 1e-9) & (F.col("texts") > 1)).select("bucket", "rep")
    rooted = materialize(rare.join(reps, "rep").select("bucket", "rep", "root"), "rare", fold=True)
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    found = materialize(rooted.join(mixed, "bucket", "left_semi"), "rare", fold=True)
    discard(shingled, often, rooted)
    return found


def _sized(left: DataFrame) -> DataFrame:
    return materialize(left.join(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")), "bucket").select("bucket", "rep", "root", "members"), "mixed", fold=True)


def _across(left: DataFrame, docs: DataFrame, threshold: float, n_words: int) -> DataFrame:
    """The links across classes in buckets that hold several: left(bucket, rep, root)."""
    sized = _sized(left)
    sets = _sets_of(sized.select(F.col("rep").alias("row")).distinct(), docs, n_words)
    wide = sized.where(F.col("members") > WIDE)
    meeting = [sized.where(F.col("members") <= WIDE)]
    tables = [sized, sets]
    if not wide.isEmpty():
        rare = _rare_buckets(wide.select("rep", "root").distinct(), sets, threshold)
        meeting.append(_sized(rare))
        tables += [rare, meeting[-1]]

    small = [m.where(F.col("members") <= SMALL).select("bucket", "rep", "root") for m in meeting]
    both = [m.join(m.select("bucket", F.col("rep").alias("b"), F.col("root").alias("other")), "bucket").where("root < other").select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")) for m in small]
    pairs = materialize((both[0].unionByName(both[1]) if len(both) > 1 else both[0]).distinct(), "across", fold=True)
    links = _verified(pairs, sets, threshold)

    for m in meeting:
        large = m.where(F.col("members") > SMALL)
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        dealt = (
            large.select("bucket", "rep", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
            .select("bucket", "rep", "root", F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"))
            .join(sets.withColumnRenamed("row", "rep"), "rep")
        )
        links = links.unionByName(dealt.groupBy("bucket", "low", "high").applyInPandas(lambda frame: _block_links(frame, threshold), "a long, b long"))
    found = materialize(links.distinct(), "links", fold=True)
    discard(*tables, pairs)
    return found


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int, n_words: int) -> DataFrame:
    """docs(row, doc_id, text), written, with unique row -> row, doc_id, class_id, class_size, links, kept, for every row."""
    sketches = materialize(sketch(docs, bands, rows, n_words), "sketches")
    reps = materialize(
        sketches.where("n > 0").groupBy("print1", "print2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("name"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep")),
        "representatives", fold=True,
    )
    banded = pick(sketches.select("row", "bands"), reps.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("rep"), F.posexplode("bands").alias("band", "bucket")).where("bucket is not null")

    first = banded.where(F.col("band") % bands < FIRST_BANDS).select("rep", "bucket")
    least = first.groupBy("bucket").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", "a")
    pairs = materialize(first.join(least, "bucket").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs", fold=True)
    paired = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    sets = _sets_of(paired, docs, n_words)
    links = materialize(_verified(pairs, sets, threshold), "links", fold=True)
    discard(pairs, sets)
    roots = components(links)

    every = banded.select("rep", "bucket").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = materialize(every.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "several", fold=True)
    left = materialize(pick(every, mixed, "bucket"), "mixed", fold=True)  # where these are few, the bands stay where they are
    more = _across(left, docs, threshold, n_words)
    discard(left, mixed)
    if not more.isEmpty():
        discard(roots)
        roots = components(links.unionByName(more))

    rooted = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # Written apart, so that it is sent to all tasks where it is small and a large class is split in the join where it isn't.
    named = materialize(rooted.groupBy("root").agg(F.min("name").alias("class_id"), F.sum("copies").alias("class_size"), F.coalesce(F.min_by("keep", "name"), F.min("keep")).alias("keep")), "named", fold=True)
    ends = links.unionByName(more)
    linked = ends.select(F.col("a").alias("rep")).unionByName(ends.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("others"))
    classes = rooted.join(linked, "rep", "left").select("print1", "print2", "root", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")).join(named, "root").drop("root")
    some = F.col("n") > 0
    found = materialize(
        sketches.select("row", "doc_id", "n", "print1", "print2").join(classes, ["print1", "print2"], "left")
        .select("row", "doc_id", F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(some, F.col("class_size")).otherwise(1).alias("class_size"), F.when(some, F.col("links")).otherwise(0).alias("links"), F.when(some, F.col("row") == F.col("keep")).otherwise(True).alias("kept")),
        "classes",
    )
    discard(sketches, reps, links, more, roots, named)
    return found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, n_words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, class_id (least doc_id of its class), class_size (rows), links, kept, for every row of docs.

    links counts the other rows with the same multiset of shingles, and the representatives of others that the row's own
    was verified to be linked to while the classes were found. Pairs that are of one class already aren't compared, so
    a class of n texts has n - 1 links between different texts at least.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "rows")
    found = _classes(numbered, threshold, bands, rows, n_words)
    discard(numbered)
    return found.drop("row")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, n_words: int = WORDS) -> DataFrame:
    """One row of docs for each class, with all its columns."""
    row = next(name for name in ("_row" + "_" * k for k in range(len(docs.columns) + 1)) if name not in docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = _classes(numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), threshold, bands, rows, n_words)
    kept = materialize(found.where("kept").select(F.col("row").alias(row)), "kept", fold=True)
    discard(found)
    return pick(numbered, kept, row).drop(row)


def op6_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
