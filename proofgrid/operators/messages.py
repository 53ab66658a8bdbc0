"""Several messages in one image: separated messages, and predicted ones matched to expected ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Sums of scores closer than this are equal.
EQUAL = 1e-9


def separated(seed: Column, count: int, width: int = 32, least: int = 12, attempts: int = 10_000) -> Column:
    """struct<messages array<long>, attempts int>: the first count messages, drawn by hashes of the seed and the attempt,
    of which each differs from all before it in at least least bits. Fewer after all attempts is an error.

    Most seeds need few attempts, so the rest is only drawn for rows that need it.
    """
    out = F.lit(None).cast("struct<messages:array<bigint>,attempts:int>")
    for first in sorted({min(64, attempts), min(1024, attempts), attempts}, reverse=True):
        found = _first_separated(seed, count, width, least, first)
        last = first == attempts
        failed = F.raise_error(F.lit("no separated messages were found")).cast("struct<messages:array<bigint>,attempts:int>")
        out = F.when(F.size(found["messages"]) == count, found).otherwise(failed if last else out)
    return out


def _first_separated(seed: Column, count: int, width: int, least: int, attempts: int) -> Column:
    drawn = F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda k: F.struct(k.alias("k"), F.conv(F.substring(F.sha2(F.concat_ws(":", seed, k.cast("string")), 256), 1, width // 4), 16, 10).cast("long").alias("m")))
    start = F.struct(F.lit(None).cast("array<long>").alias("messages"), F.lit(0).alias("attempts"))

    def take(s: Column, x: Column) -> Column:
        have = F.coalesce(s["messages"], F.array().cast("array<long>"))
        fits = (F.size(have) < count) & F.forall(have, lambda m: F.bit_count(m.bitwiseXOR(x["m"])) >= least)
        return F.when(fits, F.struct(F.concat(have, F.array(x["m"])).alias("messages"), (x["k"] + 1).alias("attempts"))).otherwise(s)

    return F.aggregate(drawn, start, take)


def best_total(scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The largest sum of scores with one column for each row and no column twice (rows <= columns): the sum, the
    columns, and the prices of rows and columns, by shortest augmenting paths."""
    n, m = scores.shape
    cost = -scores
    row_price, column_price, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        owner[m], at = row, m  # column m is where a search begins
        least, before, seen = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            seen[at] = True
            reduced = cost[owner[at]] - row_price[owner[at]] - column_price[:m]
            nearer = ~seen[:m] & (reduced < least)
            least[nearer], before[nearer] = reduced[nearer], at
            open_ = np.where(seen[:m], np.inf, least)
            to = int(np.argmin(open_))
            step = open_[to]
            row_price[owner[seen]] += step
            column_price[seen] -= step
            least[~seen[:m]] -= step
            at = to
        while at != m:
            owner[at] = owner[before[at]]
            at = before[at]
    columns = np.empty(n, int)
    taken = np.flatnonzero(owner[:m] >= 0)
    columns[owner[taken]] = taken
    return float(scores[np.arange(n), columns].sum()), columns, row_price, column_price[:m]


def assignment(scores: np.ndarray) -> list[int]:
    """For each expected message the number (from 1) of the predicted one that it is matched with, or 0.

    As many are matched as can be, with the largest sum of scores; of equal sums the first in the order in which the
    smaller side's choices are counted up. Only choices whose price is the least are tried against the largest sum.
    """
    n, m = scores.shape
    if not n or not m:
        return [0] * n
    rows = scores if n <= m else scores.T
    best, columns, row_price, column_price = best_total(rows)
    tight = -rows - row_price[:, None] - column_price <= EQUAL
    left, taken, total = list(range(rows.shape[1])), [], 0.0
    for i in range(len(rows)):
        choices = [j for j in left if tight[i, j]]
        for j in choices:
            rest = [c for c in left if c != j]
            if len(choices) == 1 or total + rows[i, j] + best_total(rows[i + 1 :][:, rest])[0] >= best - EQUAL:
                break
        taken.append(j)
        left.remove(j)
        total += rows[i, j]
    if n <= m:
        return [j + 1 for j in taken]
    return [taken.index(k) + 1 if k in taken else 0 for k in range(n)]


@F.pandas_udf(ArrayType(IntegerType()))
def _assigned(scores: pd.Series) -> pd.Series:
    """assignment for a batch of score matrices, one of each row; a row of one side without messages has none."""
    return scores.map(lambda s: None if s is None else assignment(np.array([list(x) for x in s])) if len(s) and len(s[0]) else [0] * len(s))


def evaluate_messages(rows: DataFrame, weight: float = 0.01) -> DataFrame:
    """rows(expected, predicted: arrays of structs<bits array<int>, mask array<boolean>>) with their metrics.

    The assignment maximises bit accuracy plus weight times overlap of the masks (1 where both are empty); of equal
    ones the first. Scores and metrics are column expressions over any number of messages; the matching itself is a
    small helper over Arrow batches. Nothing expected has recall 1; a null array counts as none.
    """
    kind = {c: rows.schema[c].dataType for c in ("expected", "predicted")}
    given = rows.withColumns({f"_{c}": F.coalesce(F.col(c), F.array().cast(kind[c])) for c in kind})
    overlap = (
        "transform(_predicted, p -> transform(array(named_struct('both', size(filter(arrays_zip(x.mask, p.mask), z -> z['0'] AND z['1'])), 'any', size(filter(arrays_zip(x.mask, p.mask), z -> z['0'] OR z['1'])))), "
        "o -> IF(o.any = 0, 1D, double(o.both) / o.any))[0])"
    ).replace("arrays_zip(x.mask, p.mask)", "zip_with(x.mask, p.mask, (a, b) -> named_struct('0', a, '1', b))")
    agree = "transform(_predicted, p -> aggregate(zip_with(x.bits, p.bits, (a, b) -> int(a = b)), 0, (n, v) -> n + v) / double(size(x.bits)))"
    scored = given.withColumn("_bit", F.expr(f"transform(_expected, x -> {agree})")).withColumn("_iou", F.expr(f"transform(_expected, x -> {overlap})"))
    best = scored.withColumn("assignment", _assigned(F.expr(f"zip_with(_bit, _iou, (b, i) -> zip_with(b, i, (x, y) -> x + {weight}D * y))")))
    matched = lambda name: F.expr(f"transform(filter(sequence(1, size(assignment)), i -> size(assignment) > 0 AND get(assignment, i - 1) > 0), i -> {name}[i - 1][assignment[i - 1] - 1])")
    best = best.withColumn("_mb", matched("_bit")).withColumn("_mi", matched("_iou"))
    n, m, exact = F.size("_expected"), F.size("_predicted"), F.size(F.filter("_mb", lambda x: x == 1.0))
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)).otherwise(0.0)
    return best.select(
        *rows.columns, "assignment", (n == m).alias("count_correct"), F.size("_mb").alias("matched_count"), exact.alias("exact_match_count"), F.when(m > 0, exact / m).otherwise(0.0).alias("message_precision"),
        F.when(n > 0, exact / n).otherwise(1.0).alias("message_recall"), mean("_mb").alias("mean_matched_bit_accuracy"), ((n == m) & (exact == n)).alias("all_messages_recovered"), mean("_mi").alias("mean_matched_iou"),
    )
