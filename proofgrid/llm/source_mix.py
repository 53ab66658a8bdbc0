"""Mixing sources to target weights: repetition rates from token totals, copies from hash-seeded draws.

The tokens of each source are summed up. A source's target is its weight's part of the budget, but at most MOST times
its own tokens; what is above goes to the other sources by weight, round by round, until none is above. A source's
rate is its target over its tokens, and each of its documents is taken floor(rate) times and once more if a number
from a hash of the seed and the document falls below the rest of the rate. Draws depend on the document alone, so
reruns, other partitions and other orders give the same mix, and a source comes near its target by the sum of many
independent draws.

The rounds are aggregates over one row for each source; neither the sources nor a source's documents are gathered.
Rates are sent to all tasks only where the sources are few (checked); else both sides are shuffled, and a hot source
is split by adaptive joins.

Defined cases: a null or empty text has no tokens, a null source is a source of its own and the last one; a source
without tokens has target and rate 0, so its documents aren't taken; rows with equal doc_id, source and text are told
apart by a number among themselves, so each has a draw of its own; an empty table gives an empty one; mix keeps extra
columns, whatever their names, and measure ignores them.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .store import BROADCAST_ROWS, discard, materialize, read

#: Weights of the sources in their order, repeated; the budget as a share of all tokens; copies of a document at most.
WEIGHTS, BUDGET, MOST, SEED = (5, 2, 1), Fraction(3, 2), 2, "mix"
_WIDE = "decimal(38,0)"


def tokens_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def identity_of(seed: str) -> Column:
    """128 bits that tell documents apart by doc_id, source and text; a null is told from an empty text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.md5(F.col(c).cast("string").cast("binary"))), F.lit("-"))
    return F.md5(F.concat_ws(":", F.lit(seed), part("doc_id"), part("source"), part("text")).cast("binary"))


def measure(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, identity. No shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), tokens_of(F.col("text").cast("string")).alias("size"), identity_of(seed).alias("identity"))


def cyclic_weights(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """sources(source, ...) with the weight of each, by its place in code-point order, null last."""
    placed = numbered(sources.withColumn("_unnamed", F.col("source").isNull()), ["_unnamed", "source"], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    return placed.withColumn("weight", weight.cast("long")).drop("_unnamed", "_place")


def targets(sources: DataFrame, budget: Fraction = BUDGET, most: int = MOST) -> DataFrame:
    """sources(source, source_size, weight: whole numbers) -> the same with target and rate.

    A round finds what is left of the budget for the sources below their limit, and those that it puts above it;
    these stay at the limit. All is exact: with p / q as the budget, p * sizes is compared in whole numbers.
    """
    p, q = budget.numerator, budget.denominator
    state = materialize(sources.withColumn("full", F.col("source_size") == 0), "sources", fold=True)
    size, weight = F.col("source_size").cast(_WIDE), F.col("weight").cast(_WIDE)
    while True:
        # Two numbers: the share of a source is left * weight / (q * weights).
        left, weights = state.agg((F.sum(size) * p - F.coalesce(F.sum(F.when(F.col("full"), size)), F.lit(0)) * (most * q)).cast(_WIDE), F.sum(F.when(~F.col("full"), weight)).cast(_WIDE)).first()
        left, weights = int(left or 0), int(weights or 0)
        reached = weight * F.lit(left).cast(_WIDE)
        after = materialize(state.withColumn("more", ~F.col("full") & (reached.cast(_WIDE) > (size * F.lit(most * q * weights).cast(_WIDE)).cast(_WIDE))), "sources", fold=True)
        discard(state)
        state = after.withColumn("full", F.col("full") | F.col("more")).drop("more")
        if after.where("more").isEmpty():
            break
    share = F.try_divide(reached.cast("double"), F.lit(float(weights * q))) if weights else F.lit(0.0)
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(share)
    return state.select("source", "source_size", "weight", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))


def _told_apart(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """rows(identity, ...) with a number turn from 0 among the rows of one identity, all 0 but for twins(identity).

    Rows are numbered inside the partitions of a written table, and each partition goes on where those before it end,
    so no group of equal rows meets in one task.
    """
    if twins.isEmpty():
        return rows.withColumn("turn", F.lit(0).cast("long"))
    few = twins.count() <= BROADCAST_ROWS
    side = F.broadcast(twins) if few else twins
    alone = rows.join(side, "identity", "left_anti").withColumn("turn", F.lit(0).cast("long"))
    equal = materialize(rows.join(side, "identity", "left_semi").withColumn("_part", F.spark_partition_id()), "twins")
    inside = F.row_number().over(Window.partitionBy("identity", "_part").orderBy(F.lit(0))) - 1
    sizes = equal.groupBy("identity", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("identity", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("identity").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbers = equal.withColumn("_inside", inside).join(before, ["identity", "_part"]).withColumn("turn", (F.col("_inside") + F.col("_before")).cast("long"))
    return alone.unionByName(numbers.select(*rows.columns, "turn"))


def _drawn(rows: DataFrame, measured: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """rows(source, identity, ...) with source_size, target, rate and copies. measured tells which identities repeat."""
    twins = materialize(measured.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("identity"), "twins", fold=True)
    keyed = rates.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    side = F.broadcast(keyed) if rates.count() <= BROADCAST_ROWS else keyed
    rated = _told_apart(rows, twins).join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "identity", F.col("turn").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    whole = F.floor("rate")
    return rated.withColumn("copies", F.least(whole + F.when(u < F.col("rate") - whole, 1).otherwise(0), F.lit(most)).cast("int")).drop("turn")


def _planned(docs: DataFrame, weights: Sequence[int] | DataFrame, budget: Fraction, most: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The measured documents, written, and the rates of their sources."""
    measured = materialize(measure(docs, seed), "measured")
    sources = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("long").alias("weight"))
        weighed = sources.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("weight", F.coalesce("weight", F.lit(0)))
    else:
        weighed = cyclic_weights(sources, weights)
    return measured, materialize(targets(weighed, budget, most), "rates", fold=True)


def plan_mix(docs: DataFrame, weights: Sequence[int] | DataFrame = WEIGHTS, budget: Fraction = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, rate, copies, taken (words, repeats counted)."""
    measured, rates = _planned(docs, weights, budget, most, seed)
    drawn = _drawn(measured, measured, rates, most)
    return drawn.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] | DataFrame = WEIGHTS, budget: Fraction = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns and no others.

    weights: whole numbers that the sources take in turn, or a table (source, weight); sources that it lacks weigh 0.
    """
    measured, rates = _planned(docs, weights, budget, most, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").cast("string").alias("source"), identity_of(seed).alias("identity"))
    drawn = _drawn(rows, measured, rates, most).where("copies > 0")
    return drawn.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("doc.*")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(read(spark, sf_dir, "documents"))


_PART = "coalesce('=' || md5({}::VARCHAR), '-')"
SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', '{SEED}', {_PART.format("doc_id")}, {_PART.format("source")}, {_PART.format("text")})) AS identity FROM documents),
sources AS (SELECT source, sum(size)::HUGEINT AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS w FROM sized GROUP BY source),
-- By rising limit for each unit of weight: the first k sources are at their limit, where the rest's share is below the next limit.
ranked AS (SELECT *, 2 * s / w::DOUBLE AS ratio, row_number() OVER (ORDER BY 2 * s / w::DOUBLE, source NULLS LAST) AS place FROM sources),
summed AS (SELECT *, coalesce(sum(s) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weights, sum(s) OVER ()::HUGEINT AS total FROM ranked),
cut AS (SELECT 3 * total - 4 * before AS room, weights, place FROM summed WHERE s > 0 AND (3 * total - 4 * before) * w <= 4 * s * weights ORDER BY place LIMIT 1),
rates AS (SELECT r.source, r.s::BIGINT AS source_size, CASE WHEN c.place IS NULL OR r.place < c.place THEN (2 * r.s)::DOUBLE ELSE (c.room * r.w)::DOUBLE / (2 * c.weights)::DOUBLE END AS target FROM ranked r LEFT JOIN cut c ON true),
turned AS (SELECT *, row_number() OVER (PARTITION BY identity) - 1 AS turn FROM sized),
rated AS (SELECT t.doc_id, t.source, t.size, r.source_size, r.target, CASE WHEN r.source_size = 0 THEN 0.0::DOUBLE ELSE r.target / r.source_size::DOUBLE END AS rate,
    ('0x' || substr(md5(t.identity || ':' || t.turn::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM turned t JOIN rates r ON t.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT *, least(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 2)::INTEGER AS copies FROM rated)
SELECT doc_id, source, size, source_size, target, rate, copies, copies * size AS taken FROM drawn"""
