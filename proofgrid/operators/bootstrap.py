"""Percentile bootstrap of unit means.

Hash mode draws unit numbers by a hash of (seed, iteration, draw): every engine gives the same draws. Groups of one
size share their draws, and groups of other sizes the hashes that these are remainders of. Unit numbers are cut into
blocks: a block's draws are packed bytes, and they meet the block's units in one task, where the weighted values are
summed up for all iterations.
Numpy mode runs one generator for each group and is for parity with published intervals; the units of one group must
fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import islice, pairwise
from math import fma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered_within
from .shared import stored

#: Parts of one in which values are summed up.
SCALE = 1e9


#: Unit numbers of a block, groups that meet a block's draws in one task, sizes that share hashes, draws made at once,
#: hashes joined at once, and iterations summed up at once.
BLOCK, GROUPS, SIZES, DRAWS, JOINED, ROUNDS = 8192, 32, 16, 1 << 20, 1 << 12, 128
#: Hashes that a task makes, and bytes of packed draws that it holds.
TASK_DRAWS, HELD = 1 << 22, 1 << 24


@lru_cache(maxsize=DRAWS // JOINED)
def _digits(first: int) -> list[bytes]:
    return [b"%d" % k for k in range(first, first + JOINED)]


def hashes(head: str, first: int, last: int) -> np.ndarray:
    """The first 15 hexadecimal digits of the hashes of head + draw, for draws from first, a multiple of JOINED, to last."""
    begun, found = sha256(head.encode()), np.empty(last - first, np.uint64)
    for at in range(first, last, JOINED):
        told = []
        for k in islice(_digits(at), last - at):
            one = begun.copy()  # cheaper than to begin anew
            one.update(k)
            told.append(one.digest())
        found[at - first : at - first + len(told)] = np.frombuffer(b"".join(told), ">u8")[::4]
    return found >> 4


def pack(units: np.ndarray, n: int) -> list[tuple[int, bool, bytes]]:
    """Drawn unit numbers below n -> for each block whether it is dense, and its draws: half a byte a unit, or else their places."""
    if n <= 4 * len(units):
        counts = np.bincount(units, minlength=n + n % 2)
        if counts.max() < 16:
            counts = counts.astype(np.uint8)
            halves = (counts[::2] | counts[1::2] << 4).tobytes()
            return [(b, True, halves[b * BLOCK // 2 : (b + 1) * BLOCK // 2]) for b in range(-(-n // BLOCK))]
    units = np.sort(units)
    block, places = units // BLOCK, (units % BLOCK).astype(np.uint16)
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    return [(int(block[a]), False, places[a:b].tobytes()) for a, b in pairwise(edges)]


def unpack(dense: bool, drawn: bytes, size: int) -> np.ndarray:
    """How often each unit of a block of this size was drawn."""
    if not dense:
        return np.bincount(np.frombuffer(drawn, np.uint16), minlength=size)
    pairs = np.frombuffer(drawn, np.uint8)
    return np.stack([pairs & 15, pairs >> 4], 1).reshape(-1)[:size]


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key columns, _it, _sizes, _head, _first) -> key columns, _it, _parts, _n, _block and the packed draws in that block, for each of the sizes."""
    for batch in batches:
        kept = batch.schema.names[:-3]
        fields = [batch.schema.field(c) for c in kept] + [pa.field("_parts", pa.int32()), *(pa.field(c, pa.int64()) for c in ("_n", "_block")), pa.field("_dense", pa.bool_()), pa.field("_at", pa.binary())]
        told = lambda rows, fields=fields: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], names=[f.name for f in fields])
        rows, held = [], 0
        for row in batch.to_pylist():
            first, most = row["_first"], max(size["_n"] for size in row["_sizes"])
            found = hashes(row["_head"], first, min(first + DRAWS, most))
            for n, parts in ((size["_n"], size["_parts"]) for size in row["_sizes"]):
                if n <= first:
                    continue
                mine = found[: n - first]
                packed = pack((mine - mine // n * n).astype(np.int64), n)  # the remainder, without its slow division
                rows += [(*(row[c] for c in kept), parts, n, *p) for p in packed]
                held += sum(len(p[-1]) for p in packed)
                if held >= HELD:
                    yield told(rows)
                    rows, held = [], 0
        if rows:
            yield told(rows)


def _weighed(group: Sequence[str], values: Sequence[str], iterations: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's draws and its units -> weighted sums and weights by group and iteration; a null value has no weight."""

    def run(drawn: pa.Table, units: pa.Table) -> pa.Table:
        keys = list(zip(*(units[g].to_pylist() for g in group), strict=True)) if group else [()] * units.num_rows
        column = {k: at for at, k in enumerate(dict.fromkeys(keys))} if drawn.num_rows else {}
        if column:
            places = units["_i"].to_numpy() % BLOCK
            size = int(places.max()) + 1  # a group has a unit for each number
            whole = np.zeros((size, len(column), 2 * len(values)), np.int64)
            whole[places, [column[k] for k in keys]] = np.stack([x for v in values for x in (units[v].fill_null(0).to_numpy(), units[v].is_valid().to_numpy().astype(np.int64))], 1)
            whole = whole.reshape(size, -1)
            top, real = float(np.abs(whole).max(initial=0)), whole.astype(float)
        rounds, dense, packed, sums = drawn["_it"].to_numpy(), drawn["_dense"].to_numpy(), drawn["_at"], []
        for start in range(0, iterations if column else 0, ROUNDS):
            weights = np.zeros((min(ROUNDS, iterations - start), size))
            for at in np.flatnonzero((rounds >= start) & (rounds < start + len(weights))):
                weights[rounds[at] - start] += unpack(dense[at], packed[int(at)].as_py(), size)
            # Products of whole numbers are exact in floating point as long as no sum can pass 2**53.
            exact = top * weights.sum(1).max(initial=0) < 1 << 53
            sums.append((weights @ real).astype(np.int64) if exact else weights.astype(np.int64) @ whole)
        flat = np.concatenate(sums).reshape(iterations, len(column), -1).transpose(2, 1, 0).reshape(2 * len(values), -1) if sums else np.zeros((2 * len(values), 0), np.int64)
        told = [pa.array([k[i] for k in column for _ in range(iterations)], units.schema.field(g).type) for i, g in enumerate(group)]
        names = [*group, "_it", *(f"{v}_{x}" for v in values for x in "sw")]
        return pa.Table.from_arrays([*told, pa.array(np.tile(np.arange(iterations, dtype=np.int32), len(column))), *map(pa.array, flat)], names=names)

    return run


def percentile(ordered: Sequence[float], share: float) -> float | None:
    """Between the two nearest of the ordered numbers, rounded as SQL engines on processors with a fused product and sum do."""
    if not len(ordered):
        return None
    low, rest = divmod((len(ordered) - 1) * share, 1)
    low = int(low)
    return fma(ordered[low], 1 - rest, ordered[low + 1] * rest) if rest else ordered[low]


def _bounded(group: Sequence[str], values: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """The means of a group, a row for each iteration -> its key, and for each value the 2.5 and 97.5 percentiles."""

    def run(means: pa.Table) -> pa.Table:
        ordered = {v: np.sort(means[v].drop_null().to_numpy()).tolist() for v in values}
        told = {f"{v}_{side}": pa.array([percentile(x, share)], pa.float64()) for v, x in ordered.items() for side, share in (("low", 0.025), ("high", 0.975))}
        return pa.table({g: means[g][:1] for g in group} | told)

    return run


def hash_bootstrap(units: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], iterations: int, seed: str, stratum: str | None = None) -> DataFrame:
    """group, units, and for each value its mean and the 2.5 and 97.5 percentiles of resampled means.

    Units are numbered within their group (and stratum); resampling keeps the number of units of each stratum, so
    strata weigh by their units. A null value is left out of the means. A draw is hashed once for up to SIZES sizes (of a
    stratum) and shuffled as half a byte a unit of each; a unit is shuffled to its block once.
    Values are whole billionths, so a sum is the same in any order, and so are the means and their percentiles.
    """
    strata = [stratum] if stratum else []
    whole = [F.floor(F.col(v) * SCALE + 0.5).cast("long").alias(v) for v in values]
    units = units.select(*group, *strata, *[c for c in order if c not in (*group, *strata)], *whole)
    numbered = numbered_within(units, [*group, *strata], order)
    sizes = stored(numbered.where("_i = 0").groupBy(*strata, "_n").agg(F.ceil(F.count(F.lit(1)) / GROUPS).cast("int").alias("_parts")).dropna(subset=strata or None), "sizes")
    key = F.concat_ws("/", F.lit(seed), F.col(stratum)) if stratum else F.lit(seed)
    # Sizes share hashes with the next smaller ones; a table of sizes is small, as different sizes add up to the units at most.
    falling = Window.partitionBy(*(strata or [F.lit(0)])).orderBy(F.desc("_n"))
    shared = sizes.withColumn("_shared", F.floor((F.row_number().over(falling) - 1) / SIZES)).groupBy(*strata, "_shared").agg(F.max("_n").alias("_most"), F.collect_list(F.struct("_n", "_parts")).alias("_sizes"))
    shared = stored(shared, "shared")
    rounds = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_it")).select("*", F.concat_ws(":", key, F.col("_it").cast("string"), F.lit("")).alias("_head"))
    rounds = rounds.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1, F.lit(DRAWS).cast("long"))).alias("_first"))
    # A few bytes a row stand for a lot of work, so the number of tasks is given: it goes by hashes.
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(shared.agg(F.sum("_most")).first()[0] or 0) * iterations // TASK_DRAWS))
    kinds = dict(sizes.dtypes) | dict(units.dtypes)
    by = [*strata, "_n", "_block", "_part"]
    drawn = rounds.select(*strata, "_it", "_sizes", "_head", "_first").repartition(tasks).mapInArrow(_drawn, ", ".join([*(f"`{c}` {kinds[c]}" for c in strata), "_it int, _parts int, _n long, _block long, _dense boolean, _at binary"]))
    drawn = drawn.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    placed = numbered.join(sizes, [*strata, "_n"]).select(*by[:-2], F.floor(F.col("_i") / BLOCK).alias("_block"), F.pmod(F.hash(*group) if group else F.lit(0), F.col("_parts")).alias("_part"), *group, "_i", *values)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "_it int", *(f"`{v}_s` long, `{v}_w` long" for v in values)])
    sums = drawn.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_weighed(group, values, iterations), schema)
    totals = sums.groupBy(*group, "_it").agg(*[F.sum(f"{v}_{x}").alias(f"{v}_{x}") for v in values for x in "sw"])
    means = totals.select(*group, "_it", *[F.try_divide(F.col(f"{v}_s").cast("double"), F.col(f"{v}_w") * SCALE).alias(v) for v in values])
    bounds = means.groupBy(*group).applyInArrow(_bounded(group, values), ", ".join([*(f"`{g}` {kinds[g]}" for g in group), *(f"`{v}_{side}` double" for v in values for side in ("low", "high"))]))
    point = numbered.groupBy(*group).agg(F.count(F.lit(1)).alias("units"), *[F.try_divide(F.sum(v).cast("double"), F.count(v) * SCALE).alias(f"{v}_mean") for v in values])
    return point.join(bounds, list(group)) if group else point.crossJoin(bounds)  # one row each


def paired_draws(values: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """Resampled means, one draw of all units after the other from a fresh generator."""
    rng = np.random.default_rng(seed)
    return np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(iterations)])


def stratified_draws(strata: list[np.ndarray], iterations: int, seed: int, block: int = 128) -> np.ndarray:
    """Resampled means over strata in their order, drawn block by block; strata weigh by their units."""
    rng = np.random.default_rng(seed)
    total = np.zeros(iterations)
    for values in strata:
        for at in range(0, iterations, block):
            n = min(block, iterations - at)
            total[at : at + n] += values[rng.integers(0, len(values), (n, len(values)))].sum(1)
    return total / sum(map(len, strata))


def sequential_bootstrap(units: DataFrame, group: str, order: Sequence[str], value: str, iterations: int, seed: int) -> DataFrame:
    """group, units, mean, low, high from one generator that all groups use in turn, in their order.

    What a group draws depends on those before it, so all units meet in one task: for parity with intervals that were
    published that way, on unit tables of a study. hash_bootstrap is the one for any size.
    """
    schema = f"{group} {dict(units.dtypes)[group]}, units long, mean double, low double, high double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rng, rows = np.random.default_rng(seed), []
        for key, part in frame.sort_values([group, *order]).groupby(group, sort=True):
            values = part[value].to_numpy(float)
            means = values[rng.integers(0, len(values), (iterations, len(values)))].mean(1)
            rows.append((key, len(values), values.mean(), *np.quantile(means, [0.025, 0.975])))
        return pd.DataFrame(rows)

    return units.groupBy().applyInPandas(run, schema)


def numpy_bootstrap(units: DataFrame, group: Sequence[str], order: Sequence[str], value: str, iterations: int, seed: int, stratum: str | None = None) -> DataFrame:
    """group, units, mean, low, high; NaN for a group without values. The units of a group meet in one task."""
    schema = ", ".join([*(f"{k} {dict(units.dtypes)[k]}" for k in group), "units long, mean double, low double, high double"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*([stratum] if stratum else []), *order])
        values = frame[value].to_numpy(float)
        if not len(values):
            return pd.DataFrame([(*key, 0, np.nan, np.nan, np.nan)])
        parts = [g[value].to_numpy(float) for _, g in frame.groupby(stratum)] if stratum else None
        means = stratified_draws(parts, iterations, seed) if parts else paired_draws(values, iterations, seed)
        return pd.DataFrame([(*key, len(values), values.mean(), *np.quantile(means, [0.025, 0.975]))])

    return units.groupBy(*group).applyInPandas(run, schema)
