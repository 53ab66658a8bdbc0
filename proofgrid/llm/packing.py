"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become token pieces; pieces are dealt by their row into shards of about SHARD pieces. Every shard lives on
several islands, each a task with a population of packings. The first packings are weak: best fit in random orders.
A crossover injects whole well-filled bins of one parent into the other, removes the bins that hold the same pieces
(and the receiver's loosest ones) and best-fits the displaced pieces by falling length. After each epoch an island's
elite migrates to the next island of its shard. An island stops at the lower bound (tokens / capacity, rounded up);
one that is still above it in the last epoch also takes in the packing by falling length, so no shard ends worse than
that. The loosest bins of all shards are packed again together at the end. Each row says what the search did for its
shard: bins of the best first packing, bins in the end, the bound, and the crossovers made on all islands.

Defined cases: a null or empty text is one piece of the end id alone; repeated rows are pieces of their own; an
empty table gives an empty table; a piece never exceeds the capacity, so every piece finds a place; extra columns
are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import lean, materialize, read

CAPACITY, END_ID = 4096, 1
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 16_384, 3, 2, 4, 8
#: Share of a parent's bins that a crossover injects, and of the receiver's loosest bins that it dissolves.
INJECTED, DISSOLVED = 0.2, 0.2
#: Distinct chunks whose ids a worker keeps; it starts anew beyond that.
CACHE = 600_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
#: What the search did for the shard of a piece; null for a piece that fills a sequence by itself.
WORK_SCHEMA = "first_bins int, bins int, bound int, crossovers int"

_ODD = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile("[^ \t\n\r\x0b\x0c\x85\xa0  -     　]+")
_ids_of: dict[str, dict[str, bytes]] = {}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_alphabet() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Latin letters that have one form, one lower case and one match in the split pattern, with closing marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_WRITTEN = _byte_alphabet()


def _encode_chunks(chunks: list[str], path: str, known: dict[str, bytes]) -> None:
    """Add the ids of chunks to known. A plain word and its closing marks are looked up or merged one by one, which
    gives what the whole tokenizer gives and spares its offsets; everything else goes through the whole tokenizer."""
    tokenizer = _tokenizer(path)
    merge = tokenizer.model.tokenize
    hard = []
    for chunk in chunks:
        plain = _PLAIN.fullmatch(chunk)
        if not plain:
            hard.append(chunk)
            continue
        ids = b""
        for piece in filter(None, (plain[1].lower(), plain[2])):
            found = known.get(piece)
            if found is None:
                written = piece if piece.isascii() else "".join(map(_WRITTEN.__getitem__, piece.encode()))
                found = known[piece] = b"".join([t.id.to_bytes(4, "little") for t in merge(written)])
            ids += found
        known[chunk] = ids
    for chunk, encoded in zip(hard, tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True):
        known[chunk] = np.array(encoded.ids, "<u4").tobytes()


def id_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    The vocabulary drops white space and no merge crosses it, so each chunk between white space has ids of its
    own, whatever stands beside it; chunks seen before come from a bounded cache.
    """
    known = _ids_of.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    lists = []
    for text in texts:
        # str.split also cuts at 0x1c-0x1f, which the tokenizer reads as symbols.
        lists.append([] if not text else _CHUNK.findall(text) if _ODD.search(text) else text.split())
    missing = list(set().union(*lists) - known.keys())
    if missing:
        _encode_chunks(missing, path, known)
    return [b"".join(map(known.__getitem__, chunks)) for chunks in lists]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most capacity tokens of every document, each document closed by end_id. No shuffle."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 1 << 20):
                    size += len(texts[to] or "")
                    to += 1
                rows = []
                for row, data in enumerate(id_bytes(texts[at:to], path), at):
                    data += end
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        rows.append((row, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                at = to
                row, *values = zip(*rows, strict=True)
                # An id stays in its Arrow column: as a float beside a null it would lose its last digits.
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, values, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), PIECE_SCHEMA)


def best_fit(items: np.ndarray, lengths: np.ndarray, free: list[int], assign: np.ndarray, capacity: int) -> None:
    """Put items, in the given order, into the fullest bin that has room; assign and free are changed in place."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(free):
        if room:
            stacks[room].append(b)
            mask |= 1 << room
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        assign[i] = b
        left = free[b] = room - n
        if left:
            stacks[left].append(b)
            mask |= 1 << left


class Packer:
    """The genetic operators over the packings of one shard; a packing is the bin number of each piece."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.rng = np.random.default_rng(seed)
        self.bound = -(-int(self.lengths.sum()) // capacity)

    def fills(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, weights=self.lengths).astype(np.int64)

    def fitness(self, packing: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller ones; smaller is better."""
        fills = self.fills(packing)
        return len(fills), -float(np.square(fills / self.capacity).sum())

    def packed(self, order: np.ndarray) -> np.ndarray:
        """Best fit in an order."""
        packing = np.zeros(len(self.lengths), np.int32)
        best_fit(order, self.lengths, [], packing, self.capacity)
        return packing

    def arrival(self) -> np.ndarray:
        """Best fit in a random order."""
        return self.packed(self.rng.permutation(len(self.lengths)))

    def decreasing(self) -> np.ndarray:
        """Best fit by falling length."""
        return self.packed(np.argsort(-self.lengths, kind="stable"))

    def crossover(self, into: np.ndarray, source: np.ndarray, share: float = INJECTED, dissolved: float = DISSOLVED) -> np.ndarray:
        fills = self.fills(source)
        full = np.argsort(-fills + self.rng.random(len(fills)) * 0.5 * self.capacity)[: max(1, int(share * len(fills)))]
        again = np.full(len(fills), -1, np.int64)
        again[full] = np.arange(len(full))
        injected = again[source] >= 0
        kept = np.ones(int(into.max()) + 1, bool)
        kept[into[injected]] = False
        # the loosest bins of the receiver are dissolved too: that is where a bin can be saved
        kept[np.argsort(self.fills(into))[: max(1, int(dissolved * len(kept)))]] = False
        number = np.cumsum(kept) - 1
        child = np.full(len(into), -1, np.int32)
        stay = kept[into]
        child[stay] = number[into[stay]]
        base = int(kept.sum())
        child[injected] = base + again[source[injected]]
        held = np.bincount(child[child >= 0], weights=self.lengths[child >= 0], minlength=base + len(full)).astype(np.int64)
        loose = np.flatnonzero(child < 0)
        best_fit(loose[np.argsort(-self.lengths[loose], kind="stable")], self.lengths, (self.capacity - held).tolist(), child, self.capacity)
        return child

    def evolve(self, population: list[np.ndarray], size: int, generations: int) -> tuple[list[np.ndarray], int]:
        """The fittest packings after some generations and the number of crossovers; stops at the lower bound."""
        population = sorted([*population, *(self.arrival() for _ in range(size - len(population)))], key=self.fitness)
        crossovers = 0
        for _ in range(generations):
            if self.fitness(population[0])[0] <= self.bound or len(self.lengths) < 3:
                break
            a, b = self.rng.choice(len(population), 2, replace=len(population) < 2)
            children = [self.crossover(population[min(a, b)], population[max(a, b)]), self.crossover(population[0], population[max(a, b)])]
            crossovers += len(children)
            population = sorted([*population, *children], key=self.fitness)[:size]
        return population, crossovers


_ISLAND = "shard int, island int, lengths binary, packings array<binary>, first_bins int, crossovers int"
_KINDS = {"doc_id": "<i8", "piece": "<i4", "start": "<i8", "length": "<i8", "ids_crc32": "<i8"}
_STORED = _KINDS | {"unnamed": "i1"}
_SHARD = "shard int, " + ", ".join(f"{k} binary" for k in _STORED)


def _gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one shard as arrays; unnamed marks those whose doc_id is null, which have 0 in its place."""
    frame = frame.sort_values(["length", "unnamed", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True, True])
    return pd.DataFrame([{"shard": frame.shard.iat[0]} | {k: frame[k].to_numpy(kind).tobytes() for k, kind in _STORED.items()}])


_WORK = [c.split()[0] for c in WORK_SCHEMA.split(", ")]


def _pack_shards(pieces: DataFrame, shards: int, islands: int, epochs: int, size: int, generations: int, capacity: int) -> DataFrame:
    """Pieces with the bin that the best packing of their shard gives them: RESULT_SCHEMA with the bin and the bin's fill.

    Pieces are dealt by their place in the written table, so equal ones go to all shards and each has about its share.
    """
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")
    columns = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), *list(_KINDS)[1:], F.col("doc_id").isNull().cast("int").alias("unnamed")]
    gathered = materialize(pieces.select(key, *columns).groupBy("shard").applyInPandas(_gathered, _SHARD), "shards", fold=True)

    def settle(last: bool, frame: pd.DataFrame) -> pd.DataFrame:
        lengths = np.frombuffer(frame.lengths.iat[0], "<i8")
        shard, island = int(frame.shard.iat[0]), int(frame.island.iat[0])
        population = [np.frombuffer(p, "<i4").copy() for row in frame.packings for p in row]
        packer = Packer(lengths, capacity, seed=shard * 1009 + island * 31 + len(population))
        first_bins = int(frame.first_bins.max())
        if not population:
            population = [packer.arrival() for _ in range(size)]
            first_bins = min(packer.fitness(p)[0] for p in population)
        best, crossovers = packer.evolve(population, size, generations)
        if last and packer.fitness(best[0])[0] > packer.bound:
            best = sorted([*best, packer.decreasing()], key=packer.fitness)
        crossovers += int(frame.crossovers.sum())
        return pd.DataFrame([{"shard": shard, "island": island, "lengths": frame.lengths.iat[0], "packings": [p.astype("<i4").tobytes() for p in best], "first_bins": first_bins, "crossovers": crossovers}])

    nothing = [F.lit(0).alias("first_bins"), F.lit(0).alias("crossovers")]
    state = gathered.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("length").alias("lengths"), F.expr("cast(array() as array<binary>)").alias("packings"), *nothing)
    for epoch in range(epochs):
        if epoch:
            migrants = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "lengths", F.slice("packings", 1, 1).alias("packings"), *nothing)
            state = state.unionByName(migrants)
        state = materialize(state.groupBy("shard", "island").applyInPandas((lambda last: lambda frame: settle(last, frame))(epoch == epochs - 1), _ISLAND), f"islands-{epoch}", fold=True)

    def fittest(frame: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(np.frombuffer(frame.lengths.iat[0], "<i8"), capacity, 0)
        (bins, _), _, packing = min((packer.fitness(np.frombuffer(row[0], "<i4")), island, row[0]) for island, row in zip(frame.island, frame.packings, strict=True))
        return pd.DataFrame([{"shard": frame.shard.iat[0], "packing": packing, "first_bins": frame.first_bins.min(), "bins": bins, "bound": packer.bound, "crossovers": frame.crossovers.sum()}])

    best = state.groupBy("shard").applyInPandas(fittest, f"shard int, packing binary, {WORK_SCHEMA}")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                columns = {k: np.frombuffer(getattr(row, k), kind) for k, kind in _STORED.items()}
                packing = np.frombuffer(row.packing, "<i4")
                fills = np.bincount(packing, weights=columns["length"]).astype(np.int64)
                order = np.argsort(packing, kind="stable")
                ends = np.cumsum(columns["length"][order])
                sorted_bins = packing[order]
                first = np.append(0, ends[:-1])
                begin = first[np.searchsorted(sorted_bins, sorted_bins)]
                offset = np.empty(len(order), np.int64)
                offset[order] = first - begin
                out = pd.DataFrame(columns | {"sequence_id": packing.astype(np.int64) * shards + row.shard, "offset": offset, "fill": fills[packing], "loosest": packing == int(np.argmin(fills))})
                out["doc_id"] = out["doc_id"].astype("Int64").mask(out.pop("unnamed") == 1)
                yield out.assign(**{k: getattr(row, k) for k in _WORK})

    return gathered.join(best, "shard").mapInPandas(lean(spread), f"{RESULT_SCHEMA}, fill long, loosest boolean, {WORK_SCHEMA}")


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD, islands: int = ISLANDS,
    epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS,
) -> DataFrame:
    """One row for each piece of docs (doc_id, text): its place in a sequence of at most capacity tokens."""
    pieces = materialize(token_pieces(docs, path, capacity, end_id), "pieces")
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")] + _WORK
    short = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard))
    packed = materialize(_pack_shards(short, shards, islands, epochs, population, generations, capacity), "packed", fold=True)
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")} | {k: F.lit(None).cast("int") for k in _WORK})
    if shards == 1:
        return packed.select(names).unionByName(whole.select(names))
    # Each shard leaves one loose bin; together these make few.
    loose = F.col("loosest") & (F.col("fill") < capacity)
    rest = packed.where(loose).select(*_KINDS)
    again = _pack_shards(rest, max(1, -(-rest.count() // shard)), islands, epochs, population, generations, capacity)
    return packed.where(~loose).select(names).unionByName(again.withColumn("sequence_id", F.col("sequence_id") + (1 << 60)).select(names)).unionByName(whole.select(names))


def op5_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
