"""Binary signatures of up to 62 bits: least distance, density clusters, levels of density, and soft clusters of pixels.

No step compares the pairs of a group. Words within a few bits of each other meet at a word that both reach by
flipping bits, which is an equi-join or an aggregate of (number of flips) x words.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, stored

#: Flips up to which words meet at a word between them; beyond, chunks of the words do.
FLIPS = 2


def masks(width: int, radius: int) -> list[int]:
    """All words of width bits with at most radius ones, 0 first."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in itertools.combinations(range(width), k)]


def _flips(word: str, width: int, radius: int) -> Column:
    """An array of the words within radius bits of a word. The masks are made from two lists, so the plan stays small."""
    one = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    found = F.array(F.lit(0).cast("long"))
    for _ in range(radius):
        found = F.array_distinct(F.flatten(F.transform(found, lambda m: F.transform(one, lambda o: m.bitwiseXOR(o)))))
    return F.transform(found, lambda m: F.col(word).bitwiseXOR(m))


def least_distances(words: DataFrame, group: Sequence[str], width: int = 32) -> DataFrame:
    """words(group, word) -> group, least: the least Hamming distance of two rows of a group; null for a single row.

    Equal words have distance 0. Groups without any go on with their words: two that reach one word by flipping k bits
    each are at most 2 k apart, and the aggregate of a word's neighbours tells the least distance to two of them. What
    is still open after FLIPS has no two words within 2 x FLIPS bits, so it can't be large for its width. There, words
    within r bits share one of r + 1 chunks, and r grows until every group has found its least pair.
    """
    keys = list(group)
    counted = stored(words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("times")), "words")
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times"))
    known = sizes.where("times > 1 OR n = 1").select(*keys, F.when(F.col("times") > 1, 0).alias("least"))
    known, open_ = stored(known, "known"), sizes.where("times = 1 AND n > 1").select(*keys)
    left = stored(counted.select(*keys, "word").join(open_, keys, "left_semi"), "open")
    done, radius = [known], 0
    discard(counted)
    while not left.isEmpty():
        radius += 1
        if radius <= FLIPS:
            # Of all words that reach a place, the two nearest give the least sum; equal words are one row.
            near = left.select(*keys, "word", F.explode(_flips("word", width, radius)).alias("place"))
            near = near.withColumn("d", F.bit_count(F.col("word").bitwiseXOR(F.col("place"))))
            first = near.groupBy(*keys, "place").agg(*[F.count_if(F.col("d") == k).alias(f"n{k}") for k in range(radius + 1)])
            pairs = [F.when((F.col(f"n{a}") > 0) & (F.col(f"n{b}") > (1 if a == b else 0)), a + b) for a in range(radius + 1) for b in range(a, radius + 1) if a + b]
            found = first.select(*keys, F.least(*pairs).alias("least")).where("least is not null").groupBy(*keys).agg(F.min("least").alias("least"))
        else:
            r = 2 * FLIPS + radius - FLIPS
            bounds = [width * k // (r + 1) for k in range(r + 2)]
            chunk = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("word", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("chunk")) for k, (low, high) in enumerate(itertools.pairwise(bounds))])
            parts = left.select(*keys, "word", F.explode(chunk).alias("c")).select(*keys, "word", "c.*")
            other = parts.withColumnRenamed("word", "other")
            apart = F.bit_count(F.col("word").bitwiseXOR(F.col("other")))
            found = parts.join(other, [*keys, "k", "chunk"]).where(F.col("word") < F.col("other")).groupBy(*keys).agg(F.min(apart).alias("least")).where(F.col("least") <= r)
        found = stored(found, "known")
        done.append(found)
        after = stored(left.join(found.select(*keys), keys, "left_anti"), "open")
        discard(left)
        left = after
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mean_distances(words: DataFrame, group: Sequence[str], width: int = 32) -> DataFrame:
    """words(group, word) -> group, n_pairs, mean: of all pairs, from how many words have each bit set."""
    n = F.count(F.lit(1))
    ones = [F.sum(F.shiftright("word", b).bitwiseAND(F.lit(1))) for b in range(width)]
    counted = words.groupBy(*group).agg(n.cast("long").alias("n"), F.array(*ones).alias("ones"))
    apart = F.aggregate("ones", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(20,0)") * (F.col("n") - x).cast("decimal(20,0)")).cast("decimal(38,0)"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return counted.select(*group, pairs.alias("n_pairs"), F.try_divide(apart.cast("double"), pairs.cast("double")).alias("mean"))


def supports(signatures: DataFrame, group: Sequence[str], width: int, radius: int) -> DataFrame:
    """signatures(group, word, weight, unique words) with support: the weight of all words within radius bits."""
    near = signatures.select(*group, "word", "weight", F.explode(_flips("word", width, radius)).alias("place"))
    own = F.col("place") == F.col("word")
    summed = near.groupBy(*group, "place").agg(F.sum("weight").alias("support"), F.max(F.when(own, F.col("weight"))).alias("weight"))
    return summed.where("weight is not null").select(*group, F.col("place").alias("word"), "weight", "support")


def density_clusters(signatures: DataFrame, group: Sequence[str], least: Sequence[int] | Column, width: int = 32, radius: int = 1) -> DataFrame:
    """signatures(group, word, weight) -> group, level, word, weight, core, cluster, for every word in a cluster.

    A word is a core at a level if the words within radius bits of it, itself included, weigh at least the level. Cores
    within radius of each other are in one cluster, named by its least word; another word belongs to the cluster of
    the least name that has a core within radius, or to none. least: the levels, or a column with an array of them.
    All levels and groups are clustered at once: an edge holds up to the smaller support of its ends.
    """
    keys = list(group)
    levels = least if isinstance(least, Column) else F.array(*[F.lit(x).cast("long") for x in least])
    carried = signatures.select(*keys, "word", F.col("weight").cast("long"), levels.alias("levels"))
    measured = stored(supports(carried, keys, width, radius).join(carried.select(*keys, "word", "levels"), [*keys, "word"]), "supports")
    node = lambda word: F.struct(*keys, "level", F.col(word).alias("word"))
    at_levels = measured.select(*keys, "word", "weight", "support", F.explode("levels").alias("level"))
    cores = at_levels.where("support >= level").select(*keys, "level", "word")
    reach = cores.select(*keys, "level", F.col("word").alias("core"), F.explode(_flips("word", width, radius)).alias("word"))
    links = reach.where("core <= word").join(cores, [*keys, "level", "word"]).select(node("core").alias("a"), node("word").alias("b"))
    roots = stored(components(links).select("node.*", F.col("root.word").alias("cluster")), "roots")
    touched = roots.select(*keys, "level", F.col("word").alias("core"), "cluster", F.explode(_flips("word", width, radius)).alias("word"))
    named = touched.groupBy(*keys, "level", "word").agg(F.min("cluster").alias("near"), F.max(F.when(F.col("core") == F.col("word"), F.col("cluster"))).alias("own"))
    return at_levels.join(named, [*keys, "level", "word"]).select(*keys, "level", "word", "weight", F.col("own").isNotNull().alias("core"), F.coalesce("own", "near").alias("cluster"))


@dataclass(frozen=True)
class SoftSettings:
    """The published defaults of soft clustering."""

    detection_threshold: float = 0.5
    bit_logit_threshold: float = 0.0
    bit_probability_temperature: float = 1.0
    maximum_messages: int = 4
    candidate_limit: int = 512
    seed_hamming_radius: int = 1
    minimum_message_hamming_separation: int = 5
    minimum_cluster_pixels: int = 96
    minimum_cluster_fraction: float = 0.005
    maximum_soft_hamming: float = 0.32
    assignment_temperature: float = 0.08
    refinement_iterations: int = 5
    seed_prior_strength: float = 2.0
    localization_threshold: float = 0.25
    minimum_agreement: float = 0.8
    density_schedule: tuple[int, ...] = (500, 1000, 2000, 3000)


def cluster_messages(clustered: DataFrame, group: Sequence[str], width: int) -> DataFrame:
    """density_clusters' rows -> group, level, cluster, support, centroid, message and agreement of each cluster."""
    bit = lambda b: F.shiftright("word", width - 1 - b).bitwiseAND(F.lit(1))
    summed = clustered.groupBy(*group, "level", "cluster").agg(F.sum("weight").alias("support"), F.array(*[F.sum(F.col("weight") * bit(b)) for b in range(width)]).alias("ones"))
    centroid = F.transform("ones", lambda x: x / F.col("support"))
    agreeing = F.aggregate("ones", F.lit(0).cast("long"), lambda s, x: s + F.greatest(x, F.col("support") - x))
    return summed.select(*group, "level", "cluster", "support", centroid.alias("centroid"), F.transform("ones", lambda x: (2 * x >= F.col("support")).cast("int")).alias("message"), (agreeing / (F.col("support") * width)).alias("agreement"))


def _separation(messages: Column, otherwise: int) -> Column:
    """The least number of differing bits of two messages of an array."""
    differing = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = F.flatten(F.transform(messages, lambda a, i: F.transform(F.slice(messages, i + 2, F.size(messages)), lambda b: differing(a, b))))
    return F.coalesce(F.array_min(pairs), F.lit(otherwise))


def density_solutions(clustered: DataFrame, group: Sequence[str], totals: DataFrame, width: int, settings: SoftSettings = SoftSettings()) -> DataFrame:  # noqa: B008
    """What each level finds: its largest clusters, their separation, agreement and coverage, whether it is valid, and
    whether it is the group's choice: the valid level of most clusters, then of most agreement, coverage, and the least.

    totals(group, total): the weight that coverage refers to. Levels above it find nothing.
    """
    keys = list(group)
    found = cluster_messages(clustered, keys, width).groupBy(*keys, "level").agg(
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("support", (-F.col("cluster")).alias("order"), "cluster", "centroid", "message", "agreement")))), 1, settings.maximum_messages).alias("clusters")
    )  # an array of a group's clusters; each weighs at least its level
    add = lambda field: F.aggregate("clusters", F.lit(0.0), lambda s, c: s + c[field])
    n = F.size("clusters")
    rated = found.join(totals, keys).where("level <= total").select(
        *keys, "level", "clusters", n.alias("cluster_count"), _separation(F.col("clusters.message"), width).alias("minimum_separation"), (add("agreement") / n).alias("mean_agreement"), (add("support") / F.col("total")).alias("coverage"),
    )
    valid = (F.col("minimum_separation") >= settings.minimum_message_hamming_separation) & (F.col("mean_agreement") >= settings.minimum_agreement)
    order = F.struct("cluster_count", "mean_agreement", "coverage", (-F.col("level")).alias("order"))
    chosen = rated.where(valid).groupBy(*keys).agg(F.max(order).alias("best")).select(*keys, (-F.col("best.order")).alias("chosen"))
    return rated.withColumn("valid", valid).join(chosen, keys, "left").withColumn("chosen", F.coalesce(F.col("chosen") == F.col("level"), F.lit(False)))


def greedy_seeds(measured: DataFrame, group: Sequence[str], least: DataFrame, width: int, settings: SoftSettings = SoftSettings()) -> DataFrame:  # noqa: B008
    """supports' rows and least(group, minimum_support) -> group, seeds: words by falling support, each well apart from
    those taken, until the support is too small; the first in any case. For groups without a valid level."""
    ranked = measured.groupBy(*group).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("support"), (-F.col("word")).alias("order"), F.col("word"))))).alias("ranked")).join(least, list(group))

    def take(have: Column, x: Column) -> Column:
        apart = F.forall(have, lambda h: F.bit_count(h["word"].bitwiseXOR(x["word"])) >= settings.minimum_message_hamming_separation)
        fits = (F.size(have) < settings.maximum_messages) & ((x["support"] >= F.col("minimum_support")) | (F.size(have) == 0)) & apart
        return F.when(fits, F.concat(have, F.array(x))).otherwise(have)

    start = F.slice(F.col("ranked"), 1, 0)
    bits = lambda word: F.transform(F.sequence(F.lit(width - 1), F.lit(0)), lambda b: F.call_function("shiftright", word, b.cast("int")).bitwiseAND(F.lit(1)).cast("double"))
    return ranked.select(*group, F.transform(F.aggregate("ranked", start, take), lambda s: F.struct(s["support"].cast("double").alias("support"), F.lit(None).cast("long").alias("cluster"), bits(s["word"]).alias("centroid"))).alias("seeds"))


def soft_distance(p: Column, centroid: Column) -> Column:
    """Mean difference of bit probabilities from a centroid, weighed by how sure each bit is."""
    sure = lambda x: F.greatest(F.abs(2 * x - 1), F.lit(0.05))
    total = F.aggregate(F.zip_with(p, centroid, lambda x, c: sure(x) * F.abs(x - c)), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.aggregate(p, F.lit(0.0), lambda s, x: s + sure(x)), F.lit(1e-8))


def responsibilities(distances: Column, settings: SoftSettings) -> Column:
    """Shares of the centroids in a pixel, by its distances; none if even the nearest is too far."""
    best = F.array_min(distances)
    scores = F.transform(distances, lambda d: F.exp((best - d) / settings.assignment_temperature))
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    return F.transform(scores, lambda x: F.when(best > settings.maximum_soft_hamming, 0.0).otherwise(x / F.greatest(total, F.lit(1e-12))))


def refine(pixels: DataFrame, seeds: DataFrame, group: Sequence[str], width: int, settings: SoftSettings = SoftSettings()) -> DataFrame:  # noqa: B008
    """Expectation-maximisation: pixels(group, detection, p) and seeds(group, seeds: array<struct<support, centroid, ...>>)
    -> group, seeds, centroids after all rounds, and used and support, the centroids and weights of the last expectation.

    A round is a join of the pixels with their group's centroids and one sum for each centroid and bit. It stops early
    only if no centroid moved. A seed pulls its centroid as if its support, times a strength, were pixels.
    """
    keys = list(group)
    state = stored(seeds.select(*keys, "seeds", F.col("seeds.centroid").alias("centroids")), "centroids")
    for _ in range(settings.refinement_iterations):
        met = pixels.select(*keys, "detection", "p").join(state.select(*keys, "centroids"), keys)
        shares = met.select(*keys, "detection", "p", F.posexplode(responsibilities(F.transform("centroids", lambda c: soft_distance(F.col("p"), c)), settings)).alias("k", "share"))
        weight = F.col("share") * F.col("detection")
        sums = shares.where("share > 0").groupBy(*keys, "k").agg(F.sum(weight).alias("support"), F.array(*[F.sum(weight * F.col("p")[b]) for b in range(width)]).alias("sums"))
        by_k = sums.groupBy(*keys).agg(F.collect_list(F.struct("k", "support", "sums")).alias("found"))
        joined = state.select(*keys, "seeds", F.col("centroids").alias("used")).join(by_k, keys, "left")

        def moved(c: Column, i: Column) -> Column:
            own = F.filter(F.coalesce("found", F.array().cast(by_k.schema["found"].dataType)), lambda f: f["k"] == i)[0]
            seed = F.get(F.col("seeds"), i)
            prior = seed["support"] * settings.seed_prior_strength
            to = F.transform(own["sums"], lambda s, b: (s + prior * seed["centroid"][b]) / F.greatest(own["support"] + prior, F.lit(1e-8)))
            return F.when(own["support"] > 1e-8, to).otherwise(c)

        support = F.transform("used", lambda c, i: F.coalesce(F.filter(F.col("found"), lambda f: f["k"] == i)[0]["support"], F.lit(0.0)))
        after = stored(joined.select(*keys, "seeds", "used", F.transform("used", moved).alias("centroids"), support.alias("support")), "centroids")
        discard(state)
        state = after
        if state.where("used <> centroids").isEmpty():
            break
    return state


def soft_messages(pixels: DataFrame, group: Sequence[str], place: Sequence[str], width: int = 32, settings: SoftSettings = SoftSettings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """pixels(group, place, detection, logits) -> the messages of each group and where they are.

    Messages: group, rank (0 for the most support), message, support, support_fraction, confidence, seed_fallback.
    Pixels: group, place, label (a rank, or -1), strength. A pixel counts if its detection is above the threshold; its
    hard bits are seeds by density (or greedily, where no level of density is valid), its soft ones refine them. A
    group without such pixels has no message. An image's pixels are rows; only its few centroids are one row.
    """
    keys, s = list(group), settings
    sigmoid = F.transform("logits", lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (x - s.bit_logit_threshold) / s.bit_probability_temperature)))))
    seen = stored(pixels.where(F.col("detection") > s.detection_threshold).select(*keys, *place, F.col("detection").cast("double"), sigmoid.alias("p")), "pixels")
    word = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n * 2 + F.when(x >= 0.5, 1).otherwise(0))
    counted = seen.groupBy(*keys, word.alias("word")).agg(F.count(F.lit(1)).alias("weight"))
    totals = stored(counted.groupBy(*keys).agg(F.sum("weight").alias("total")).withColumn("minimum_support", F.greatest(F.lit(float(s.minimum_cluster_pixels)), s.minimum_cluster_fraction * F.col("total"))), "totals")
    place_of = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "word"))  # the words of one image
    levels = F.array_distinct(F.concat(F.array(F.greatest(F.lit(1).cast("long"), F.ceil("minimum_support"))), F.array(*[F.lit(x).cast("long") for x in s.density_schedule])))
    candidates = stored(counted.withColumn("place", place_of).where(F.col("place") <= s.candidate_limit).drop("place").join(totals, keys), "candidates")
    clustered = stored(density_clusters(candidates, keys, levels, width, s.seed_hamming_radius), "clustered")
    solved = density_solutions(clustered, keys, totals.select(*keys, "total"), width, s).where("chosen")
    dense = stored(solved.select(*keys, "level", F.transform("clusters", lambda c: F.struct(c["support"].cast("double").alias("support"), c["cluster"].alias("cluster"), c["centroid"].alias("centroid"))).alias("seeds")), "seeds")
    rest = supports(candidates.join(dense.select(*keys), keys, "left_anti").select(*keys, "word", "weight"), keys, width, s.seed_hamming_radius)
    greedy = greedy_seeds(rest, keys, totals.select(*keys, "minimum_support"), width, s)
    seeds = dense.unionByName(greedy.withColumn("level", F.lit(None).cast("long")))
    state = stored(refine(seen, seeds, keys, width, s).join(totals, keys), "refined")

    bits = lambda c: F.transform(c, lambda x: (x >= 0.5).cast("int"))
    zipped = F.transform("seeds", lambda seed, k: F.struct(k.alias("k"), F.get("support", k).alias("support"), seed["support"].alias("seed_support"), seed["cluster"].alias("cluster"), F.get("used", k).alias("used"), F.get("centroids", k).alias("centroid"), bits(F.get("centroids", k)).alias("message"), bits(seed["centroid"]).alias("seed_message")))
    kept = state.withColumn("all", zipped).withColumn("kept", F.filter("all", lambda c: (c["support"] >= F.col("minimum_support")) | (c["seed_support"] >= F.col("minimum_support"))))
    strongest = F.filter("all", lambda c: c["support"] == F.array_max(F.col("support")))
    kept = kept.withColumn("kept", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.slice(strongest, 1, 1)))
    kept = stored(kept.withColumn("seed_fallback", _separation(F.col("kept.message"), width) < s.minimum_message_hamming_separation).drop("all", "centroids"), "kept")

    # Where refined messages have run into one another, the seeds and the clusters of their hard bits stand.
    near = seen.withColumn("word", word).join(kept.select(*keys, "kept", "seed_fallback", "used"), keys)
    hard = clustered.join(dense.select(*keys, "level"), [*keys, "level"]).select(*keys, "word", "cluster")
    near = near.join(hard, [*keys, "word"], "left")
    soft = responsibilities(F.transform("used", lambda c: soft_distance(F.col("p"), c)), s)
    share = F.transform("kept", lambda c: F.when(F.col("seed_fallback") & c["cluster"].isNotNull(), (F.coalesce(F.col("cluster") == c["cluster"], F.lit(False))).cast("double")).otherwise(F.get("soft", c["k"])))
    marked = stored(near.withColumn("soft", soft).select(*keys, *place, "detection", F.transform(share, lambda x: x * F.col("detection")).alias("shares")), "shares")
    most = s.maximum_messages
    mass = marked.groupBy(*keys).agg(F.sum("detection").alias("mass"), F.array(*[F.coalesce(F.sum(F.get("shares", F.lit(k))), F.lit(0.0)) for k in range(most)]).alias("sums"))
    final = kept.join(mass, keys).withColumn(
        "ranked", F.reverse(F.array_sort(F.transform("kept", lambda c, i: F.struct(F.get("sums", i).alias("support"), (-i).alias("order"), i.alias("i"), F.when(F.col("seed_fallback"), c["seed_message"]).otherwise(c["message"]).alias("message"), c["centroid"].alias("centroid")))))
    )
    final = stored(final.select(*keys, "ranked", "mass", "minimum_support", "seed_fallback"), "final")
    sure = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + F.abs(2 * x - 1)) / width
    each = final.select(*keys, "mass", "minimum_support", "seed_fallback", F.posexplode("ranked").alias("rank", "c"))
    messages = each.select(
        *keys, "rank", "c.message", "c.support", (F.col("c.support") / F.greatest("mass", F.lit(1e-8))).alias("support_fraction"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure(F.col("c.centroid")) * F.least(F.lit(1.0), F.col("c.support") / F.col("minimum_support")))).alias("confidence"), "seed_fallback",
    )
    labelled = marked.join(final.select(*keys, F.transform("ranked", lambda c: c["i"]).alias("order")), keys)
    values = F.transform("order", lambda i: F.get("shares", i))
    labelled = labelled.withColumn("values", values).withColumn("strength", F.array_max("values"))
    label = F.when(F.col("strength") >= s.localization_threshold, F.array_position("values", F.col("strength")).cast("int") - 1).otherwise(-1)
    return messages, labelled.select(*keys, *place, label.alias("label"), "strength")
