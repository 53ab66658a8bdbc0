"""Queries over binary signatures and soft predictions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import signatures
from .registry import register, rounded
from .standins import table

_WIDTH, _LEVELS = 10, [3, 5, 8, 14]
_SETTINGS = replace(signatures.SoftSettings(), minimum_message_hamming_separation=2, minimum_agreement=0.6, maximum_messages=3)
_WORD = "list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:{n}], lambda x: (x > 0)::BIGINT)), lambda n, b: n * 2 + b)"

_NEAR_SQL = f"""words AS (SELECT (label % 4)::INTEGER AS image, {_WORD.format(n=_WIDTH)} AS word, count(*) AS weight FROM embeddings GROUP BY ALL),
near AS (SELECT a.image, a.word, b.word AS other, b.weight FROM words a JOIN words b ON a.image = b.image AND bit_count(xor(a.word, b.word)) <= 1),
supports AS (SELECT image, word, sum(weight)::BIGINT AS support FROM near GROUP BY ALL)"""
_CLUSTERS_SQL = f"""{_NEAR_SQL}, levels AS (SELECT unnest({_LEVELS})::BIGINT AS level),
cores AS (SELECT level, image, word FROM supports JOIN levels ON support >= level),
edges AS (SELECT c.level, c.image, c.word, n.other FROM cores c JOIN near n ON n.image = c.image AND n.word = c.word JOIN cores d ON d.level = c.level AND d.image = c.image AND d.word = n.other),
reached(level, image, root, word) AS (SELECT level, image, word, word FROM cores UNION SELECT r.level, r.image, r.root, e.other FROM reached r JOIN edges e ON e.level = r.level AND e.image = r.image AND e.word = r.word),
named AS (SELECT level, image, word, min(root) AS cluster FROM reached GROUP BY ALL),
border AS (SELECT m.level, n.image, n.word, min(m.cluster) AS cluster FROM near n JOIN named m ON m.image = n.image AND m.word = n.other GROUP BY ALL),
clustered AS (SELECT b.level, b.image, b.word, w.weight, m.cluster IS NOT NULL AS core, coalesce(m.cluster, b.cluster) AS cluster FROM border b JOIN words w ON w.image = b.image AND w.word = b.word LEFT JOIN named m ON m.level = b.level AND m.image = b.image AND m.word = b.word)"""


def _words(spark, sf_dir, width: int = _WIDTH):
    """Sign words of the vectors of four images, with the number of vectors that have them."""
    word = bits.sign_bits(F.slice("embedding", 1, width)).alias("word")
    return table(spark, sf_dir, "embeddings").groupBy((F.col("label") % 4).cast("int").alias("image"), word).agg(F.count(F.lit(1)).alias("weight"))


@register("density_clusters", f"WITH RECURSIVE {_CLUSTERS_SQL} SELECT image, level, word, weight, core, cluster FROM clustered")
def density_clusters(spark, sf_dir):
    """Density clusters of sign words at several levels of support: cores, and words at their border."""
    return signatures.density_clusters(_words(spark, sf_dir), ["image"], _LEVELS, _WIDTH)


@register("density_levels", f"""WITH RECURSIVE {_CLUSTERS_SQL}, totals AS (SELECT image, sum(weight)::BIGINT AS total FROM words GROUP BY image),
  bit AS (SELECT level, image, cluster, b, sum(weight)::BIGINT AS support, sum(weight * (word >> ({_WIDTH} - b) & 1))::BIGINT AS ones FROM clustered CROSS JOIN range(1, {_WIDTH + 1}) r(b) GROUP BY ALL),
  found AS (SELECT level, image, cluster, any_value(support) AS support, list((2 * ones >= support)::INTEGER ORDER BY b) AS message, sum(greatest(ones, support - ones)) / (any_value(support) * {_WIDTH})::DOUBLE AS agreement FROM bit GROUP BY ALL),
  top AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY level, image ORDER BY support DESC, cluster) <= 3),
  apart AS (SELECT a.level, a.image, min(list_sum(list_transform(list_zip(a.message, b.message), lambda z: (z[1] <> z[2])::INTEGER))) AS least FROM top a JOIN top b ON a.level = b.level AND a.image = b.image AND a.cluster < b.cluster GROUP BY ALL),
  rated AS (SELECT t.level, t.image, count(*)::INTEGER AS cluster_count, coalesce(any_value(a.least), {_WIDTH})::INTEGER AS minimum_separation, avg(agreement) AS mean_agreement, sum(support) / any_value(n.total)::DOUBLE AS coverage
    FROM top t JOIN totals n ON n.image = t.image LEFT JOIN apart a ON a.level = t.level AND a.image = t.image WHERE t.level <= n.total GROUP BY ALL),
  checked AS (SELECT *, minimum_separation >= 2 AND mean_agreement >= 0.6 AS valid FROM rated)
  SELECT image, level, cluster_count, minimum_separation, round(mean_agreement, 9) AS mean_agreement, round(coverage, 9) AS coverage, valid, valid AND row_number() OVER (PARTITION BY image ORDER BY valid DESC, cluster_count DESC, round(mean_agreement, 12) DESC, coverage DESC, level) = 1 AS chosen FROM checked""")
def density_levels(spark, sf_dir):
    """What each level of support finds in an image, and the level that is chosen for its seeds."""
    words = _words(spark, sf_dir)
    totals = words.groupBy("image").agg(F.sum("weight").alias("total"))
    return rounded(signatures.density_solutions(signatures.density_clusters(words, ["image"], _LEVELS, _WIDTH), ["image"], totals, _WIDTH, _SETTINGS).drop("clusters"))


_SOFT_WIDTH = 8
_SOFT = replace(signatures.SoftSettings(), maximum_messages=2, minimum_message_hamming_separation=3, maximum_soft_hamming=0.45)
_REFINE_SQL = f"""pixels AS (SELECT (label % 4)::INTEGER AS image, vec_id, 1 / (1 + exp(-10 * embedding[33]::DOUBLE)) AS d, list_transform(embedding[1:{_SOFT_WIDTH}], lambda x: 1 / (1 + exp(-20 * x::DOUBLE))) AS p FROM embeddings),
words AS (SELECT image, list_reduce(list_prepend(0::BIGINT, list_transform(p, lambda x: (x >= 0.5)::BIGINT)), lambda n, b: n * 2 + b) AS word, count(*) AS weight FROM pixels GROUP BY ALL),
supports AS (SELECT a.image, a.word, sum(b.weight)::DOUBLE AS support FROM words a JOIN words b ON a.image = b.image AND bit_count(xor(a.word, b.word)) <= 1 GROUP BY ALL),
first AS (SELECT image, word, support FROM supports QUALIFY row_number() OVER (PARTITION BY image ORDER BY support DESC, word) = 1),
second AS (SELECT s.image, s.word, s.support FROM supports s JOIN first f ON f.image = s.image WHERE bit_count(xor(s.word, f.word)) >= 3 AND s.support >= 1 QUALIFY row_number() OVER (PARTITION BY s.image ORDER BY s.support DESC, s.word) = 1),
seeds AS (SELECT image, k, 2 * support AS prior, list_transform(range({_SOFT_WIDTH - 1}, -1, -1), lambda b: (word >> b & 1)::DOUBLE) AS seed FROM (SELECT *, 0 AS k FROM first UNION ALL SELECT *, 1 FROM second)), c0 AS (SELECT image, k, seed AS c FROM seeds)"""


def _round_sql(i: int) -> str:
    sure = "greatest(abs(2 * {} - 1), 0.05::DOUBLE)"
    distance = f"list_sum(list_transform(list_zip(p, c), lambda z: {sure.format('z[1]')} * abs(z[1] - z[2]))) / greatest(list_sum(list_transform(p, lambda x: {sure.format('x')})), 1e-8::DOUBLE)"
    return f""", d{i} AS (SELECT image, vec_id, d, p, k, {distance} AS far FROM pixels JOIN c{i} USING (image)),
e{i} AS (SELECT *, min(far) OVER (PARTITION BY image, vec_id) AS best FROM d{i}), f{i} AS (SELECT *, exp((best - far) / 0.08::DOUBLE) AS e FROM e{i}),
w{i} AS (SELECT image, k, p, d * CASE WHEN best > 0.45 THEN 0 ELSE e / greatest(sum(e) OVER (PARTITION BY image, vec_id), 1e-12::DOUBLE) END AS w FROM f{i}),
s{i} AS (SELECT image, k, b, sum(w) AS support, sum(w * p[b]) AS total FROM w{i} CROSS JOIN range(1, {_SOFT_WIDTH + 1}) r(b) GROUP BY ALL),
c{i + 1} AS (SELECT image, k, any_value(s{i}.support) AS support, list(CASE WHEN s{i}.support > 1e-8 THEN (total + prior * seed[b]) / greatest(s{i}.support + prior, 1e-8::DOUBLE) ELSE c[b] END ORDER BY b) AS c FROM s{i} JOIN seeds USING (image, k) JOIN c{i} USING (image, k) GROUP BY ALL)"""


@register("soft_refinement", f"""WITH {_REFINE_SQL}{"".join(map(_round_sql, range(5)))}
  SELECT image, k, round(support, 6) AS support, array_to_string(list_transform(c, lambda x: (x >= 0.5)::INTEGER), '') AS message, round(c[1], 9) AS first_bit, round(list_sum(c), 9) AS sum_of_bits FROM c5""")
def soft_refinement(spark, sf_dir):
    """Two messages an image, seeded by the support of sign words and refined by expectation-maximisation."""
    logits = F.transform(F.slice("embedding", 1, _SOFT_WIDTH), lambda x: 1 / (1 + F.exp(-20 * x.cast("double"))))
    pixels = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).cast("int").alias("image"), (1 / (1 + F.exp(-10 * F.col("embedding")[32].cast("double")))).alias("detection"), logits.alias("p"))
    measured = signatures.supports(_words(spark, sf_dir, _SOFT_WIDTH), ["image"], _SOFT_WIDTH, 1)
    least = measured.select("image").distinct().withColumn("minimum_support", F.lit(1.0))
    state = signatures.refine(pixels, signatures.greedy_seeds(measured, ["image"], least, _SOFT_WIDTH, _SOFT), ["image"], _SOFT_WIDTH, _SOFT)
    each = state.select("image", F.posexplode(F.arrays_zip("centroids", "support")).alias("k", "c"))
    return each.select(
        "image", "k", F.round("c.support", 6).alias("support"), F.array_join(F.transform("c.centroids", lambda x: (x >= 0.5).cast("int")), "").alias("message"),
        F.round(F.col("c.centroids")[0], 9).alias("first_bit"), F.round(F.aggregate("c.centroids", F.lit(0.0), lambda s, x: s + x), 9).alias("sum_of_bits"),
    )


def soft_pixels(spark, sf_dir):
    """The vectors as pixels of four images: a sign of 32 coordinates each, two planted messages by the parity of the label.

    Three in four coordinates take the side of the image's message, so that images have dense words to find.
    """
    planted = F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)
    logits = F.transform(F.slice("embedding", 1, 32), lambda x, i: x.cast("double") * 4 + F.when((planted == 1) & (i % 2 == 1), 3.0).otherwise(-3.0))
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 4).cast("int").alias("image"), "vec_id", (1 / (1 + F.exp(-F.col("embedding")[32].cast("double") - 1))).alias("detection"), logits.alias("logits"))


#: Settings of the query: images of the table are small.
QUERY_SETTINGS = replace(signatures.SoftSettings(), minimum_cluster_pixels=12, minimum_cluster_fraction=0.03, localization_threshold=0.2, density_schedule=(20, 40, 80))


@register("soft_messages")
def soft_messages(spark, sf_dir):
    """The whole decoding: dense seeds or greedy ones, refinement, ranks by support. A test holds it against a plain run."""
    messages, _ = signatures.soft_messages(soft_pixels(spark, sf_dir), ["image"], ["vec_id"], 32, QUERY_SETTINGS)
    return rounded(messages.withColumn("message", F.array_join("message", "")))
