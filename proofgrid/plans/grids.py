"""Queries over the vectors as 8 x 8 grids: maps between grids, stencils and masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import grids, scalars
from .registry import register, rounded
from .standins import table

_BRANCHES = ["identity", "rotation_+10", "rotation_-30", "perspective_0.06", "perspective_0.15"]
_SHAPES = [(240, 120), (120, 240)]
_CELLS = "list_transform(embedding, lambda x: 1 / (1 + exp(-8 * x::DOUBLE)))"


def _matrix(branch: str, width: int, height: int) -> np.ndarray:
    """The map of a branch on the 8 x 8 grid, from a numeric solver."""
    kind, _, amount = branch.partition("_")
    if kind == "identity":
        return np.eye(3)
    if kind == "rotation":
        c, s, x, y = np.cos(np.deg2rad(float(amount))), np.sin(np.deg2rad(float(amount))), width / 2, height / 2
        m = np.array([[c, s, x - c * x - s * y], [-s, c, y + s * x - c * y], [0, 0, 1]])
    else:
        x, y, a = width - 1.0, height - 1.0, float(amount)
        # From the unit square to four corners, in closed form, then from the canvas to the unit square.
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = (x * a, y * a), (x - x * a, 0), (x, y - y * a), (0, y)
        u, v, p, q, r, t = x1 - x2, x3 - x2, y1 - y2, y3 - y2, x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
        g, h = (r * q - v * t) / (u * q - v * p), (u * t - r * p) / (u * q - v * p)
        m = np.linalg.inv(np.array([[x1 - x0 + g * x1, x3 - x0 + h * x3, x0], [y1 - y0 + g * y1, y3 - y0 + h * y3, y0], [g, h, 1]]) @ np.diag([1 / x, 1 / y, 1]))
    scale = np.diag([width / 8, height / 8, 1])
    m = np.linalg.inv(scale) @ m @ scale
    return m / m[2, 2]


_MATRICES = ", ".join(f"('{b}', {k}, {[float(x) for x in _matrix(b, w, h).ravel()]}::DOUBLE[])" for b in _BRANCHES for k, (w, h) in enumerate(_SHAPES))


def _grids(spark, sf_dir, vectors=None):
    """Vectors as grids of probabilities, each seen in a branch of an image of one of two shapes."""
    cells = F.transform("embedding", lambda x: 1 / (1 + F.exp(-8 * x.cast("double"))))
    branch = F.element_at(F.array(*map(F.lit, _BRANCHES)), (F.pmod("vec_id", F.lit(len(_BRANCHES))) + 1).cast("int"))
    wide = F.pmod("vec_id", F.lit(2)) == 0
    return (vectors or table(spark, sf_dir, "embeddings")).select("vec_id", "embedding", branch.alias("branch"), F.when(wide, 240).otherwise(120).alias("image_width"), F.when(wide, 120).otherwise(240).alias("image_height"), F.lit(8).alias("width"), cells.alias("cells"))


@register("localization_in_input", f"""WITH maps AS (SELECT * FROM (VALUES {_MATRICES}) t(branch, shape, m)), g AS (SELECT vec_id, {_BRANCHES}[vec_id % {len(_BRANCHES)} + 1] AS branch, vec_id % 2 AS shape, {_CELLS} AS c FROM embeddings),
  s AS (SELECT vec_id, branch, c, i, (m[1] * x + m[2] * y + m[3]) / (m[7] * x + m[8] * y + 1) AS sx, (m[4] * x + m[5] * y + m[6]) / (m[7] * x + m[8] * y + 1) AS sy FROM g JOIN maps USING (branch, shape) CROSS JOIN (SELECT i, i % 8 + 0.5::DOUBLE AS x, i // 8 + 0.5::DOUBLE AS y FROM range(0, 64) r(i))),
  q AS (SELECT *, floor(sx - 0.5)::INTEGER AS fx, floor(sy - 0.5)::INTEGER AS fy FROM s),
  n AS (SELECT *, greatest(0, least(7, fx)) AS x0, greatest(0, least(7, fx + 1)) AS x1, greatest(0, least(7, fy)) AS y0, greatest(0, least(7, fy + 1)) AS y1, sx - 0.5 - fx AS u, sy - 0.5 - fy AS v FROM q),
  o AS (SELECT vec_id, branch, i, CASE WHEN branch = 'identity' THEN c[i + 1] WHEN sx < 0 OR sx >= 8 OR sy < 0 OR sy >= 8 THEN 0 ELSE (1 - v) * ((1 - u) * c[y0 * 8 + x0 + 1] + u * c[y0 * 8 + x1 + 1]) + v * ((1 - u) * c[y1 * 8 + x0 + 1] + u * c[y1 * 8 + x1 + 1]) END AS z FROM n)
  SELECT vec_id, branch, count(*) FILTER (WHERE z = 0)::INTEGER AS n_outside, round(sum(z), 8) AS mass, round(sum(z * (i % 8)), 8) AS mass_x, round(sum(z * (i // 8)), 8) AS mass_y FROM o GROUP BY ALL""")
def localization_in_input(spark, sf_dir):
    """A detector's grid of a corrected branch, moved back to the coordinates of the input."""
    add = lambda f: F.aggregate(F.transform("located", f), F.lit(0.0), lambda t, x: t + x)
    located = grids.in_input_coordinates(_grids(spark, sf_dir))
    return rounded(located.select("vec_id", "branch", F.size(F.filter("located", lambda x: x == 0)).alias("n_outside"), add(lambda x: x).alias("mass"), add(lambda x, i: x * (i % 8)).alias("mass_x"), add(lambda x, i: x * F.floor(i / 8)).alias("mass_y")), 8)


_MEAN = "(list_sum({0}) / len({0}))"
_VAR = "(list_sum(list_transform({0}, lambda x: (x - list_sum({0}) / len({0})) ** 2)) / len({0}))"


@register("content_features", f"""WITH g AS (SELECT vec_id, {_CELLS} AS c FROM embeddings),
  p AS (SELECT vec_id, c, list_transform([i for i in range(1, 65) if i % 8 <> 0], lambda i: abs(c[i + 1] - c[i])) AS dx, list_transform(range(1, 57), lambda i: abs(c[i + 8] - c[i])) AS dy,
    list_transform([i for i in range(9, 57) if i % 8 NOT IN (0, 1)], lambda i: c[i - 1] + c[i + 1] + c[i - 8] + c[i + 8] - 4 * c[i]) AS l, list_transform(range(0, 32), lambda b: len([x for x in c if least(floor(x * 32), 31) = b]) / 64.0::DOUBLE) AS h FROM g)
  SELECT vec_id, round(sqrt({_VAR.format("c")}), 8) AS deviation, round(0.5 * ({_MEAN.format("dx")} + {_MEAN.format("dy")}), 8) AS gradient_energy, round({_VAR.format("l")}, 8) AS laplacian_variance, round(-list_sum(list_transform([x for x in h if x > 0], lambda x: x * log2(x))) / 5, 8) AS entropy FROM p""")
def content_features(spark, sf_dir):
    """What a picture's content looks like: contrast, edges, detail and spread of its samples."""
    return rounded(_grids(spark, sf_dir).select("vec_id", *[c.alias(k) for k, c in grids.content_features("cells", "width").items()]), 8)


@register("border_evidence", f"""WITH g AS (SELECT vec_id, list_transform({_CELLS}, lambda x: floor(x * 255)) AS c FROM embeddings), m AS (SELECT *, (list_sort(c)[32] + list_sort(c)[33]) / 2 AS mid FROM g),
  z AS (SELECT vec_id, abs(c[i + 1] - mid) <= 12 AS near, i % 8 IN (0, 7) AND i // 8 IN (0, 7) AS corner, i % 8 BETWEEN 2 AND 5 AND i // 8 BETWEEN 2 AND 5 AS centre FROM m CROSS JOIN range(0, 64) r(i))
  SELECT vec_id, round(greatest(0, count(*) FILTER (WHERE near AND corner) / 4.0::DOUBLE - count(*) FILTER (WHERE near AND centre) / 16.0::DOUBLE), 8) AS evidence FROM z GROUP BY vec_id""")
def border_evidence(spark, sf_dir):
    """Whether corners look like the padding that a turned picture leaves."""
    levels = _grids(spark, sf_dir).withColumn("cells", F.transform("cells", lambda x: F.floor(x * 255).cast("double")))
    return rounded(levels.select("vec_id", grids.border_evidence("cells", "width").alias("evidence")), 8)


@register("spatial_metrics", f"""WITH g AS (SELECT vec_id, {_CELLS} AS c FROM embeddings), z AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, c[i + 1] AS p, i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 AS middle, i % 8 < 1 + vec_id % 5 AND i // 8 < 3 AS changed FROM g CROSS JOIN range(0, 64) r(i)),
  n AS (SELECT vec_id, avg((p > 0.6)::INTEGER) AS f, avg(p) AS mean, max(p) AS top, sum(p * x) / sum(p) / 7 AS cx, sum(p * y) / sum(p) / 7 AS cy, avg(p) FILTER (WHERE NOT middle) AS border, avg(p) FILTER (WHERE middle) AS centre, avg(p) FILTER (WHERE changed) AS inside, avg(p) FILTER (WHERE NOT changed) AS outside,
    count(*) FILTER (WHERE p > 0.6 AND NOT changed)::DOUBLE AS tp, count(*) FILTER (WHERE p > 0.6 AND changed) AS fp, count(*) FILTER (WHERE p <= 0.6 AND NOT changed) AS fn FROM z GROUP BY vec_id)
  SELECT vec_id, round(f, 8) AS detected_fraction, round(mean, 8) AS mean_probability, round(top, 8) AS highest_probability, round(cx, 8) AS centroid_x, round(cy, 8) AS centroid_y, round(border, 8) AS border_probability, round(centre, 8) AS centre_probability, round(inside, 8) AS inside_probability, round(outside, 8) AS outside_probability,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 8) AS overlap FROM n""")
def spatial_metrics(spark, sf_dir):
    """Where detection lies in a grid, and how well it leaves out the part that was changed."""
    changed = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 8 < 1 + F.pmod("vec_id", F.lit(5))) & (F.floor(i / 8) < 3))
    marked = _grids(spark, sf_dir).withColumn("changed", changed)
    return rounded(marked.select("vec_id", *[c.alias(k) for k, c in grids.spatial_metrics("cells", "width", 0.6, "changed").items()]), 8)


# --- marks in least significant bits, and what perturbations leave of them

_MESSAGE = 16
#: Perturbations of 8-bit samples and their strengths.
_ATTACKS = {"identity": 0.0, "brightness": 1.125, "contrast": 0.75, "gamma": 1.25, "horizontal_flip": 0.0, "pixelate": 0.5}
_MARKED_SQL = f"""levels AS (SELECT vec_id, list_transform({_CELLS}, lambda x: floor(x * 255)) AS c, array_to_string(list_transform(embedding[1:{_MESSAGE}], lambda x: (x > 0)::INTEGER), '') AS message FROM embeddings),
  cell AS (SELECT vec_id, message, i, c[i + 1] AS x, c[i + 1] - c[i + 1] % 2 + substr('{grids.SYNC}' || message, 1 + (i % {len(grids.SYNC) + _MESSAGE})::INTEGER, 1)::INTEGER AS m FROM levels CROSS JOIN range(0, 64) r(i))"""


def _read_sql(source: str, value: str, keys: str) -> str:
    """Votes of each bit, and the text of all bits, from cells."""
    total = len(grids.SYNC) + _MESSAGE
    return f"(SELECT {keys}, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS bits FROM (SELECT {keys}, i % {total} AS b, sum({value} % 2 * 2 - 1) AS v FROM {source} GROUP BY ALL) GROUP BY ALL)"


def _marked(spark, sf_dir):
    """Vectors as 8 x 8 samples from 0 to 255, marked with the signs of their first coordinates."""
    # A vector is a few bytes and much work, so rows are dealt evenly, whatever the files' row groups.
    dealt = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    message = F.array_join(F.transform(F.slice("embedding", 1, _MESSAGE), lambda x: (x > 0).cast("int")), "").alias("message")
    levels = _grids(spark, sf_dir, dealt).select("vec_id", "width", F.transform("cells", lambda x: F.floor(x * 255).cast("double")).alias("cells"), message)
    return levels.withColumn("marked", F.expr(grids.marked("cells", "message")))


@register("lsb_roundtrip", f"""WITH {_MARKED_SQL}, r AS {_read_sql("cell", "m", "vec_id")}, q AS (SELECT vec_id, any_value(message) AS message, avg((x - m) ** 2) AS mse FROM cell GROUP BY vec_id)
  SELECT vec_id, message, substr(bits, {len(grids.SYNC) + 1}) AS found, starts_with(bits, '{grids.SYNC}') AS detected, round(10 * log10(65025.0::DOUBLE / mse), 8) AS psnr_db FROM q JOIN r USING (vec_id) WHERE mse > 0""")
def lsb_roundtrip(spark, sf_dir):
    """Mark each grid, read the mark back, and measure the change."""
    found = grids.read_mark("marked", _MESSAGE)
    seen = _marked(spark, sf_dir).withColumn("mse", grids.squared_difference("cells", "marked")).where("mse > 0")
    return rounded(seen.select("vec_id", "message", found["message"].alias("found"), found["detected"].alias("detected"), scalars.psnr(F.col("mse")).alias("psnr_db")), 8)


_AFTER_SQL = """p AS (SELECT vec_id, round_even(avg(m), 0) AS centre FROM cell GROUP BY vec_id),
  blocks AS (SELECT vec_id, i // 8 // 2 AS y, i % 8 // 2 AS x, avg(m) AS mean FROM cell GROUP BY ALL),
  hit AS (SELECT c.vec_id, c.message, c.i, c.m, a.attack, CASE a.attack WHEN 'identity' THEN c.m WHEN 'brightness' THEN c.m * 1.125::DOUBLE WHEN 'contrast' THEN centre + (c.m - centre) * 0.75::DOUBLE WHEN 'gamma' THEN 255 * pow(c.m / 255.0::DOUBLE, 1.25::DOUBLE)
      WHEN 'horizontal_flip' THEN f.m ELSE b.mean END AS z FROM cell c JOIN p USING (vec_id) JOIN cell f ON f.vec_id = c.vec_id AND f.i = c.i - c.i % 8 + 7 - c.i % 8 JOIN blocks b ON b.vec_id = c.vec_id AND b.y = c.i // 8 // 2 AND b.x = c.i % 8 // 2
      CROSS JOIN (VALUES ('identity'), ('brightness'), ('contrast'), ('gamma'), ('horizontal_flip'), ('pixelate')) a(attack)),
  after AS (SELECT *, round_even(greatest(0, least(255, z)), 0) AS w FROM hit)"""


@register("attack_contract", f"""WITH {_MARKED_SQL}, {_AFTER_SQL}, r AS {_read_sql("after", "w", "vec_id, attack")}, s AS (SELECT attack, vec_id, any_value(message) AS message, avg((m - w) ** 2) AS mse FROM after GROUP BY ALL)
  SELECT attack, count(*) AS images, count(*) FILTER (WHERE starts_with(bits, '{grids.SYNC}')) AS synchronised, count(*) FILTER (WHERE substr(bits, {len(grids.SYNC) + 1}) = message) AS recovered, round(avg(mse), 8) AS mean_squared_difference FROM s JOIN r USING (vec_id, attack) GROUP BY attack""")
def attack_contract(spark, sf_dir):
    """Every perturbation of the marked grids, in one pass: how much it changes, and how many marks survive."""
    hit = _marked(spark, sf_dir).select("message", "width", "marked", F.explode(F.array(*[F.struct(F.lit(name).alias("attack"), F.expr(grids.perturbed("marked", "width", name, amount)).alias("after")) for name, amount in _ATTACKS.items()])).alias("a"))
    seen = hit.select("message", "marked", "a.attack", "a.after")
    found = grids.read_mark("after", _MESSAGE)
    return rounded(seen.groupBy("attack").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(found["sync"] == 1).alias("synchronised"), F.count_if(found["message"] == F.col("message")).alias("recovered"), F.avg(grids.squared_difference("marked", "after")).alias("mean_squared_difference"),
    ), 8)
