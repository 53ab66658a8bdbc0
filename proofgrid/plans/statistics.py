"""Detection, bootstrap and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bootstrap import hash_bootstrap, numpy_bootstrap
from ..operators.detection import auc, score_counts, tie_safe_threshold, wilson
from ..operators.pairing import paired
from ..operators.policy import CANDIDATES, Policy, full_decision, grid_scores, replay, replay_grid, select_policy
from ..operators.summary import unit_means
from .registry import register, rounded
from .standins import DETECTIONS_SQL, METRICS, RECORDS_SQL, RUNS_SQL, attacks, detections, records, runs, table

_TARGET = 0.05
_THRESHOLD_SQL = f"""negative AS (SELECT dataset, detection_score AS score, count(*) AS n0 FROM detections WHERE label = 0 AND split = 'calibration' GROUP BY ALL),
  rated AS (SELECT *, sum(n0) OVER (PARTITION BY dataset ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS accepted, sum(n0) OVER (PARTITION BY dataset) AS total FROM negative),
  thresholds AS (SELECT dataset, coalesce(min(score) FILTER (WHERE accepted / total::DOUBLE <= {_TARGET}), max(score)) AS threshold, count(*) FILTER (WHERE accepted / total::DOUBLE <= {_TARGET}) = 0 AS strict, max(total)::BIGINT AS negatives FROM rated GROUP BY dataset)"""


@register("detection_threshold_tie_safe", f"WITH {DETECTIONS_SQL}, {_THRESHOLD_SQL} SELECT * FROM thresholds")
def detection_threshold_tie_safe(spark, sf_dir):
    return tie_safe_threshold(detections(spark, sf_dir).where("split = 'calibration'"), ["dataset"], _TARGET)


@register("detection_auc", f"""WITH {DETECTIONS_SQL}, ties AS (SELECT dataset, detection_score AS score, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM detections GROUP BY ALL),
  w AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY dataset ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM ties)
  SELECT dataset, sum(n1)::BIGINT AS positives, sum(n0)::BIGINT AS negatives, round(sum(n1 * (under + n0 / 2.0::DOUBLE)) / nullif(sum(n1)::DOUBLE * sum(n0), 0), 9) AS auc FROM w GROUP BY dataset""")
def detection_auc(spark, sf_dir):
    return rounded(auc(detections(spark, sf_dir), ["dataset"]))


_Z = "1.959963984540054::DOUBLE"


def _wilson_sql(hits: str, total: str, name: str) -> str:
    p = f"({hits} / nullif({total}, 0)::DOUBLE)"
    scale, centre = f"(1 + {_Z} * {_Z} / {total})", f"({p} + {_Z} * {_Z} / (2 * {total}))"
    half = f"(sqrt({p} * (1 - {p}) / {total} + {_Z} * {_Z} / (4 * {total}::DOUBLE * {total})) * {_Z} / {scale})"
    return f"round(CASE WHEN {total} > 0 THEN greatest(0.0::DOUBLE, {centre} / {scale} - {half}) END, 9) AS {name}_low, round(CASE WHEN {total} > 0 THEN least(1.0::DOUBLE, {centre} / {scale} + {half}) END, 9) AS {name}_high"


@register("detection_summary_wilson", f"""WITH {DETECTIONS_SQL}, {_THRESHOLD_SQL}, own AS (SELECT d.*, CASE WHEN strict THEN detection_score > threshold ELSE detection_score >= threshold END AS hit FROM detections d JOIN thresholds USING (dataset) WHERE split = 'test'),
  judged AS (SELECT * FROM own UNION ALL SELECT * REPLACE ('overall' AS dataset) FROM own), ties AS (SELECT dataset, detection_score AS score, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM judged GROUP BY ALL),
  wins AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY dataset ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM ties),
  area AS (SELECT dataset, round(sum(n1 * (under + n0 / 2.0::DOUBLE)) / nullif(sum(n1)::DOUBLE * sum(n0), 0), 9) AS auc FROM wins GROUP BY dataset),
  c AS (SELECT dataset, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1 AND hit) AS tp, count(*) FILTER (WHERE label = 0 AND hit) AS fp,
    count(*) FILTER (WHERE label = 1 AND intrinsic_detected) AS intrinsic_tp, count(*) FILTER (WHERE label = 0 AND intrinsic_detected) AS intrinsic_fp, round(avg(complete_recovery), 9) AS positive_recovery, CASE WHEN count(DISTINCT detection_score) > 2 THEN 'continuous' ELSE 'binary' END AS resolution FROM judged GROUP BY dataset)
  SELECT *, round(tp / nullif(positives, 0)::DOUBLE, 9) AS tpr, round(fp / nullif(negatives, 0)::DOUBLE, 9) AS fpr, {_wilson_sql('tp', 'positives', 'tpr')}, {_wilson_sql('fp', 'negatives', 'fpr')} FROM c JOIN area USING (dataset)""")
def detection_summary_wilson(spark, sf_dir):
    """Thresholds from calibration negatives, applied to the test split, by dataset and overall; thresholds are one row for each dataset."""
    facts = detections(spark, sf_dir)
    limits = tie_safe_threshold(facts.where("split = 'calibration'"), ["dataset"], _TARGET).drop("negatives")
    judged = facts.where("split = 'test'").join(limits, "dataset")
    judged = judged.withColumn("dataset", F.explode(F.array("dataset", F.lit("overall"))))
    hit = F.when(F.col("strict"), F.col("detection_score") > F.col("threshold")).otherwise(F.col("detection_score") >= F.col("threshold"))
    pos, neg, own = F.col("label") == 1, F.col("label") == 0, F.col("intrinsic_detected")
    c = judged.groupBy("dataset").agg(
        F.count_if(pos).alias("positives"), F.count_if(neg).alias("negatives"), F.count_if(pos & hit).alias("tp"), F.count_if(neg & hit).alias("fp"), F.count_if(pos & own).alias("intrinsic_tp"), F.count_if(neg & own).alias("intrinsic_fp"),
        F.round(F.avg("complete_recovery"), 9).alias("positive_recovery"), F.when(F.count_distinct("detection_score") > 2, "continuous").otherwise("binary").alias("resolution"),
    )
    bounds = [F.round(b, 9).alias(f"{name}_{side}") for name, h, n in (("tpr", "tp", "positives"), ("fpr", "fp", "negatives")) for side, b in zip(("low", "high"), wilson(F.col(h), F.col(n)), strict=True)]
    area = rounded(auc(judged, ["dataset"])).select("dataset", "auc")
    return c.join(area, "dataset").select("*", F.round(F.try_divide("tp", "positives"), 9).alias("tpr"), F.round(F.try_divide("fp", "negatives"), 9).alias("fpr"), *bounds)


@register("strict_max_threshold", f"""WITH {RUNS_SQL}, t AS (SELECT method, max(value) AS threshold FROM runs WHERE attack = 'view' GROUP BY method) SELECT method, threshold, count(*) FILTER (WHERE value > threshold) AS above, count(*) AS total FROM runs JOIN t USING (method) WHERE attack <> 'view' GROUP BY method, threshold""")
def strict_max_threshold(spark, sf_dir):
    """Beyond the highest negative: a strict comparison stands for the next number after it."""
    facts = runs(spark, sf_dir)
    limits = facts.where("attack = 'view'").groupBy("method").agg(F.max("value").alias("threshold"))
    return facts.where("attack <> 'view'").join(limits, "method").groupBy("method", "threshold").agg(F.count_if(F.col("value") > F.col("threshold")).alias("above"), F.count(F.lit(1)).alias("total"))


@register("fp_any_by_image", f"""WITH {RUNS_SQL}, i AS (SELECT method, unit, bool_or(value > 99) AS any_hit, avg(CASE WHEN k > 50 THEN value END) AS cost FROM runs GROUP BY ALL)
  SELECT method, count(*) AS images, count(*) FILTER (WHERE any_hit) AS false_positive_images, round(avg(cost), 9) AS mean_cost, {_wilson_sql('count(*) FILTER (WHERE any_hit)', 'count(*)', 'rate')} FROM i GROUP BY method""")
def fp_any_by_image(spark, sf_dir):
    """An image counts once, whichever of its rows is a false positive; costs that weren't taken are skipped."""
    images = runs(spark, sf_dir).groupBy("method", "unit").agg(F.bool_or(F.col("value") > 99).alias("any_hit"), F.avg(F.when(F.col("k") > 50, F.col("value"))).alias("cost"))
    low, high = wilson(F.col("false_positive_images"), F.col("images"))
    return images.groupBy("method").agg(F.count(F.lit(1)).alias("images"), F.count_if("any_hit").alias("false_positive_images"), F.round(F.avg("cost"), 9).alias("mean_cost")).select("*", F.round(low, 9).alias("rate_low"), F.round(high, 9).alias("rate_high"))


def _boot_sql(units: str, group: str, order: str, values: list[str], iterations: int, seed: str, stratum: str | None = None) -> str:
    """The hash bootstrap in SQL over a table expression units."""
    within = ", ".join(x for x in (group, stratum) if x)
    shared = f"{stratum}, n" if stratum else "n"
    seed_text = f"'{seed}'" if not stratum else f"'{seed}' || '/' || {stratum}"
    means = ", ".join(f"sum(w * {v})::DOUBLE / (sum(w) FILTER (WHERE {v} IS NOT NULL) * 1e9::DOUBLE) AS {v}" for v in values)
    bounds = ", ".join(f"round(quantile_cont({v}, 0.025), 10) AS {v}_low, round(quantile_cont({v}, 0.975), 10) AS {v}_high" for v in values)
    point = ", ".join(f"round(sum({v})::DOUBLE / (count({v}) * 1e9::DOUBLE), 10) AS {v}_mean" for v in values)
    hexa = f"('0x' || substr(sha256({seed_text} || ':' || it::VARCHAR || ':' || k::VARCHAR), 1, 15))::BIGINT"
    whole = ", ".join(f"floor({v} * 1e9::DOUBLE + 0.5)::BIGINT AS {v}" for v in values)
    return f"""u AS (SELECT * REPLACE ({whole}) FROM ({units})), numbered AS (SELECT *, count(*) OVER (PARTITION BY {within}) AS n, row_number() OVER (PARTITION BY {within} ORDER BY {order}) - 1 AS i FROM u),
  drawn AS (SELECT {shared}, it, i, count(*) AS w FROM (SELECT {shared}, it, {hexa} % n AS i FROM (SELECT DISTINCT {shared} FROM numbered) CROSS JOIN range(0, {iterations}) r(it) CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS k) d) GROUP BY ALL),
  means AS (SELECT {group}, it, {means} FROM drawn JOIN numbered USING ({shared}, i) GROUP BY {group}, it),
  point AS (SELECT {group}, count(*) AS units, {point} FROM u GROUP BY {group}), bounds AS (SELECT {group}, {bounds} FROM means GROUP BY {group}) SELECT * FROM point JOIN bounds USING ({group})"""


def _told(intervals):
    """Means and bounds to 10 digits, which hold every mean of shares of 32 bits without a tie."""
    return rounded(intervals, 10)


@register("bootstrap_mean_hash", f"WITH {RUNS_SQL}, " + _boot_sql("SELECT method, unit, avg(value) AS value FROM runs GROUP BY ALL", "method", "unit", ["value"], 1000, "mean"))
def bootstrap_mean_hash(spark, sf_dir):
    return _told(hash_bootstrap(unit_means(runs(spark, sf_dir), ["method", "unit"], ["value"]), ["method"], ["unit"], ["value"], 1000, "mean"))


_SCOPES = "SELECT {key}'overall' AS scope, * {less} FROM {facts} UNION ALL SELECT {key}'dataset:' || dataset, * {less} FROM {facts} UNION ALL SELECT {key}'category:' || category, * {less} FROM {facts} UNION ALL SELECT {key}'attack:' || attack, * {less} FROM {facts}"


def _scoped(facts):
    """Each row under every scope that it belongs to."""
    tagged = [F.concat(F.lit(f"{c}:"), F.col(c)) for c in ("dataset", "category", "attack")]
    return facts.withColumn("scope", F.explode(F.array(F.lit("overall"), *tagged)))


_MEANS = ", ".join(f"avg({m}) AS {m}" for m in METRICS)


@register("bootstrap_model_summary", f"WITH {RECORDS_SQL}, scoped AS ({_SCOPES.format(key='model, ', less='EXCLUDE (model)', facts='records')}), " + _boot_sql(f"SELECT model || '/' || scope AS cell, dataset, image_id, {_MEANS} FROM scoped GROUP BY model, scope, dataset, image_id", "cell", "dataset, image_id", METRICS, 1000, "model"))
def bootstrap_model_summary(spark, sf_dir):
    """model x scope (overall, dataset, category, attack) on image units; metrics are columns, so each draw serves all."""
    facts = _scoped(records(spark, sf_dir)).withColumn("cell", F.concat_ws("/", "model", "scope"))
    return _told(hash_bootstrap(unit_means(facts, ["cell", "dataset", "image_id"], METRICS), ["cell"], ["dataset", "image_id"], METRICS, 1000, "model"))


_GAIN_SQL = "gained AS (SELECT dataset, image_id, attack, max(category) AS category, " + ", ".join(f"max({m}) FILTER (WHERE model = 'repeat2') - max({m}) FILTER (WHERE model = 'base') AS {m}" for m in METRICS) + " FROM records GROUP BY dataset, image_id, attack)"


def _gained(spark, sf_dir):
    """The gain of repeat2 over base in every metric, for each cell."""
    cells = paired(records(spark, sf_dir), "model", "base", "repeat2", ["dataset", "image_id", "attack"], METRICS)
    named = cells.join(F.broadcast(attacks(spark).select("attack", "category")), "attack")  # the protocol: a fixed few rows
    return named.select("dataset", "image_id", "attack", "category", *[(F.col(f"other_{m}") - F.col(f"reference_{m}")).alias(m) for m in METRICS])


@register("paired_bootstrap_hash", f"WITH {RECORDS_SQL}, {_GAIN_SQL}, scoped AS ({_SCOPES.format(key='', less='', facts='gained')}), " + _boot_sql(f"SELECT scope, dataset, image_id, {_MEANS} FROM scoped GROUP BY scope, dataset, image_id", "scope", "dataset, image_id", METRICS, 1000, "paired"))
def paired_bootstrap_hash(spark, sf_dir):
    """Gains in all metrics by scope, on image units."""
    units = unit_means(_scoped(_gained(spark, sf_dir)), ["scope", "dataset", "image_id"], METRICS)
    return _told(hash_bootstrap(units, ["scope"], ["dataset", "image_id"], METRICS, 1000, "paired"))


@register("stratified_bootstrap_hash", f"WITH {RECORDS_SQL}, {_GAIN_SQL}, " + _boot_sql("SELECT 'all' AS scope, dataset, image_id, avg(complete_recovery) * 100 AS gain_pp FROM gained GROUP BY ALL", "scope", "image_id", ["gain_pp"], 2000, "strata", "dataset"))
def stratified_bootstrap_hash(spark, sf_dir):
    """Percentage points with draws within each dataset; datasets weigh by their images."""
    units = _gained(spark, sf_dir).groupBy(F.lit("all").alias("scope"), "dataset", "image_id").agg((F.avg("complete_recovery") * 100).alias("gain_pp"))
    return _told(hash_bootstrap(units, ["scope"], ["image_id"], ["gain_pp"], 2000, "strata", "dataset"))


@register("leave_one_out_intervals", f"WITH {RECORDS_SQL}, {_GAIN_SQL}, " + _boot_sql("SELECT x.attack AS excluded, dataset, image_id, avg(complete_recovery) * 100 AS gain_pp FROM gained g JOIN (SELECT DISTINCT attack FROM gained) x ON x.attack <> g.attack GROUP BY ALL", "excluded", "image_id", ["gain_pp"], 2000, "loo", "dataset"))
def leave_one_out_intervals(spark, sf_dir):
    """The stratified interval without each attack: an image's sums less those of the attack left out, so no row is repeated for each exclusion."""
    each = _gained(spark, sf_dir).groupBy("dataset", "image_id", "attack").agg(F.sum("complete_recovery").alias("gain"), F.count("complete_recovery").alias("n"))
    image = each.groupBy("dataset", "image_id").agg(F.sum("gain").alias("all_gain"), F.sum("n").alias("all_n"), F.collect_list(F.struct("attack", "gain", "n")).alias("attacks"))  # as many as the protocol
    units = image.select("dataset", "image_id", "all_gain", "all_n", F.explode("attacks").alias("a")).where("all_n > a.n")
    units = units.select(F.col("a.attack").alias("excluded"), "dataset", "image_id", ((F.col("all_gain") - F.col("a.gain")) / (F.col("all_n") - F.col("a.n")) * 100).alias("gain_pp"))
    return _told(hash_bootstrap(units, ["excluded"], ["image_id"], ["gain_pp"], 2000, "loo", "dataset"))


_DECODED = "SELECT attack, unit, avg(value) FILTER (WHERE method = 'soft') - avg(value) FILTER (WHERE method = 'hard') AS value, avg(k) FILTER (WHERE method = 'hard') - avg(k) FILTER (WHERE method = 'soft') AS k_saved FROM runs GROUP BY attack, unit HAVING count(DISTINCT method) = 2"


@register("decoder_contrast_bootstrap", f"WITH {RUNS_SQL}, " + _boot_sql(_DECODED, "attack", "unit", ["value", "k_saved"], 2000, "decoder").replace("SELECT * FROM point", "SELECT *, value_low > 0 AS value_better, k_saved_low > 0 AS k_saved_better FROM point"))
def decoder_contrast_bootstrap(spark, sf_dir):
    """Soft against hard decoder by condition: value, of which more is better, and k, of which less is (so its sign is turned). A contrast is better if its interval lies above 0."""
    side = lambda method, c: F.avg(F.when(F.col("method") == method, F.col(c)))
    units = runs(spark, sf_dir).groupBy("attack", "unit").agg((side("soft", "value") - side("hard", "value")).alias("value"), (side("hard", "k") - side("soft", "k")).alias("k_saved"), F.count_distinct("method").alias("methods")).where("methods = 2")
    out = _told(hash_bootstrap(units.select("attack", "unit", "value", "k_saved"), ["attack"], ["unit"], ["value", "k_saved"], 2000, "decoder"))
    return out.withColumn("value_better", F.col("value_low") > 0).withColumn("k_saved_better", F.col("k_saved_low") > 0)


@register("bootstrap_numpy_parity")
def bootstrap_numpy_parity(spark, sf_dir):
    """The published arithmetic: a fresh numpy generator for each group, strata in order, blocks of 128. Tests compare it with numpy."""
    units = unit_means(_gained(spark, sf_dir), ["dataset", "image_id"], ["complete_recovery"])
    plain = numpy_bootstrap(units, ["dataset"], ["image_id"], "complete_recovery", 1000, 2026)
    strata = numpy_bootstrap(units.withColumn("scope", F.lit("all")), ["scope"], ["dataset", "image_id"], "complete_recovery", 2000, 2026, "dataset")
    return plain.withColumnRenamed("dataset", "scope").unionByName(strata)


_FAMILIES = "SELECT 'overall' AS scope, * FROM gained UNION ALL SELECT 'family:' || category, * FROM gained UNION ALL SELECT 'dataset:' || dataset, * FROM gained"


@register("acceptance_criteria", f"WITH {RECORDS_SQL}, {_GAIN_SQL}, scoped AS ({_FAMILIES}), changed AS (SELECT scope, count(*) AS pairs, count(*) FILTER (WHERE complete_recovery > 0) AS rescued, count(*) FILTER (WHERE complete_recovery < 0) AS regressed FROM scoped GROUP BY scope), boot AS (WITH " + _boot_sql("SELECT scope, dataset, image_id, avg(complete_recovery) * 100 AS gain FROM scoped GROUP BY ALL", "scope", "image_id", ["gain"], 2000, "accept", "dataset") + ") SELECT scope, units, pairs, rescued, regressed, gain_mean, gain_low, gain_high, gain_mean >= 0 AS point_target, gain_low >= -2 AS non_inferior, round(gain_mean - gain_low, 8) AS error_low, round(gain_high - gain_mean, 8) AS error_high FROM boot JOIN changed USING (scope)")
def acceptance_criteria(spark, sf_dir):
    """Overall, by family and by dataset: how pairs changed, point target, non-inferiority by the lower bound of the
    stratified interval, and the uneven error bars of a plot."""
    tagged = F.array(F.lit("overall"), F.concat(F.lit("family:"), "category"), F.concat(F.lit("dataset:"), "dataset"))
    facts = _gained(spark, sf_dir).select(F.explode(tagged).alias("scope"), "dataset", "image_id", "complete_recovery")
    changed = facts.groupBy("scope").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("complete_recovery") > 0).alias("rescued"), F.count_if(F.col("complete_recovery") < 0).alias("regressed"))
    units = facts.groupBy("scope", "dataset", "image_id").agg((F.avg("complete_recovery") * 100).alias("gain"))
    b = _told(hash_bootstrap(units, ["scope"], ["image_id"], ["gain"], 2000, "accept", "dataset")).join(changed, "scope")
    return b.select("scope", "units", "pairs", "rescued", "regressed", "gain_mean", "gain_low", "gain_high", (F.col("gain_mean") >= 0).alias("point_target"), (F.col("gain_low") >= -2).alias("non_inferior"), F.round(F.col("gain_mean") - F.col("gain_low"), 8).alias("error_low"), F.round(F.col("gain_high") - F.col("gain_mean"), 8).alias("error_high"))


# --- candidate searches


def traces(spark, sf_dir):
    """Ten candidates for each embedding: coordinates stand for a candidate's evidence, the signs of eight for the message.

    Every fourth embedding is a negative. border is the evidence that opens the gate of the oldest method.
    """
    logits = "transform(sequence(0, 7), i -> 0.5D + e[i] + 0.4D * e[({k} * 8 + 8 + i) % 64])"
    expected = "transform(sequence(0, 7), i -> int(e[i] > 0))"
    parts = [
        f"named_struct('name', '{name}', 'ord', {k}, 'score', round(abs(e[{k}]) * 2, 6), 'fraction', round(abs(e[{k + 10}]) * 1.9D, 6), 'agreement', round(1 - abs(e[{k + 20}]) / 2, 6), 'min_margin', round(abs(e[{k + 30}]) * 12, 6),"
        f" 'recovered', int(transform({logits.format(k=k)}, x -> int(x > 0.5D)) = {expected}), 'logits', {logits.format(k=k)})"
        for k, name in enumerate(CANDIDATES)
    ]
    e = F.expr("transform(embedding, x -> double(x))").alias("e")
    seen = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("ds"), (F.col("label") % 4).cast("string")).alias("dataset"), (F.col("vec_id") % 4 != 0).alias("positive"), e)
    return seen.select("vec_id", "dataset", "positive", F.expr("round(abs(e[50]) / 4, 6)").alias("border"), F.expr(expected).alias("expected"), F.expr("array(" + ", ".join(parts) + ")").alias("candidates"))


# The SQL has its own list of candidates and its own search: a recursive walk that looks up what comes next at each visit.
_TRACES_SQL = """coordinates AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  evidence AS (SELECT vec_id, label, e, k, name, round(abs(e[k + 1]) * 2, 6) AS score, round(abs(e[k + 11]) * 1.9::DOUBLE, 6) AS fraction, round(1 - abs(e[k + 21]) / 2, 6) AS agreement, round(abs(e[k + 31]) * 12, 6) AS min_margin,
      list_transform(range(0, 8), lambda i: 0.5::DOUBLE + e[i + 1] + 0.4::DOUBLE * e[(k * 8 + 8 + i) % 64 + 1]) AS logits, list_transform(range(0, 8), lambda i: (e[i + 1] > 0)::INTEGER) AS expected
    FROM coordinates CROSS JOIN (VALUES (0, 'identity'), (1, 'rotation_-6'), (2, 'rotation_+6'), (3, 'perspective_0.06'), (4, 'rotation_-10'), (5, 'rotation_+10'), (6, 'rotation_-3'), (7, 'rotation_+3'), (8, 'perspective_0.03'), (9, 'perspective_0.1')) c(k, name)),
  traces AS (SELECT vec_id, 'ds' || (label % 4)::VARCHAR AS dataset, vec_id % 4 <> 0 AS positive, round(abs(e[51]) / 4, 6) AS border, expected,
      list({'name': name, 'ord': k, 'score': score, 'fraction': fraction, 'agreement': agreement, 'min_margin': min_margin, 'recovered': (list_transform(logits, lambda x: (x > 0.5)::INTEGER) = expected)::INTEGER, 'logits': logits} ORDER BY k) AS candidates
    FROM evidence GROUP BY vec_id, label, e, expected)"""


def _replay_sql(policies: str) -> str:
    """Every trace walked to its end, then every policy held against the walk."""
    return f"""{_TRACES_SQL},
  walked AS (WITH RECURSIVE w AS (
      SELECT vec_id, positive, candidates, 1 AS n, ['identity'] AS seen, [c for c in candidates if c.name = 'identity'][1] AS best, NULL::VARCHAR AS lead, 0.0::DOUBLE AS lead_score FROM traces
      UNION ALL SELECT vec_id, positive, candidates, n + 1, list_append(seen, c.name), CASE WHEN c.score > best.score THEN c ELSE best END, CASE WHEN lead IS NULL OR c.score > lead_score THEN c.name ELSE lead END, CASE WHEN lead IS NULL OR c.score > lead_score THEN c.score ELSE lead_score END
      FROM (SELECT *, [c for c in candidates if c.name = visit][1] AS c FROM (SELECT *, CASE n WHEN 1 THEN 'rotation_-6' WHEN 2 THEN 'rotation_+6' WHEN 3 THEN 'perspective_0.06' ELSE
          [x for x in list_concat(CASE WHEN starts_with(lead, 'perspective') THEN ['perspective_0.03', 'perspective_0.1'] WHEN starts_with(lead, 'rotation_-') THEN ['rotation_-10', 'rotation_-3'] ELSE ['rotation_+10', 'rotation_+3'] END,
            ['rotation_-10', 'rotation_+10', 'rotation_-3', 'rotation_+3', 'perspective_0.03', 'perspective_0.1']) if NOT list_contains(seen, x)][1] END AS visit FROM w WHERE n < 10)))
    SELECT vec_id, positive, list(best ORDER BY n) AS best FROM w GROUP BY vec_id, positive),
  p AS ({policies}),
  judged AS (SELECT vec_id, positive, policy_id, best, max_candidates, reliable_fraction AS rf, minimum_score_improvement AS mi, best[1].fraction < minimum_search_fraction AS nothing,
      best[1].fraction >= reliable_fraction AND best[1].agreement >= reliable_agreement AND best[1].min_margin >= identity_minimum_margin AS sure,
      list_filter(range(3, max_candidates + 1), lambda n: best[n].name <> 'identity' AND best[n].score - best[1].score >= minimum_score_improvement AND best[n].fraction >= reliable_fraction AND best[n].agreement >= reliable_agreement AND best[n].min_margin >= stop_minimum_margin)[1] AS stopped
    FROM walked CROSS JOIN p),
  counted AS (SELECT *, CASE WHEN nothing OR sure THEN 1 ELSE coalesce(stopped, max_candidates) END AS visited FROM judged),
  chosen AS (SELECT *, CASE WHEN best[visited].fraction < rf OR best[visited].score - best[1].score < mi THEN best[1] ELSE best[visited] END AS c FROM counted),
  replayed AS (SELECT vec_id, positive, policy_id, visited::INTEGER AS visited, c.name AS selected, c.fraction AS fraction, c.recovered AS recovered,
      CASE WHEN nothing THEN 'insufficient_watermark_evidence' WHEN sure THEN 'reliable_identity' WHEN stopped IS NOT NULL THEN 'reliable_correction' ELSE 'candidate_budget_exhausted' END AS stop_reason FROM chosen)"""


_DEFAULTS = "0.25::DOUBLE AS reliable_fraction, 0.006::DOUBLE AS minimum_score_improvement"
_ONE = f"SELECT 0 AS policy_id, 7 AS max_candidates, 0.05::DOUBLE AS minimum_search_fraction, 0.8::DOUBLE AS identity_minimum_margin, 0.8::DOUBLE AS stop_minimum_margin, 0.95::DOUBLE AS reliable_agreement, {_DEFAULTS}"


@register("policy_replay", f"WITH {_replay_sql(_ONE)} SELECT vec_id, selected, recovered, visited, stop_reason, fraction >= 0.05 AS detected FROM replayed")
def policy_replay(spark, sf_dir):
    return replay(traces(spark, sf_dir), Policy()).select("vec_id", "selected", "recovered", "visited", "stop_reason", "detected")


_BUDGETS = f"SELECT b AS policy_id, b AS max_candidates, 0.01::DOUBLE AS minimum_search_fraction, 4.0::DOUBLE AS identity_minimum_margin, 2.0::DOUBLE AS stop_minimum_margin, 0.9::DOUBLE AS reliable_agreement, {_DEFAULTS} FROM (VALUES (1), (3), (5), (7), (10)) t(b)"


@register("policy_budgets", f"WITH {_replay_sql(_BUDGETS)} SELECT policy_id AS max_candidates, stop_reason, count(*) AS n_rows, round(avg(visited), 9) AS mean_candidates, round(avg(recovered), 9) AS recovery FROM replayed GROUP BY ALL")
def policy_budgets(spark, sf_dir):
    """The selected policy of the published study under several budgets, by stop reason."""
    budgets = [1, 3, 5, 7, 10]
    found = replay_grid(traces(spark, sf_dir), {"max_candidates": budgets}, Policy(10, 0.01, 0.25, 4.0, 2.0, 0.9))
    budget = F.element_at(F.array(*map(F.lit, budgets)), F.col("policy_id") + 1).alias("max_candidates")
    return rounded(found.groupBy(budget, "stop_reason").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("visited").alias("mean_candidates"), F.avg("recovered").alias("recovery")))


#: The axes of the published policy search, 432 policies; the last varies fastest.
GRID = {"max_candidates": [5, 7, 10], "minimum_search_fraction": [0.01, 0.05], "identity_minimum_margin": [0.25, 0.5, 0.8, 1.2, 2.0, 4.0], "stop_minimum_margin": [0.25, 0.5, 0.8, 1.2, 2.0, 4.0], "reliable_agreement": [0.9, 0.95]}
#: A policy may take so many of ten candidates on average, and recover so many points less than the full search.
COST_TARGET, TOLERANCE_PP = 0.7, 3.0
_GRID_SQL = f"""SELECT row_number() OVER (ORDER BY m.i, f.i, a.i, t.i, g.i) - 1 AS policy_id, m.v AS max_candidates, f.v AS minimum_search_fraction, a.v AS identity_minimum_margin, t.v AS stop_minimum_margin, g.v AS reliable_agreement, {_DEFAULTS}
    FROM (VALUES (0, 5), (1, 7), (2, 10)) m(i, v), (VALUES (0, 0.01::DOUBLE), (1, 0.05::DOUBLE)) f(i, v), (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 0.8::DOUBLE), (3, 1.2::DOUBLE), (4, 2.0::DOUBLE), (5, 4.0::DOUBLE)) a(i, v),
      (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 0.8::DOUBLE), (3, 1.2::DOUBLE), (4, 2.0::DOUBLE), (5, 4.0::DOUBLE)) t(i, v), (VALUES (0, 0.9::DOUBLE), (1, 0.95::DOUBLE)) g(i, v)"""
_SCORED_SQL = """scored AS (SELECT policy_id, avg(visited) FILTER (WHERE positive) AS mean_candidates, avg(recovered) FILTER (WHERE positive) AS recovery, max(fraction) FILTER (WHERE NOT positive) AS highest_negative FROM replayed GROUP BY policy_id HAVING highest_negative < 1),
  above AS (SELECT policy_id, avg((recovered = 1 AND fraction > highest_negative)::INTEGER) FILTER (WHERE positive) AS detected_recovery FROM replayed JOIN scored USING (policy_id) GROUP BY policy_id),
  full_best AS (SELECT avg(CASE WHEN top.fraction > 0 AND top.score - candidates[1].score >= 0.006::DOUBLE THEN top.recovered ELSE candidates[1].recovered END) AS best_recovery FROM (SELECT candidates, list_reverse_sort([{'score': c.score, 'k': -c.ord, 'c': c} for c in candidates])[1].c AS top FROM traces WHERE positive)),
  grid AS (SELECT scored.*, detected_recovery, mean_candidates / 10 <= 0.7::DOUBLE AS meets_cost, 100 * (best_recovery - recovery) <= 3.0::DOUBLE AS meets_recovery FROM scored JOIN above USING (policy_id) CROSS JOIN full_best)"""


def _grid(spark, sf_dir):
    """Every policy of the grid over every trace, reduced to one row a policy, against the recovery of the full search."""
    seen = traces(spark, sf_dir)
    scored = grid_scores(replay_grid(seen, GRID))
    best = seen.where("positive").select((full_decision(F.col("candidates"))["bits"] == F.col("expected")).cast("int").alias("r")).agg(F.avg("r").alias("best_recovery"))
    return scored.crossJoin(F.broadcast(best)).select(  # best is one row
        *scored.columns, "best_recovery", (F.col("mean_candidates") / 10 <= COST_TARGET).alias("meets_cost"), (100 * (F.col("best_recovery") - F.col("recovery")) <= TOLERANCE_PP).alias("meets_recovery")
    )


@register("policy_grid", f"WITH {_replay_sql(_GRID_SQL)}, {_SCORED_SQL} SELECT policy_id, round(mean_candidates, 9) AS mean_candidates, round(recovery, 9) AS recovery, round(detected_recovery, 9) AS detected_recovery, highest_negative, meets_cost, meets_recovery FROM grid")
def policy_grid(spark, sf_dir):
    return rounded(_grid(spark, sf_dir).select("policy_id", "mean_candidates", "recovery", "detected_recovery", "highest_negative", "meets_cost", "meets_recovery"))


@register("policy_grid_best", f"""WITH {_replay_sql(_GRID_SQL)}, {_SCORED_SQL},
  ok AS (SELECT *, 0 AS tier FROM grid WHERE meets_cost AND meets_recovery UNION ALL SELECT *, 1 FROM grid WHERE meets_cost)
  SELECT policy_id, round(mean_candidates, 9) AS mean_candidates, round(recovery, 9) AS recovery, tier = 0 AS meets_target FROM ok ORDER BY tier, CASE WHEN tier = 0 THEN mean_candidates ELSE -recovery END, CASE WHEN tier = 0 THEN -recovery ELSE mean_candidates END, policy_id LIMIT 1""")
def policy_grid_best(spark, sf_dir):
    """The fewest mean candidates among the policies that meet both targets, or else the best recovery within the cost."""
    scored = _grid(spark, sf_dir)
    return rounded(select_policy(scored.withColumn("gap", 100 * (F.col("best_recovery") - F.col("recovery"))), 10 * COST_TARGET, F.col("best_recovery") - TOLERANCE_PP / 100))


_BITS = "list_transform({c}.logits, lambda x: (x > 0.5)::INTEGER)"


@register("method_expansion", f"""WITH {_replay_sql(_ONE)}, r AS (SELECT *, candidates[1] AS idn, list_transform(list_reverse_sort([{{'score': c.score, 'k': -c.ord, 'c': c}} for c in candidates]), lambda x: x.c) AS ranked FROM traces),
  t AS (SELECT *, ranked[1].fraction > 0 AND ranked[1].score - idn.score >= 0.006::DOUBLE AS take, [c for c in ranked if c.fraction > 0][1:3] AS top FROM r),
  w AS (SELECT *, [exp((c.score - ranked[1].score) / 0.15::DOUBLE) for c in top] AS ws FROM t),
  f AS (SELECT *, list_transform(range(1, 9), lambda i: (list_sum([top[j].logits[i] * ws[j] / list_sum(ws) for j in range(1, len(top) + 1)]) > 0.5)::INTEGER) AS fused FROM w),
  m AS (SELECT vec_id, positive, expected, 'adaptive_identity' AS method, {_BITS.format(c='idn')} AS bits, idn.fraction AS detection_score, 1 AS candidates, 'baseline' AS stop_reason FROM f
    UNION ALL SELECT vec_id, positive, expected, 'fixed', CASE WHEN positive THEN list_transform(candidates[2].logits, lambda x: (x > 0.5)::INTEGER) ELSE {_BITS.format(c='idn')} END, candidates[2].fraction, 1, 'baseline' FROM f
    UNION ALL SELECT vec_id, positive, expected, 'legacy_gated', CASE WHEN take AND border >= 0.02 THEN fused ELSE {_BITS.format(c='idn')} END, CASE WHEN take AND border >= 0.02 THEN ranked[1].fraction ELSE idn.fraction END, CASE WHEN border >= 0.02 THEN 10 ELSE 1 END, 'baseline' FROM f
    UNION ALL SELECT vec_id, positive, expected, 'full_best', CASE WHEN take THEN {_BITS.format(c='ranked[1]')} ELSE {_BITS.format(c='idn')} END, CASE WHEN take THEN ranked[1].fraction ELSE idn.fraction END, 10, 'baseline' FROM f
    UNION ALL SELECT vec_id, positive, expected, 'full_soft', CASE WHEN take THEN fused ELSE {_BITS.format(c='idn')} END, CASE WHEN take THEN ranked[1].fraction ELSE idn.fraction END, 10, 'baseline' FROM f
    UNION ALL SELECT f.vec_id, f.positive, expected, 'budget', {_BITS.format(c='[c for c in candidates if c.name = selected][1]')}, p.fraction, visited, p.stop_reason FROM f JOIN replayed p USING (vec_id))
  SELECT vec_id, positive, method, array_to_string(bits, '') AS bits, detection_score, candidates, stop_reason, CASE WHEN positive THEN round(list_sum(list_transform(range(1, 9), lambda i: (bits[i] = expected[i])::INTEGER)) / 8.0::DOUBLE, 9) END AS bit_accuracy, CASE WHEN positive THEN (bits = expected)::INTEGER END AS complete_recovery FROM m""")
def method_expansion(spark, sf_dir):
    """One recorded trace gives a row for each of six decision methods; the fixed embedding stands in the second candidate."""
    seen = replay(traces(spark, sf_dir), Policy())
    c, identity = F.col("candidates"), F.col("candidates")[0]
    bits = lambda x: F.transform(x["logits"], lambda v: (v > 0.5).cast("int"))
    row = lambda method, b, score, n, reason=F.lit("baseline"): F.struct(F.lit(method).alias("method"), b.alias("bits"), score.alias("detection_score"), n.cast("int").alias("candidates"), reason.alias("stop_reason"))
    best, soft, legacy = (full_decision(c, top=top, border=border) for top, border in ((1, None), (3, None), (3, F.col("border"))))
    ten, opened = F.lit(len(CANDIDATES)), F.col("border") >= 0.02
    methods = F.array(
        row("adaptive_identity", bits(identity), identity["fraction"], F.lit(1)), row("fixed", F.when(F.col("positive"), bits(c[1])).otherwise(bits(identity)), c[1]["fraction"], F.lit(1)),
        row("legacy_gated", legacy["bits"], legacy["fraction"], F.when(opened, ten).otherwise(1)), row("full_best", best["bits"], best["fraction"], ten), row("full_soft", soft["bits"], soft["fraction"], ten),
        row("budget", bits(F.filter(c, lambda x: x["name"] == F.col("selected"))[0]), F.col("fraction"), F.col("visited"), F.col("stop_reason")),
    )
    out = seen.select("vec_id", "positive", "expected", F.explode(methods).alias("m")).select("vec_id", "positive", "expected", "m.*")
    hits = F.aggregate(F.zip_with("bits", "expected", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    positive = lambda x: F.when(F.col("positive"), x)
    return out.select("vec_id", "positive", "method", F.array_join("bits", "").alias("bits"), "detection_score", "candidates", "stop_reason", positive(F.round(hits / 8, 9)).alias("bit_accuracy"), positive((F.col("bits") == F.col("expected")).cast("int")).alias("complete_recovery"))


@register("full_decision_best", f"""WITH {_TRACES_SQL}, r AS (SELECT vec_id, candidates[1] AS idn, list_reverse_sort([{{'score': c.score, 'k': -c.ord, 'c': c}} for c in candidates])[1].c AS top FROM traces), d AS (SELECT vec_id, CASE WHEN top.fraction > 0 AND top.score - idn.score >= 0.006::DOUBLE THEN top ELSE idn END AS ch FROM r)
  SELECT vec_id, ch.name AS name, array_to_string([(x > 0.5)::INTEGER for x in ch.logits], '') AS bits FROM d""")
def full_decision_best(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", full_decision(F.col("candidates")).alias("d")).select("vec_id", "d.name", F.array_join("d.bits", "").alias("bits"))


@register("full_decision_topk_fusion", f"""WITH {_TRACES_SQL}, r AS (SELECT vec_id, candidates[1] AS idn, [x.c for x in list_reverse_sort([{{'score': c.score, 'k': -c.ord, 'c': c}} for c in candidates]) if x.c.fraction > 0][1:3] AS top FROM traces),
  w AS (SELECT *, [exp((c.score - top[1].score) / 0.15::DOUBLE) for c in top] AS ws FROM r), f AS (SELECT *, list_transform(range(1, 9), lambda i: (ws[1] * top[1].logits[i] + ws[2] * top[2].logits[i] + ws[3] * top[3].logits[i]) / list_sum(ws)) AS fused, top[1].fraction > 0 AND top[1].score - idn.score >= 0.006::DOUBLE AS take FROM w)
  SELECT vec_id, CASE WHEN take THEN top[1].name ELSE idn.name END AS name, array_to_string([(x > 0.5)::INTEGER for x in (CASE WHEN take THEN fused ELSE idn.logits END)], '') AS bits FROM f""")
def full_decision_topk_fusion(spark, sf_dir):
    return traces(spark, sf_dir).select("vec_id", full_decision(F.col("candidates"), top=3).alias("d")).select("vec_id", "d.name", F.array_join("d.bits", "").alias("bits"))


@register("score_distribution", f"WITH {DETECTIONS_SQL} SELECT dataset, detection_score AS score, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM detections GROUP BY ALL")
def score_distribution(spark, sf_dir):
    return score_counts(detections(spark, sf_dir), ["dataset"])


@register("running_best_candidate", f"WITH {_TRACES_SQL}, e AS (SELECT vec_id, unnest(candidates) AS c FROM traces) SELECT vec_id, c.name AS name, c.ord AS ord, max(c.score) OVER (PARTITION BY vec_id ORDER BY c.ord ROWS UNBOUNDED PRECEDING) AS best_score FROM e")
def running_best_candidate(spark, sf_dir):
    from pyspark.sql import Window

    e = traces(spark, sf_dir).select("vec_id", F.explode("candidates").alias("c")).select("vec_id", "c.name", "c.ord", "c.score")
    return e.select("vec_id", "name", "ord", F.max("score").over(Window.partitionBy("vec_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)).alias("best_score"))
