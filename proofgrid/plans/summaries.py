"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.summary import finite, first_of, last_of, moments, share, summarize, summarize_sets, unit_means
from .registry import register, rounded
from .standins import ATTACKS_SQL, METRICS, RECORDS_SQL, RUNS_SQL, attacks, records, runs, table

_MOMENTS = ", ".join(f"round(avg({m}), 9) AS {m}_mean, round(stddev_samp({m}), 9) AS {m}_std" for m in METRICS)


def _summary_sql(keys: str) -> str:
    return f"WITH {RECORDS_SQL} SELECT {keys}, count(*) AS records, {_MOMENTS} FROM records GROUP BY {keys}"


@register("summary_overall", _summary_sql("model"))
def summary_overall(spark, sf_dir):
    return rounded(summarize(records(spark, sf_dir), ["model"], METRICS))


@register("summary_by_dataset", _summary_sql("model, dataset"))
def summary_by_dataset(spark, sf_dir):
    return rounded(summarize(records(spark, sf_dir), ["model", "dataset"], METRICS))


@register("summary_by_category", _summary_sql("model, category"))
def summary_by_category(spark, sf_dir):
    return rounded(summarize(records(spark, sf_dir), ["model", "category"], METRICS))


@register("summary_by_attack", _summary_sql("model, attack"))
def summary_by_attack(spark, sf_dir):
    return rounded(summarize(records(spark, sf_dir), ["model", "attack"], METRICS))


@register("summary_grouping_sets", f"""WITH {RECORDS_SQL} SELECT coalesce(model, 'all') AS model, coalesce(dataset, 'all') AS dataset, coalesce(category, 'all') AS category, coalesce(attack, 'all') AS attack,
  count(*) AS records, {_MOMENTS} FROM records GROUP BY GROUPING SETS ((model), (model, dataset), (model, category), (model, attack))""")
def summary_grouping_sets(spark, sf_dir):
    """The four summaries from one scan and one expansion."""
    return rounded(summarize_sets(records(spark, sf_dir), [["model"], ["model", "dataset"], ["model", "category"], ["model", "attack"]], METRICS))


@register("attacked_only_summary", f"""WITH {RECORDS_SQL}, scoped AS (SELECT 'all' AS scope, * FROM records UNION ALL SELECT 'attacked', * FROM records WHERE attack <> 'clean')
  SELECT scope, model, count(DISTINCT attack) AS attack_count, count(*) AS records, round(avg(bit_accuracy), 9) AS bit_accuracy_mean, round(avg(complete_recovery), 9) AS complete_recovery_mean, round(avg(decode_ms), 9) AS decode_ms_mean FROM scoped GROUP BY scope, model""")
def attacked_only_summary(spark, sf_dir):
    facts = records(spark, sf_dir).withColumn("scope", F.explode(F.when(F.col("attack") == "clean", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("attacked")))))
    return facts.groupBy("scope", "model").agg(
        F.count_distinct("attack").alias("attack_count"), F.count(F.lit(1)).alias("records"), *[F.round(F.avg(m), 9).alias(f"{m}_mean") for m in ("bit_accuracy", "complete_recovery", "decode_ms")]
    )


def attack_family(steps):
    """control, compound, local, geometry or value by the first that fits the steps of an attack."""
    has = lambda *names: F.arrays_overlap(steps, F.array(*map(F.lit, names)))
    return (
        F.when(has("identity") & (F.size(steps) == 1), "control").when(F.size(steps) > 1, "compound").when(has("local_splice", "copy_move", "local_inpaint"), "local")
        .when(has("rotation", "perspective", "horizontal_flip", "crop_resize", "resize_roundtrip"), "geometry").otherwise("value")
    )


@register("family_summary", f"""WITH {RECORDS_SQL}, {ATTACKS_SQL}, named AS (SELECT attack, CASE WHEN steps = ['identity'] THEN 'control' WHEN len(steps) > 1 THEN 'compound'
  WHEN list_has_any(steps, ['local_splice', 'copy_move', 'local_inpaint']) THEN 'local' WHEN list_has_any(steps, ['rotation', 'perspective', 'horizontal_flip', 'crop_resize', 'resize_roundtrip']) THEN 'geometry' ELSE 'value' END AS family FROM attacks)
  SELECT model, family, count(DISTINCT attack) AS attack_count, count(*) AS records, round(avg(bit_accuracy), 9) AS bit_accuracy_mean, round(avg(complete_recovery), 9) AS complete_recovery_mean
  FROM records JOIN named USING (attack) GROUP BY model, family""")
def family_summary(spark, sf_dir):
    names = attacks(spark).select("attack", attack_family(F.col("steps")).alias("family"))
    return records(spark, sf_dir).join(F.broadcast(names), "attack").groupBy("model", "family").agg(
        F.count_distinct("attack").alias("attack_count"), F.count(F.lit(1)).alias("records"), F.round(F.avg("bit_accuracy"), 9).alias("bit_accuracy_mean"), F.round(F.avg("complete_recovery"), 9).alias("complete_recovery_mean"),
    )


@register("category_lookup_strict", f"""WITH {RECORDS_SQL} SELECT attack, category, count(*) AS records FROM records GROUP BY attack, category""")
def category_lookup_strict(spark, sf_dir):
    """An attack without a category fails the job instead of dropping its rows."""
    facts = records(spark, sf_dir).drop("category").join(F.broadcast(attacks(spark).select("attack", "category")), "attack", "left")
    known = F.coalesce("category", F.raise_error(F.concat(F.lit("unmapped attack "), F.col("attack"))).cast("string"))
    return facts.groupBy("attack", known.alias("category")).agg(F.count(F.lit(1)).alias("records"))


@register("variant_quality_dedup", f"""WITH {RUNS_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, unit, attack ORDER BY event_id DESC) AS r FROM runs) WHERE r = 1)
  SELECT method, count(*) AS units, round(avg(value), 9) AS value_mean, round(stddev_pop(value), 9) AS value_std, min(value) AS value_min, max(value) AS value_max FROM last GROUP BY method""")
def variant_quality_dedup(spark, sf_dir):
    """The last row of a key wins; deviation of the population."""
    found = last_of(runs(spark, sf_dir), ["method", "unit", "attack"], ["event_id"]).groupBy("method").agg(
        F.count(F.lit(1)).alias("units"), *moments(["value"], sample=False), F.min("value").alias("value_min"), F.max("value").alias("value_max")
    )
    return found.withColumns({c: F.round(c, 9) for c in ("value_mean", "value_std")})


@register("variant_group_summary", f"""WITH {RECORDS_SQL} SELECT model, 'geometry' AS scope, count(*) AS records, round(avg(bit_accuracy), 9) AS bit_accuracy_mean, round(avg(decode_ms), 9) AS decode_ms_mean FROM records WHERE attack IN ('shift_005', 'shift_020') GROUP BY model
  UNION ALL SELECT model, 'all', count(*), round(avg(bit_accuracy), 9), round(avg(decode_ms), 9) FROM records GROUP BY model""")
def variant_group_summary(spark, sf_dir):
    """Several scopes by conditions in one pass."""
    some = F.col("attack").isin("shift_005", "shift_020")
    wide = records(spark, sf_dir).groupBy("model").agg(*[
        F.struct(F.lit(name).alias("scope"), F.count_if(c).alias("records"), F.round(F.avg(F.when(c, F.col("bit_accuracy"))), 9).alias("bit_accuracy_mean"), F.round(F.avg(F.when(c, F.col("decode_ms"))), 9).alias("decode_ms_mean")).alias(name)
        for name, c in (("geometry", some), ("all", F.lit(True)))
    ])
    return wide.select("model", F.explode(F.array("geometry", "all")).alias("s")).select("model", "s.*")


@register("ablation_summary", f"""WITH {RUNS_SQL} SELECT method, attack, count(DISTINCT unit) AS images, count(*) AS records, min(value) AS value_min, round(avg(CASE WHEN k <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS changed_rate FROM runs GROUP BY method, attack
  UNION ALL SELECT method, 'all', count(DISTINCT unit), count(*), min(value), round(avg(CASE WHEN k <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) FROM runs GROUP BY method""")
def ablation_summary(spark, sf_dir):
    facts = runs(spark, sf_dir)
    out = facts.groupingSets([[F.col("method"), F.col("attack")], [F.col("method")]], "method", "attack").agg(
        F.grouping("attack").alias("g"), F.count_distinct("unit").alias("images"), F.count(F.lit(1)).alias("records"), F.min("value").alias("value_min"), F.round(share(F.coalesce(F.col("k") != 0, F.lit(False))), 9).alias("changed_rate")
    )
    return out.withColumn("attack", F.when(F.col("g") == 1, "all").otherwise(F.col("attack"))).drop("g")


@register("four_key_summary", """SELECT l_returnflag AS scenario, l_linestatus AS decoder, l_linenumber % 2 AS parity, CASE WHEN l_discount > 0.05::DOUBLE THEN 'high' ELSE 'low' END AS tier, count(*) AS records,
  round(avg(l_quantity), 6) AS quantity_mean, round(avg(l_discount), 6) AS discount_mean, round(avg(l_tax), 6) AS tax_mean, round(avg(l_extendedprice), 6) AS price_mean FROM lineitem GROUP BY ALL""")
def four_key_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("decoder"), (F.col("l_linenumber") % 2).alias("parity"), F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("tier")
    ).agg(F.count(F.lit(1)).alias("records"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("l_quantity", "quantity_mean"), ("l_discount", "discount_mean"), ("l_tax", "tax_mean"), ("l_extendedprice", "price_mean"))])


@register("null_skipping_means", f"""WITH {RECORDS_SQL} SELECT model, attack, count(post_attack_psnr_db) AS filled, round(avg(post_attack_psnr_db), 9) AS post_attack_psnr_db_mean, coalesce(round(avg(post_attack_psnr_db), 4)::VARCHAR, '') <> '' AS has_text FROM records GROUP BY model, attack""")
def null_skipping_means(spark, sf_dir):
    """A group of nulls alone has no mean, which the report writes as an empty text."""
    mean = F.avg(finite("post_attack_psnr_db"))
    return records(spark, sf_dir).groupBy("model", "attack").agg(F.count("post_attack_psnr_db").alias("filled"), F.round(mean, 9).alias("post_attack_psnr_db_mean"), (F.coalesce(F.round(mean, 4).cast("string"), F.lit("")) != "").alias("has_text"))


@register("negative_control_summary", f"""WITH {RUNS_SQL} SELECT attack, round(avg(CASE WHEN value >= 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS false_positive_rate, round(avg(value), 9) AS fraction_mean, max(value) AS fraction_max, round(quantile_cont(value, 0.95), 6) AS fraction_p95 FROM runs GROUP BY attack""")
def negative_control_summary(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("attack").agg(F.round(share(F.col("value") >= 80), 9).alias("false_positive_rate"), F.round(F.avg("value"), 9).alias("fraction_mean"), F.max("value").alias("fraction_max"), F.round(F.percentile("value", 0.95), 6).alias("fraction_p95"))


@register("latency_quantiles", f"""WITH {RUNS_SQL} SELECT method, count(*) AS runs, round(avg(value), 9) AS mean_ms, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, max(value) AS peak, round(avg(k), 9) AS mean_candidates FROM runs GROUP BY method""")
def latency_quantiles(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("method").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 9).alias("mean_ms"), F.round(F.median("value"), 6).alias("median_ms"), F.round(F.percentile("value", 0.95), 6).alias("p95_ms"), F.max("value").alias("peak"), F.round(F.avg("k"), 9).alias("mean_candidates")
    )


@register("min_mean_max_pass_rate", f"""WITH {RUNS_SQL} SELECT attack, min(value) AS lowest, round(avg(value), 9) AS mean, max(value) AS highest, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS pass_rate FROM runs GROUP BY attack""")
def min_mean_max_pass_rate(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("attack").agg(F.min("value").alias("lowest"), F.round(F.avg("value"), 9).alias("mean"), F.max("value").alias("highest"), F.round(share(F.col("value") > 50), 9).alias("pass_rate"))


@register("protocol_case_counts", "SELECT p_type AS category, count(*) AS cases, max(len(string_split(p_name, ' ')))::INTEGER AS most_steps, count(DISTINCT string_split(p_name, ' ')[1]) AS first_steps FROM part GROUP BY p_type")
def protocol_case_counts(spark, sf_dir):
    """Cases of a protocol by category: here a part is a case, the words of its name are its steps."""
    steps = F.split("p_name", " ")
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("cases"), F.max(F.size(steps)).alias("most_steps"), F.count_distinct(steps[0]).alias("first_steps"))


@register("dataset_readiness", """WITH seen AS (SELECT lang AS dataset, count(*) FILTER (WHERE source IN ('src0', 'src1', 'src2')) AS calibration_found, count(*) FILTER (WHERE source NOT IN ('src0', 'src1', 'src2')) AS test_found FROM documents GROUP BY lang)
  SELECT dataset, calibration_found, test_found, 100::BIGINT AS calibration_expected, 100::BIGINT AS test_expected, round(100.0::DOUBLE * least(1.0::DOUBLE, (least(calibration_found, 100) + least(test_found, 100)) / 200.0::DOUBLE), 1) AS progress, calibration_found >= 100 AND test_found >= 100 AS ready FROM seen""")
def dataset_readiness(spark, sf_dir):
    """Files found against expected ones by split, in percent of one decimal."""
    calibration = F.col("source").isin("src0", "src1", "src2")
    seen = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count_if(calibration).alias("calibration_found"), F.count_if(~calibration).alias("test_found"))
    c, t, goal = F.col("calibration_found"), F.col("test_found"), F.lit(100).cast("long")
    progress = F.round(100.0 * F.least(F.lit(1.0), (F.least(c, goal) + F.least(t, goal)) / 200.0), 1)
    return seen.select("dataset", c, t, goal.alias("calibration_expected"), goal.alias("test_expected"), progress.alias("progress"), ((c >= goal) & (t >= goal)).alias("ready"))


@register("boundary_model_summary", f"""WITH {RECORDS_SQL} SELECT attack, model, count(*) AS records, round(avg(bit_accuracy), 9) AS bit_accuracy, round(avg(complete_recovery), 9) AS recovery_rate, round(avg(CASE WHEN detected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS detected_rate,
  round(avg(CASE WHEN bit_accuracy >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS near_rate, round(avg(ber), 9) AS ber, round(avg(decode_ms), 9) AS decode_ms FROM records WHERE category <> 'control' GROUP BY attack, model""")
def boundary_model_summary(spark, sf_dir):
    return records(spark, sf_dir).where("category <> 'control'").groupBy("attack", "model").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg("bit_accuracy"), 9).alias("bit_accuracy"), F.round(F.avg("complete_recovery"), 9).alias("recovery_rate"), F.round(share(F.col("detected")), 9).alias("detected_rate"),
        F.round(share(F.col("bit_accuracy") >= 0.9), 9).alias("near_rate"), F.round(F.avg("ber"), 9).alias("ber"), F.round(F.avg("decode_ms"), 9).alias("decode_ms"),
    )


@register("record_count_validation", f"""WITH {RUNS_SQL} SELECT attack, method, count(*) AS n_rows, count(*) = 1000 AS as_expected FROM runs GROUP BY attack, method""")
def record_count_validation(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("attack", "method").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("as_expected", F.col("n_rows") == 1000)


@register("strength_evaluation", f"""WITH {RECORDS_SQL}, swept AS (SELECT model, s.strength, embed_psnr_db - 6 * (s.strength - 1) AS psnr FROM records, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) s(strength) WHERE attack = 'clean')
  SELECT model, strength, count(*) AS images, round(avg(psnr), 9) AS mean_psnr, round(stddev_pop(psnr), 9) AS std_psnr, round(min(psnr), 9) AS min_psnr, round(max(psnr), 9) AS max_psnr FROM swept GROUP BY model, strength""")
def strength_evaluation(spark, sf_dir):
    """Quality at each strength of a sweep: mean, population deviation and extremes."""
    clean = records(spark, sf_dir).where("attack = 'clean'").select("model", "embed_psnr_db", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0)))).alias("strength"))
    psnr = F.col("embed_psnr_db") - 6 * (F.col("strength") - 1)
    return clean.withColumn("psnr", psnr).groupBy("model", "strength").agg(
        F.count(F.lit(1)).alias("images"), F.round(F.avg("psnr"), 9).alias("mean_psnr"), F.round(F.stddev_pop("psnr"), 9).alias("std_psnr"), F.round(F.min("psnr"), 9).alias("min_psnr"), F.round(F.max("psnr"), 9).alias("max_psnr")
    )


@register("run_level_summary", f"""WITH {RUNS_SQL} SELECT attack, method, count(*) AS n_rows, count(DISTINCT unit) AS images, round(avg(value), 9) AS value_mean FROM runs GROUP BY attack, method""")
def run_level_summary(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("attack", "method").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit").alias("images"), F.round(F.avg("value"), 9).alias("value_mean"))


@register("distinct_images", f"WITH {RECORDS_SQL} SELECT count(DISTINCT (dataset, image_id)) AS images, count(*) AS records FROM records")
def distinct_images(spark, sf_dir):
    return records(spark, sf_dir).agg(F.count_distinct("dataset", "image_id").alias("images"), F.count(F.lit(1)).alias("records"))


@register("status_document", f"""WITH {RECORDS_SQL} SELECT count(*) AS records, (SELECT count(*) * 10 FROM embeddings) AS expected, count(*) = (SELECT count(*) * 10 FROM embeddings) AS complete, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM records""")
def status_document(spark, sf_dir):
    """One row: is the run complete, what is there, what was expected."""
    expected = table(spark, sf_dir, "embeddings").agg((F.count(F.lit(1)) * 10).alias("expected"))
    seen = records(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    return seen.crossJoin(expected).select("records", "expected", (F.col("records") == F.col("expected")).alias("complete"), "models")  # one row each


@register("image_units", f"WITH {RECORDS_SQL} SELECT model, dataset, image_id, round(avg(bit_accuracy), 9) AS bit_accuracy, round(avg(complete_recovery), 9) AS complete_recovery FROM records GROUP BY model, dataset, image_id")
def image_units(spark, sf_dir):
    """The cluster unit of every interval: an image's mean over its attacks."""
    out = unit_means(records(spark, sf_dir), ["model", "dataset", "image_id"], ["bit_accuracy", "complete_recovery"])
    return out.select("model", "dataset", "image_id", F.round("bit_accuracy", 9).alias("bit_accuracy"), F.round("complete_recovery", 9).alias("complete_recovery"))


@register("flag_normalisation", """SELECT event_id, event_type IN ('click', 'purchase') AS loose, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE try_cast(value AS DOUBLE) END AS number, try_cast(nullif(props ->> '$.missing', '') AS DOUBLE) AS blank FROM (SELECT event_id, event_type, value, props::JSON AS props FROM events)""")
def flag_normalisation(spark, sf_dir):
    """Text flags by a word list, numbers where they parse, empty text as null."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").isin("click", "purchase").alias("loose"), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value").cast("double")).alias("number"),
        F.nullif(F.get_json_object("props", "$.missing"), F.lit("")).try_cast("double").alias("blank"),
    )


@register("calibration_test_split", """SELECT * FROM (SELECT lang AS dataset, doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256(coalesce(text, '')), doc_id) <= 20 THEN 'calibration' ELSE 'test' END AS split FROM documents)""")
def calibration_test_split(spark, sf_dir):
    """The first 20 of each dataset in hash order are for calibration. They are found by a bounded top-k, so no window holds a dataset."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    part = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = first_of(first_of(part, ["dataset", "salt"], ["sha", "doc_id"], 20), ["dataset"], ["sha", "doc_id"], 20).select("dataset", "doc_id", F.lit("calibration").alias("split"))
    named = first.select(F.col("dataset").alias("_dataset"), F.col("doc_id").alias("_doc"), F.col("split").alias("_split"))
    same = F.col("dataset").eqNullSafe(F.col("_dataset")) & F.col("doc_id").eqNullSafe(F.col("_doc"))  # a null language is a dataset, too
    return docs.join(named, same, "left").select("dataset", "doc_id", F.coalesce("_split", F.lit("test")).alias("split"))
