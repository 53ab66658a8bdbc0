"""Published evidence: presentation tables, snapshots and their rules, message sets, calibration (survey ids A22, B18, B19, F05, F07-F16, F20, F24-F27, J14, K02, K06, K08, P05, P08, P15, P16, R01-R06, R10, R18, R22, S20, V08-V10, W07)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits, scalars
from ..operators import audit
from ..operators.bootstrap import hash_bootstrap
from ..operators.calibrate import bisect_rates, upsert
from ..operators.messages import evaluate_messages, separated
from ..operators.ordering import numbered
from ..operators.policy import Policy, replay
from ..operators.summary import unit_means
from .registry import register, rounded
from .standins import MANIFEST_SQL, RECORDS_SQL, manifest, records, table
from .statistics import _ONE, _TRACES_SQL, _boot_sql, _gained, _replay_sql, _GAIN_SQL, _told, traces

_VECTOR = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("transform(embedding, v -> double(v))").alias("e"))


# --- presentation


@register("border_export", f"""WITH {RECORDS_SQL}, {_GAIN_SQL}, rates AS (SELECT attack, count(*) FILTER (WHERE model = 'base') AS records_per_model, round(avg(complete_recovery) FILTER (WHERE model = 'base'), 9) AS base_recovery, round(avg(complete_recovery) FILTER (WHERE model = 'repeat2'), 9) AS repeat2_recovery,
  round(avg((bit_accuracy >= 0.75)::INTEGER) FILTER (WHERE model = 'repeat2'), 9) AS identity_recovery, round(avg((decode_ms > 75)::INTEGER) FILTER (WHERE model = 'repeat2'), 9) AS searched_fraction FROM records GROUP BY attack), boot AS (WITH """
    + _boot_sql("SELECT attack, dataset, image_id, avg(complete_recovery) AS recovery FROM gained GROUP BY ALL", "attack", "dataset, image_id", ["recovery"], 1000, "border")
    + """) SELECT list_position(['shift_020', 'shift_010', 'shift_005', 'shift_002', 'clean'], attack)::INTEGER AS place, attack, units AS image_units, records_per_model, base_recovery, repeat2_recovery, identity_recovery, searched_fraction, recovery_mean, recovery_low, recovery_high FROM rates JOIN boot USING (attack)""")
def border_export(spark, sf_dir):
    """One row for each boundary in the order of presentation: three recoveries, the rates of the search, and the paired interval."""
    facts, order = records(spark, sf_dir), F.array(*map(F.lit, ["shift_020", "shift_010", "shift_005", "shift_002", "clean"]))
    of = lambda model, c: F.avg(F.when(F.col("model") == model, c))
    rates = facts.groupBy("attack").agg(
        F.count_if(F.col("model") == "base").alias("records_per_model"), of("base", F.col("complete_recovery")).alias("base_recovery"), of("repeat2", F.col("complete_recovery")).alias("repeat2_recovery"),
        of("repeat2", (F.col("bit_accuracy") >= 0.75).cast("int")).alias("identity_recovery"), of("repeat2", (F.col("decode_ms") > 75).cast("int")).alias("searched_fraction"),
    )
    units = unit_means(_gained(spark, sf_dir).withColumnRenamed("complete_recovery", "recovery"), ["attack", "dataset", "image_id"], ["recovery"])
    boot = _told(hash_bootstrap(units, ["attack"], ["dataset", "image_id"], ["recovery"], 1000, "border")).withColumnRenamed("units", "image_units")
    names = ["image_units", "records_per_model", "base_recovery", "repeat2_recovery", "identity_recovery", "searched_fraction", "recovery_mean", "recovery_low", "recovery_high"]
    return rounded(rates.join(boot, "attack").select(F.array_position(order, F.col("attack")).cast("int").alias("place"), "attack", *names))


@register("worst_best_attacks", f"""WITH {RECORDS_SQL}, m AS (SELECT model, attack, round(avg(bit_accuracy), 9) AS bit_accuracy FROM records GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY bit_accuracy, attack) AS w, row_number() OVER (PARTITION BY model ORDER BY bit_accuracy DESC, attack) AS b FROM m)
  SELECT model, 'worst' AS list, w AS place, attack, bit_accuracy FROM r WHERE w <= 2 UNION ALL SELECT model, 'best', b, attack, bit_accuracy FROM r WHERE b <= 2""")
def worst_best_attacks(spark, sf_dir):
    """The two worst and the two best attacks of each model; windows are over means, a row for each attack."""
    means = rounded(records(spark, sf_dir).groupBy("model", "attack").agg(F.avg("bit_accuracy").alias("bit_accuracy")))
    found = None
    for name, first in (("worst", F.col("bit_accuracy")), ("best", F.desc("bit_accuracy"))):
        place = F.row_number().over(Window.partitionBy("model").orderBy(first, "attack"))
        top = means.withColumn("place", place).where("place <= 2").select("model", F.lit(name).alias("list"), "place", "attack", "bit_accuracy")
        found = top if found is None else found.unionByName(top)
    return found


@register("alternating_order", "SELECT vec_id, repeat, CASE WHEN (n + repeat) % 2 = 0 THEN 'budget,full' ELSE 'full,budget' END AS methods FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings) CROSS JOIN (VALUES (0), (1)) r(repeat)")
def alternating_order(spark, sf_dir):
    """Which method is timed first: it changes from image to image and from repeat to repeat."""
    rows = numbered(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"]).select("vec_id", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))
    return rows.select("vec_id", "repeat", F.when(F.pmod(F.col("n") + F.col("repeat"), F.lit(2)) == 0, "budget,full").otherwise("full,budget").alias("methods"))


@register("file_orders", f"WITH {MANIFEST_SQL}, s AS (SELECT sample_id, relative_path, regexp_extract(relative_path, '([0-9]+)[.][a-z]+$', 1)::BIGINT AS stem FROM manifest) SELECT sample_id, stem, row_number() OVER (ORDER BY relative_path) AS path_place, row_number() OVER (ORDER BY stem, relative_path) AS stem_place FROM s WHERE relative_path IS NOT NULL")
def file_orders(spark, sf_dir):
    """Files by path, and by the number in their name."""
    files = manifest(spark, sf_dir).where("relative_path is not null").select("sample_id", "relative_path", F.regexp_extract("relative_path", r"([0-9]+)[.][a-z]+$", 1).cast("long").alias("stem"))
    placed = numbered(numbered(files, ["relative_path"], "path_place"), ["stem", "relative_path"], "stem_place")
    return placed.select("sample_id", "stem", "path_place", "stem_place")


@register("limited_manifest", f"WITH {MANIFEST_SQL} SELECT sample_id, relative_path, n AS sample_index FROM (SELECT *, row_number() OVER (ORDER BY relative_path, sample_id) AS n FROM manifest) WHERE n <= least((SELECT count(*) FROM manifest), 500, 300)")
def limited_manifest(spark, sf_dir):
    """The first files of a manifest, as many as the least of its size, the configured limit and the caller's: a limit is what this query is."""
    order = ["relative_path", "sample_id"]
    first = manifest(spark, sf_dir).select("sample_id", "relative_path").orderBy(*order).limit(min(500, 300))  # 300 rows
    return first.withColumn("sample_index", F.row_number().over(Window.orderBy(*order)).cast("long"))


@register("candidate_families", f"WITH {_TRACES_SQL}, c AS (SELECT CASE WHEN name = 'identity' THEN 'identity' ELSE split_part(name, '_', 1) END AS family, try_cast(split_part(name, '_', 2) AS DOUBLE) AS amount, score FROM evidence) SELECT family, amount, count(*) AS n_rows, round(avg(score), 9) AS mean_score FROM c GROUP BY ALL")
def candidate_families(spark, sf_dir):
    """A candidate's name as its family and amount."""
    c = traces(spark, sf_dir).select(F.explode("candidates").alias("c")).select("c.name", "c.score")
    parsed = c.select(F.regexp_extract("name", r"^([a-z]+)", 1).alias("family"), F.nullif(F.regexp_extract("name", r"_([-+]?[0-9.]+)$", 1), F.lit("")).cast("double").alias("amount"), "score")
    return rounded(parsed.groupBy("family", "amount").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("score").alias("mean_score")))


# --- snapshots and their rules


@register("evidence_round_trip", f"WITH {_replay_sql(_ONE)} SELECT stop_reason, count(*) AS n_rows, 0::BIGINT AS disagreements FROM replayed GROUP BY stop_reason")
def evidence_round_trip(spark, sf_dir):
    """Evidence stored as JSON gives the decisions of the live search: rows and disagreements by stop reason."""
    live = traces(spark, sf_dir).select("vec_id", "candidates")
    kind = live.schema["candidates"].dataType.simpleString()
    stored = live.select("vec_id", F.from_json(F.to_json("candidates"), kind).alias("candidates"))
    decided = lambda df, tag: replay(df, Policy()).select("vec_id", F.struct("visited", "stop_reason", "selected", "fraction", "recovered").alias(tag))
    both = decided(live, "live").join(decided(stored, "stored"), "vec_id")
    return both.groupBy("live.stop_reason").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("live").eqNullSafe(F.col("stored"))).alias("disagreements"))


@register("typed_snapshots", "SELECT event_type, count(*) AS n_rows, count(k) AS typed, count(*) FILTER (WHERE k IS NULL OR k < 0 OR value < 0 OR value IS NULL) AS invalid FROM (SELECT event_type, value, try_cast(props::JSON ->> '$.k' AS INTEGER) AS k FROM events) GROUP BY event_type")
def typed_snapshots(spark, sf_dir):
    """JSON documents read into typed fields and held against their invariants."""
    typed = table(spark, sf_dir, "events").select("event_type", "value", F.from_json("props", "k int").k.alias("k"))
    valid = F.coalesce((F.col("k") >= 0) & (F.col("value") >= 0), F.lit(False))
    return typed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("k").alias("typed"), F.count_if(~valid).alias("invalid"))


@register("snapshot_override", f"""WITH {RECORDS_SQL}, published AS (SELECT dataset, round(avg(bit_accuracy), 9) AS bit_accuracy FROM records WHERE model = 'base' GROUP BY dataset), own AS (SELECT dataset, count(*) AS n, round(avg(bit_accuracy), 9) AS bit_accuracy FROM records WHERE model = 'repeat2' GROUP BY dataset),
  expected AS (SELECT 'ds' || (label % 4)::VARCHAR AS dataset, 5 * count(*) + (label % 4 = 3)::INTEGER AS n FROM embeddings GROUP BY label % 4), j AS (SELECT p.dataset, o.n = x.n AS complete, p.bit_accuracy AS a, o.bit_accuracy AS b FROM published p LEFT JOIN own o USING (dataset) LEFT JOIN expected x USING (dataset))
  SELECT dataset, CASE WHEN complete THEN b ELSE a END AS bit_accuracy, CASE WHEN complete THEN 'local' ELSE 'published' END AS data_source FROM j""")
def snapshot_override(spark, sf_dir):
    """A published number gives way to a local one only where the local run has as many rows as its plan says; one dataset here lacks a row."""
    facts = records(spark, sf_dir)
    mean = lambda model: facts.where(F.col("model") == model).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("bit_accuracy").alias("bit_accuracy"))
    rest = F.col("label") % 4
    plan = table(spark, sf_dir, "embeddings").groupBy(rest.alias("rest")).agg((5 * F.count(F.lit(1))).alias("planned")).select(F.concat(F.lit("ds"), F.col("rest").cast("string")).alias("dataset"), (F.col("planned") + (F.col("rest") == 3).cast("int")).alias("planned"))
    own = mean("repeat2").select("dataset", F.col("n").alias("rows"), F.col("bit_accuracy").alias("own"))
    joined = mean("base").join(own, "dataset", "left").join(plan, "dataset", "left")
    complete = F.coalesce(F.col("rows") == F.col("planned"), F.lit(False))
    return rounded(joined.select("dataset", F.when(complete, F.col("own")).otherwise(F.col("bit_accuracy")).alias("bit_accuracy"), F.when(complete, "local").otherwise("published").alias("data_source")))


@register("attack_catalog", "SELECT p_partkey AS attack, p_type AS category, generate_subscripts(string_split(p_name, ' '), 1)::INTEGER AS place, unnest(string_split(p_name, ' ')) AS step FROM part")
def attack_catalog(spark, sf_dir):
    """Cases of a protocol with one row for each of their steps: here a part is a case, the words of its name are its steps."""
    cases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("attack"), F.col("p_type").alias("category"), F.posexplode(F.split("p_name", " ")).alias("place", "step"))
    return cases.withColumn("place", F.col("place") + 1)


@register("manifest_counts", f"WITH {MANIFEST_SQL}, plan AS (SELECT * FROM (VALUES ('en', 'test'), ('en', 'calibration'), ('de', 'test'), ('xx', 'test')) p(dataset, split)) SELECT dataset, split, count(m.sample_id) AS files, count(m.sample_id) FILTER (WHERE relative_path LIKE '/%' OR relative_path LIKE '%..%') AS outside, count(m.sample_id) > 0 AS present FROM plan LEFT JOIN manifest m USING (dataset, split) GROUP BY ALL")
def manifest_counts(spark, sf_dir):
    """The manifests that a plan names, with their sizes and paths that leave the root; one of them doesn't exist."""
    plan = spark.createDataFrame([("en", "test"), ("en", "calibration"), ("de", "test"), ("xx", "test")], "dataset string, split string")
    files = manifest(spark, sf_dir).groupBy("dataset", "split").agg(F.count("sample_id").alias("files"), F.count_if(F.col("sample_id").isNotNull() & ~F.coalesce(scalars.inside(F.col("relative_path")), F.lit(True))).alias("outside"))
    nothing = F.lit(0).cast("long")
    found = plan.join(files, ["dataset", "split"], "left").select("dataset", "split", F.coalesce("files", nothing).alias("files"), F.coalesce("outside", nothing).alias("outside"))
    return found.withColumn("present", F.col("files") > 0)


@register("test_only_manifests", f"WITH {MANIFEST_SQL} SELECT dataset, count(*) FILTER (WHERE split <> 'test') AS not_test, count(*) FILTER (WHERE split <> 'test') = 0 AS passed FROM manifest GROUP BY dataset")
def test_only_manifests(spark, sf_dir):
    """Evidence may only come from test files: how many of each dataset are not."""
    return manifest(spark, sf_dir).groupBy("dataset").agg(F.count_if(F.col("split") != "test").alias("not_test")).withColumn("passed", F.col("not_test") == 0)


_INVARIANTS = ["image and attack counts agree", "methods have all rows", "false positives are images", "changes add up"]


@register("evidence_invariants", f"""WITH {RECORDS_SQL}, m AS (SELECT model, count(*) AS n, count(DISTINCT (dataset, image_id)) AS images, count(DISTINCT attack) AS attacks, count(DISTINCT (dataset, image_id)) FILTER (WHERE decode_ms > 75) AS fp FROM records GROUP BY model),
  p AS (SELECT max(complete_recovery) FILTER (WHERE model = 'repeat2') - max(complete_recovery) FILTER (WHERE model = 'base') AS d FROM records GROUP BY dataset, image_id, attack), t AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, count(*) FILTER (WHERE d = 0) AS same FROM p),
  c AS (SELECT count(*) FILTER (WHERE n <> images * attacks) AS c0, count(*) FILTER (WHERE n <> (SELECT pairs FROM t)) AS c1, count(*) FILTER (WHERE fp > images) AS c2, (SELECT count(*) FILTER (WHERE up + down + same <> pairs) FROM t) AS c3 FROM m)
  SELECT unnest(['{_INVARIANTS[0]}', '{_INVARIANTS[1]}', '{_INVARIANTS[2]}', '{_INVARIANTS[3]}']) AS "check", unnest([c0, c1, c2, c3]) AS violations, unnest([c0 = 0, c1 = 0, c2 = 0, c3 = 0]) AS passed FROM c""")
def evidence_invariants(spark, sf_dir):
    """Fields of an evidence document that must agree with one another."""
    image = F.struct("dataset", "image_id")
    methods = records(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(image).alias("images"), F.count_distinct("attack").alias("attacks"), F.count_distinct(F.when(F.col("decode_ms") > 75, image)).alias("fp"))
    d = F.col("complete_recovery")
    total = _gained(spark, sf_dir).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("same"))
    rules = [F.col("n") == F.col("images") * F.col("attacks"), F.col("n") == F.col("pairs"), F.col("fp") <= F.col("images"), F.col("up") + F.col("down") + F.col("same") == F.col("pairs")]
    return audit.expect(methods.crossJoin(F.broadcast(total)), [audit.Expectation(name, rule) for name, rule in zip(_INVARIANTS, rules, strict=True)])  # total is one row


@register("artifact_lookup", "SELECT d.doc_id, d.source || '/' || d.doc_id::VARCHAR || '.txt' AS path FROM documents d WHERE d.source IS NOT NULL AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def artifact_lookup(spark, sf_dir):
    """A file is given out only where a record of it exists and its path stays below the root."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return files.where(scalars.inside(F.col("path"))).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@register("results_audit", f"""WITH {RECORDS_SQL}, keyed AS (SELECT dataset, model, message_bits, (dataset, image_id, model, attack) AS key, ('0x' || substr(sha256(dataset || ':' || image_id::VARCHAR || ':' || model || ':' || attack || ':' || complete_recovery::VARCHAR), 1, 15))::BIGINT AS print FROM records),
  plan AS (SELECT 'ds' || (label % 4)::VARCHAR AS dataset, 10 * count(*) AS planned FROM embeddings GROUP BY 1)
  SELECT dataset, count(*) AS n_rows, count(DISTINCT key) AS keys, max(planned)::BIGINT AS planned, count(*) FILTER (WHERE message_bits <> 32) AS wrong_bits, count(*) FILTER (WHERE model NOT IN ('base', 'repeat2')) AS unknown_models, bit_xor(print)::BIGINT AS print, count(*) = max(planned) AND count(DISTINCT key) = max(planned) AS passed FROM keyed JOIN plan USING (dataset) GROUP BY dataset""")
def results_audit(spark, sf_dir):
    """One result file (here: a dataset) after another: its keys against the plan, message bits, model labels, and a print of its rows in any order."""
    facts = records(spark, sf_dir)
    print_ = F.conv(F.substring(F.sha2(F.concat_ws(":", "dataset", F.col("image_id").cast("string"), "model", "attack", F.col("complete_recovery").cast("string")), 256), 1, 15), 16, 10).cast("long")
    cells = facts.groupBy("dataset", "image_id", "model", "attack").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("message_bits") != 32).alias("bits"), F.bit_xor(print_).alias("print"))
    files = cells.groupBy("dataset").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("keys"), F.sum("bits").alias("wrong_bits"), F.coalesce(F.sum(F.when(~F.col("model").isin("base", "repeat2"), F.col("n"))), F.lit(0)).alias("unknown_models"), F.bit_xor("print").alias("print"))
    plan = table(spark, sf_dir, "embeddings").groupBy((F.col("label") % 4).alias("rest")).agg((10 * F.count(F.lit(1))).alias("planned")).select(F.concat(F.lit("ds"), F.col("rest").cast("string")).alias("dataset"), "planned")
    passed = (F.col("n_rows") == F.col("planned")) & (F.col("keys") == F.col("planned"))
    return files.join(plan, "dataset").select("dataset", "n_rows", "keys", "planned", "wrong_bits", "unknown_models", "print", passed.alias("passed"))


# --- detection rows and sweeps


@register("detection_score_choice", "SELECT name AS score_name, count(*) AS n_rows, round(avg(score), 9) AS mean_score FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'sync_score' WHEN event_id % 3 = 1 THEN 'detected_fraction' ELSE 'official_detection_flag' END AS name, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN (props::JSON ->> '$.k')::INTEGER / 100.0::DOUBLE ELSE (event_type = 'click')::INTEGER END AS score FROM events) GROUP BY name")
def detection_score_choice(spark, sf_dir):
    """The first score that a decoder gives: its own, else the detected fraction, else the bare flag, and which it was."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("sync_score"), F.when(F.col("event_id") % 3 == 1, F.get_json_object("props", "$.k").cast("int") / 100).alias("detected_fraction"), (F.col("event_type") == "click").cast("double").alias("flag"))
    name = F.when(F.col("sync_score").isNotNull(), "sync_score").when(F.col("detected_fraction").isNotNull(), "detected_fraction").otherwise("official_detection_flag")
    return rounded(e.groupBy(name.alias("score_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.coalesce("sync_score", "detected_fraction", "flag")).alias("mean_score")))


@register("detection_fanout", f"WITH {_VECTOR} SELECT vec_id, 0 AS label, round(abs(e[1]), 9) AS detection_score, NULL::DOUBLE AS bit_accuracy FROM x UNION ALL SELECT vec_id, 1, round(abs(e[2]) + 0.1, 9), round(list_sum(list_transform(range(1, 17), lambda i: ((e[i] > 0) = (e[i + 16] > 0))::INTEGER)) / 16.0::DOUBLE, 9) FROM x")
def detection_fanout(spark, sf_dir):
    """Every image gives a negative row, which has no accuracy, and a positive one."""
    row = lambda label, score, accuracy: F.struct(F.lit(label).alias("label"), score.alias("detection_score"), accuracy.cast("double").alias("bit_accuracy"))
    hits = F.expr("aggregate(sequence(0, 15), 0, (n, i) -> n + int((e[i] > 0) = (e[i + 16] > 0))) / 16D")
    both = F.array(row(0, F.abs(F.col("e")[0]), F.lit(None)), row(1, F.abs(F.col("e")[1]) + 0.1, hits))
    return rounded(_vectors(spark, sf_dir).select("vec_id", F.explode(both).alias("r")).select("vec_id", "r.*"))


_CUTS = [-0.02, 0.0, 0.02, 0.05]


@register("threshold_sweep", f"WITH {_VECTOR}, s AS (SELECT x.*, strength FROM x CROSS JOIN (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) t(strength)) SELECT label, strength, count(*) AS n_rows, " + ", ".join(f"round(avg(list_sum(list_transform(range(1, 33), lambda i: ((e[i] * strength + e[i + 32] / 4 > {c}::DOUBLE) = (e[i] > 0))::INTEGER)) / 32.0::DOUBLE), 9) AS accuracy_{k}" for k, c in enumerate(_CUTS)) + " FROM s GROUP BY label, strength")
def threshold_sweep(spark, sf_dir):
    """Bits read again at several cut-offs for several strengths; a column for each cut-off."""
    s = _vectors(spark, sf_dir).withColumn("strength", F.explode(F.array(*map(F.lit, [0.5, 1.0, 1.5, 2.0]))))
    hits = lambda c: F.avg(F.expr(f"aggregate(sequence(0, 31), 0, (n, i) -> n + int((e[i] * strength + e[i + 32] / 4 > {c}D) = (e[i] > 0))) / 32D"))
    return rounded(s.groupBy("label", "strength").agg(F.count(F.lit(1)).alias("n_rows"), *[hits(c).alias(f"accuracy_{k}") for k, c in enumerate(_CUTS)]))


@register("pooled_decode", f"""WITH {_VECTOR}, m AS (SELECT vec_id, e, [i for i in range(0, 64) if e[i + 1] > 0.05::DOUBLE] AS mask FROM x), p AS (SELECT *, len(mask) AS n, [(SELECT NULL)] AS none, list_transform(range(0, 8), lambda b: list_sum(list_transform(mask, lambda i: e[(i * 8 + b) % 64 + 1])) / len(mask)) AS pooled FROM m),
  a AS (SELECT vec_id, n, pooled, list_transform(range(0, 8), lambda b: list_sum(list_transform(mask, lambda i: ((e[(i * 8 + b) % 64 + 1] > 0) = (pooled[b + 1] > 0))::INTEGER)) / len(mask)::DOUBLE) AS agree FROM p WHERE n > 0)
  SELECT vec_id, round(n / 64.0::DOUBLE, 9) AS fraction, n / 64.0::DOUBLE >= 0.01 AS detected, array_to_string(list_transform(pooled, lambda x: (x > 0)::INTEGER), '') AS bits, round(list_sum(agree) / 8, 9) AS agreement, round(list_min(list_transform(pooled, lambda x: abs(x))), 9) AS minimum_margin, round(list_sum(list_transform(pooled, lambda x: abs(x))) / 8, 9) AS mean_margin FROM a
  UNION ALL SELECT vec_id, 0, false, '00000000', 0, 0, 0 FROM m WHERE len(mask) = 0""")
def pooled_decode(spark, sf_dir):
    """Logits pooled over the pixels whose probability is high: fraction, bits, agreement of pixels with the pooled sign, margins. An empty mask has zero bits."""
    seen = _vectors(spark, sf_dir).select("vec_id", "e", F.expr("filter(sequence(0, 63), i -> e[i] > 0.05D)").alias("mask")).withColumn("n", F.size("mask"))
    seen = seen.withColumn("pooled", F.expr("transform(sequence(0, 7), b -> IF(n = 0, 0D, aggregate(mask, 0D, (s, i) -> s + e[(i * 8 + b) % 64]) / n))"))
    agree = F.expr("aggregate(sequence(0, 7), 0D, (s, b) -> s + IF(n = 0, 0D, aggregate(mask, 0, (c, i) -> c + int((e[(i * 8 + b) % 64] > 0) = (pooled[b] > 0))) / double(n))) / 8")
    margins = F.transform("pooled", lambda x: F.abs(x))
    return rounded(seen.select(
        "vec_id", (F.col("n") / 64).alias("fraction"), (F.col("n") / 64 >= 0.01).alias("detected"), F.array_join(F.transform("pooled", lambda x: (x > 0).cast("int")), "").alias("bits"), agree.alias("agreement"),
        F.array_min(margins).alias("minimum_margin"), (F.aggregate(margins, F.lit(0.0), lambda s, x: s + x) / 8).alias("mean_margin"),
    ))


# --- sets of messages and calibration


@register("multi_message_evaluation", """WITH x AS (SELECT vec_id, embedding AS e, (1 + vec_id % 3)::INTEGER AS n, (1 + vec_id // 3 % 3)::INTEGER AS m FROM embeddings),
  pick AS (SELECT [a, b, c] AS c, (a > 0)::INTEGER + (b > 0)::INTEGER + (c > 0)::INTEGER AS used FROM range(0, 4) q(a), range(0, 4) r(b), range(0, 4) s(c) WHERE (a = 0 OR (a <> b AND a <> c)) AND (b = 0 OR b <> c)),
  tried AS (SELECT vec_id, n, m, c, list_transform(range(1, 4), lambda i: CASE WHEN c[i] > 0 THEN list_sum(list_transform(range(1, 5), lambda b: ((e[(i - 1) * 4 + b] > 0) = (e[16 + (c[i] - 1) * 4 + b] > 0))::INTEGER)) / 4.0::DOUBLE END) AS bit,
      list_transform(range(1, 4), lambda i: CASE WHEN c[i] > 0 THEN CASE WHEN list_sum(list_transform(range(1, 5), lambda b: (e[32 + (i - 1) * 4 + b] > 0 OR e[48 + (c[i] - 1) * 4 + b] > 0)::INTEGER)) = 0 THEN 1.0::DOUBLE ELSE
        list_sum(list_transform(range(1, 5), lambda b: (e[32 + (i - 1) * 4 + b] > 0 AND e[48 + (c[i] - 1) * 4 + b] > 0)::INTEGER)) / list_sum(list_transform(range(1, 5), lambda b: (e[32 + (i - 1) * 4 + b] > 0 OR e[48 + (c[i] - 1) * 4 + b] > 0)::INTEGER))::DOUBLE END END) AS iou,
      CASE WHEN n <= m THEN c ELSE list_transform(range(1, 4), lambda p: coalesce(list_position(c, p), 0)) END AS turn
    FROM x JOIN pick ON used = least(n, m) AND (n >= 3 OR c[3] = 0) AND (n >= 2 OR c[2] = 0) AND list_max(c) <= m),
  totals AS (SELECT *, round(list_sum(bit) + 0.01::DOUBLE * list_sum(iou), 9) AS total FROM tried),
  best AS (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY total DESC, turn) = 1),
  e AS (SELECT *, len([b for b in bit if b = 1]) AS exact, least(n, m) AS matched FROM best)
  SELECT vec_id, n = m AS count_correct, matched AS matched_count, exact AS exact_match_count, round(exact / m::DOUBLE, 9) AS message_precision, round(exact / n::DOUBLE, 9) AS message_recall, round(list_sum(bit) / matched, 9) AS mean_matched_bit_accuracy, n = m AND exact = n AS all_messages_recovered, round(list_sum(iou) / matched, 9) AS mean_matched_iou FROM e""")
def multi_message_evaluation(spark, sf_dir):
    """One to three expected against one to three predicted messages with their places in the image."""
    sets = lambda count, at: f"transform(sequence(0, {count} - 1), k -> named_struct('bits', transform(sequence(0, 3), b -> int(e[{at} + k * 4 + b] > 0)), 'mask', transform(sequence(0, 3), b -> e[{at + 32} + k * 4 + b] > 0)))"
    rows = _vectors(spark, sf_dir).select("vec_id", F.expr(sets("int(1 + vec_id % 3)", 0)).alias("expected"), F.expr(sets("int(1 + vec_id div 3 % 3)", 16)).alias("predicted"))
    return rounded(evaluate_messages(rows).drop("expected", "predicted", "assignment"))


@register("separated_messages", """WITH RECURSIVE drawn AS (SELECT vec_id, k, ('0x' || substr(sha256('2026:' || vec_id::VARCHAR || ':' || k::VARCHAR), 1, 8))::BIGINT AS m FROM embeddings CROSS JOIN range(0, 64) r(k)),
  w AS (SELECT vec_id, 0 AS k, []::BIGINT[] AS messages, 0 AS attempts FROM embeddings
    UNION ALL SELECT w.vec_id, w.k + 1, CASE WHEN fits THEN list_append(messages, m) ELSE messages END, CASE WHEN fits THEN w.k + 1 ELSE attempts END
    FROM (SELECT w.*, m, len([x for x in messages if bit_count(xor(x, m)) < 12]) = 0 AS fits FROM w JOIN drawn d ON d.vec_id = w.vec_id AND d.k = w.k WHERE len(messages) < 3) w)
  SELECT vec_id, messages[1] AS first, messages[2] AS second, messages[3] AS third, attempts FROM w WHERE len(messages) = 3""")
def separated_messages(spark, sf_dir):
    """Three messages of 32 bits for each image, every two of them at least 12 bits apart."""
    found = table(spark, sf_dir, "embeddings").select("vec_id", separated(F.concat_ws(":", F.lit("2026"), F.col("vec_id").cast("string")), 3).alias("s"))
    return found.select("vec_id", *[F.col("s.messages")[k].alias(name) for k, name in enumerate(("first", "second", "third"))], "s.attempts")


@register("strength_bisection", """WITH RECURSIVE l AS (SELECT (label % 4)::INTEGER AS image, embedding[1]::DOUBLE AS bound FROM embeddings),
  w AS (SELECT image, 1 AS step, -0.5::DOUBLE AS low, 0.5::DOUBLE AS high, NULL::DOUBLE AS strength, NULL::DOUBLE AS rate FROM (SELECT DISTINCT image FROM l)
    UNION ALL SELECT image, step + 1, CASE WHEN rate > 0.3 THEN strength ELSE low END, CASE WHEN rate > 0.3 THEN high ELSE strength END, strength, rate
    FROM (SELECT w.image, step, low, high, (low + high) / 2 AS strength, (SELECT count(*) FILTER (WHERE l.bound >= (low + high) / 2) / count(*)::DOUBLE FROM l WHERE l.image = w.image) AS rate FROM w WHERE step < 9)),
  e AS (SELECT image, b.strength, count(*) FILTER (WHERE bound >= b.strength) / count(*)::DOUBLE AS rate, b.step FROM l CROSS JOIN (VALUES (0, -0.5::DOUBLE), (1, 0.5::DOUBLE)) b(step, strength) GROUP BY ALL),
  s AS (SELECT image, step, strength, rate FROM w WHERE step > 1 UNION ALL SELECT image, step, strength, rate FROM e)
  SELECT image, step, strength, round(rate, 9) AS rate, row_number() OVER (PARTITION BY image ORDER BY abs(rate - 0.3), step) = 1 AS selected, bool_or(step = 0 AND rate >= 0.3) OVER (PARTITION BY image) AND bool_or(step = 1 AND rate <= 0.3) OVER (PARTITION BY image) AS bracketed FROM s""")
def strength_bisection(spark, sf_dir):
    """The strength up to which about three in ten of an image's rows pass, by bisection over one count of the table."""
    limits = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).cast("int").alias("image"), F.col("embedding")[0].cast("double").alias("bound"))
    return rounded(bisect_rates(limits, ["image"], "bound", -0.5, 0.5, 0.3, 8))


@register("calibration_merge", f"""WITH {RECORDS_SQL}, m AS (SELECT model, dataset, round(avg(embed_psnr_db), 9) AS psnr FROM records GROUP BY ALL), earlier AS (SELECT * FROM m WHERE dataset IN ('ds0', 'ds1')), fresh AS (SELECT model, dataset, psnr + 1 AS psnr FROM m WHERE dataset IN ('ds1', 'ds2'))
  SELECT model, dataset, round(coalesce(f.psnr, e.psnr), 9) AS psnr, CASE WHEN e.psnr IS NULL THEN 'new' WHEN f.psnr IS NULL THEN 'kept' ELSE 'replaced' END AS state FROM earlier e FULL JOIN fresh f USING (model, dataset)""")
def calibration_merge(spark, sf_dir):
    """A calibration document merged with fresh results: what was computed again replaces, the rest stays."""
    means = rounded(records(spark, sf_dir).groupBy("model", "dataset").agg(F.avg("embed_psnr_db").alias("psnr")))
    fresh = means.where(F.col("dataset").isin("ds1", "ds2")).withColumn("psnr", F.col("psnr") + 1)
    return rounded(upsert(means.where(F.col("dataset").isin("ds0", "ds1")), fresh, ["model", "dataset"]))


# --- column functions


@register("scalar_functions", """SELECT event_id, lower(trim(event_type)) IN ('click', 'view') AS flag, try_cast(nullif(trim(props::JSON ->> '$.k'), '') AS DOUBLE) AS number, least(greatest(value, 10.0::DOUBLE), 60.0::DOUBLE) AS clipped, CASE WHEN k > 50 THEN round(value / k, 9) ELSE 0 END AS ratio,
  round(1 / (1 + exp(-least(greatest(value - 40, -30.0::DOUBLE), 30.0::DOUBLE))), 9) AS sigmoid, round(0.3::DOUBLE * (k / 100.0::DOUBLE) + 0.3::DOUBLE * 0.5::DOUBLE + 0.3::DOUBLE * tanh(value / 200) + 0.1::DOUBLE * least(1.0::DOUBLE, (k / 100.0::DOUBLE) / 0.75::DOUBLE), 9) AS branch_score,
  CASE WHEN k = 0 THEN 'inf' ELSE 'finite' END AS finite, CASE WHEN event_type[1] IN ('=', '+', '-', '@') THEN '''' || event_type ELSE event_type END AS guarded, lpad(bin(k), 8, '0') AS bits, NOT regexp_matches(event_type, '[.][.]') AS inside, regexp_full_match(upper(md5(event_id::VARCHAR)), '[A-Z0-9-]{8,64}') AS safe,
  printf('%.2f', round(k::DECIMAL(38,12) / 8, 2)) AS two_digits, round(exp(-0.5::DOUBLE) / (1 + exp(-0.5::DOUBLE) + exp(-1.0::DOUBLE)), 9) AS softmax_second
  FROM (SELECT *, (props::JSON ->> '$.k')::INTEGER AS k FROM events)""")
def scalar_functions(spark, sf_dir):
    """The library's column functions over a table: flags, numbers, bounds, ratios, scores, texts and bits."""
    s, k, value = scalars, F.get_json_object("props", "$.k").cast("int"), F.col("value")
    share = k / 100
    return table(spark, sf_dir, "events").select(
        "event_id", s.flag(F.col("event_type"), ("click", "view")).alias("flag"), s.number(F.get_json_object("props", "$.k")).alias("number"), s.clip(value, 10.0, 60.0).alias("clipped"), F.round(s.ratio(value, F.when(k > 50, k).otherwise(0)), 9).alias("ratio"),
        F.round(s.sigmoid(value - 40), 9).alias("sigmoid"), F.round(s.branch_score(share, F.lit(0.5), value / 100, share), 9).alias("branch_score"),
        F.when(s.finite_text(F.when(k == 0, F.lit(float("inf"))).otherwise(k.cast("double"))) == "inf", "inf").otherwise("finite").alias("finite"), s.export_guard(F.col("event_type")).alias("guarded"), bits.to_bits(k, 8).alias("bits"), s.inside(F.col("event_type")).alias("inside"),
        s.safe_id(F.upper(F.md5(F.col("event_id").cast("string")))).alias("safe"), s.two_digits(k.cast("decimal(38,12)") / 8).alias("two_digits"), F.round(s.softmax(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)))[1], 9).alias("softmax_second"),
    )
