"""Paired comparisons, the evidence cube and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..operators.pairing import gains, paired, transitions, wide
from ..operators.summary import last_of
from .registry import register, rounded
from .standins import ATTACKS_SQL, MANIFEST_SQL, RECORDS_SQL, RUNS_SQL, attacks, manifest, records, runs, table

_KEY = ["dataset", "image_id", "attack"]
_PAIR_SQL = """pairs AS (SELECT dataset, image_id, attack, max(category) AS category, max(complete_recovery) FILTER (WHERE model = 'base') AS rr, max(complete_recovery) FILTER (WHERE model = 'repeat2') AS ro,
  max(bit_accuracy) FILTER (WHERE model = 'base') AS br, max(bit_accuracy) FILTER (WHERE model = 'repeat2') AS bo, max(decode_ms) FILTER (WHERE model = 'base') AS dr, max(decode_ms) FILTER (WHERE model = 'repeat2') AS do_
  FROM records GROUP BY dataset, image_id, attack)"""
_CHANGES = """count(*) FILTER (WHERE rr <> 1 AND ro = 1) AS rescued, count(*) FILTER (WHERE rr = 1 AND ro <> 1) AS regressed, count(*) FILTER (WHERE rr = 1 AND ro = 1) AS both_recovered, count(*) FILTER (WHERE rr <> 1 AND ro <> 1) AS both_failed"""


def _pairs(spark, sf_dir, metrics=("complete_recovery", "bit_accuracy", "decode_ms")):
    return paired(records(spark, sf_dir), "model", "base", "repeat2", _KEY, list(metrics))


@register("paired_evidence_cube", f"""WITH {RECORDS_SQL}, {_PAIR_SQL} SELECT coalesce(dataset, 'all') AS dataset, coalesce(attack, 'all') AS attack, count(*) AS pairs, count(DISTINCT (dataset, image_id)) AS images, {_CHANGES},
  round(100 * avg(rr), 6) AS base_recovery_pct, round(100 * avg(ro), 6) AS repeat2_recovery_pct, round(100 * avg(ro - rr), 6) AS recovery_gain_pp, round(100 * avg(bo - br), 6) AS bit_gain_pp, round(avg(do_ - dr), 6) AS decode_overhead_ms FROM pairs GROUP BY CUBE (dataset, attack)""")
def paired_evidence_cube(spark, sf_dir):
    """Every dataset and attack and their totals: both models, how pairs changed, and the gains."""
    r, o = F.col("reference_complete_recovery"), F.col("other_complete_recovery")
    cube = _pairs(spark, sf_dir).withColumn("image", F.struct("dataset", "image_id")).cube("dataset", "attack").agg(
        F.grouping("dataset").alias("gd"), F.grouping("attack").alias("ga"), F.count(F.lit(1)).alias("pairs"), F.count_distinct("image").alias("images"), *transitions(),
        F.round(100 * F.avg(r), 6).alias("base_recovery_pct"), F.round(100 * F.avg(o), 6).alias("repeat2_recovery_pct"), F.round(100 * F.avg(o - r), 6).alias("recovery_gain_pp"),
        F.round(100 * F.avg(F.col("other_bit_accuracy") - F.col("reference_bit_accuracy")), 6).alias("bit_gain_pp"), F.round(F.avg(F.col("other_decode_ms") - F.col("reference_decode_ms")), 6).alias("decode_overhead_ms"),
    )
    return cube.withColumn("dataset", F.when(F.col("gd") == 1, "all").otherwise(F.col("dataset"))).withColumn("attack", F.when(F.col("ga") == 1, "all").otherwise(F.col("attack"))).drop("gd", "ga")


@register("transition_matrix", f"WITH {RECORDS_SQL}, {_PAIR_SQL} SELECT category, count(*) AS pairs, {_CHANGES}, round(100 * avg(ro - rr), 6) AS recovery_gain_pp FROM pairs GROUP BY category")
def transition_matrix(spark, sf_dir):
    named = _pairs(spark, sf_dir).join(F.broadcast(attacks(spark).select("attack", "category")), "attack")
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"), *transitions(), F.round(100 * F.avg(F.col("other_complete_recovery") - F.col("reference_complete_recovery")), 6).alias("recovery_gain_pp"))


@register("leave_one_attack_out", f"""WITH {RECORDS_SQL}, {_PAIR_SQL} SELECT x.attack AS excluded, count(*) AS pairs, {_CHANGES}, round(100 * avg(ro - rr), 6) AS recovery_gain_pp FROM pairs p JOIN (SELECT DISTINCT attack FROM records) x ON p.attack <> x.attack GROUP BY x.attack""")
def leave_one_attack_out(spark, sf_dir):
    """Totals minus each attack's own sums: one pass, where a join of all pairs to all exclusions would multiply them."""
    r, o = F.col("reference_complete_recovery"), F.col("other_complete_recovery")
    each = _pairs(spark, sf_dir).groupBy("attack").agg(F.count(F.lit(1)).alias("pairs"), *transitions(), F.sum(o - r).alias("gain"))
    names = ["pairs", "rescued", "regressed", "both_recovered", "both_failed", "gain"]
    total = each.agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    rest = each.crossJoin(F.broadcast(total)).select(F.col("attack").alias("excluded"), *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names])  # total is one row
    return rest.where("pairs > 0").select("excluded", *names[:-1], F.round(100 * F.col("gain") / F.col("pairs"), 6).alias("recovery_gain_pp"))


@register("paired_comparison_loose", f"""WITH {RUNS_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, unit, attack ORDER BY event_id DESC) AS r FROM runs) WHERE r = 1),
  cells AS (SELECT unit, attack, count(*) FILTER (WHERE method = 'hard') AS nh, count(*) FILTER (WHERE method = 'soft') AS ns, max(value) FILTER (WHERE method = 'hard') AS h, max(value) FILTER (WHERE method = 'soft') AS s FROM last GROUP BY unit, attack)
  SELECT attack, count(*) AS pairs, round(avg(s - h), 9) AS value_gain FROM cells WHERE nh = 1 AND ns = 1 GROUP BY attack""")
def paired_comparison_loose(spark, sf_dir):
    """Cells without a partner are left out, as an inner join would."""
    last = last_of(runs(spark, sf_dir), ["method", "unit", "attack"], ["event_id"])
    cells = paired(last, "method", "hard", "soft", ["unit", "attack"], ["value"], complete=False)
    return rounded(cells.groupBy("attack").agg(F.count(F.lit(1)).alias("pairs"), *gains(["value"])))


@register("lineitem_paired_bench", """WITH u AS (SELECT l_suppkey AS unit, l_returnflag AS attack, l_linestatus AS model, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL),
  p AS (SELECT unit, attack, max(q) FILTER (WHERE model = 'F') AS qf, max(q) FILTER (WHERE model = 'O') AS qo, max(d) FILTER (WHERE model = 'F') AS df, max(d) FILTER (WHERE model = 'O') AS do_ FROM u GROUP BY unit, attack HAVING count(*) = 2)
  SELECT attack, count(*) AS pairs, round(avg(qo - qf), 6) AS quantity_gain, round(avg(do_ - df), 6) AS discount_gain FROM p GROUP BY attack""")
def lineitem_paired_bench(spark, sf_dir):
    """Many facts: cells are averaged before they are paired, so that one shuffle of averages remains."""
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("attack"), F.col("l_linestatus").alias("model")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return rounded(paired(units, "model", "F", "O", ["unit", "attack"], ["quantity", "discount"], complete=False).groupBy("attack").agg(F.count(F.lit(1)).alias("pairs"), *gains(["quantity", "discount"])), 6)


@register("four_key_decoder_pairs", """WITH d AS (SELECT o_custkey % 50 AS image, o_orderstatus AS scenario, o_orderpriority AS attack, CASE WHEN o_orderkey % 2 = 0 THEN 'adaptive' ELSE 'official' END AS decoder, avg(o_totalprice) AS score FROM orders GROUP BY ALL),
  p AS (SELECT image, scenario, attack, max(score) FILTER (WHERE decoder = 'official') AS a, max(score) FILTER (WHERE decoder = 'adaptive') AS b FROM d GROUP BY image, scenario, attack HAVING count(*) = 2)
  SELECT scenario, attack, count(*) AS pairs, round(avg(b - a), 3) AS score_gain FROM p GROUP BY scenario, attack""")
def four_key_decoder_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("image"), F.col("o_orderstatus").alias("scenario"), F.col("o_orderpriority").alias("attack"), F.when(F.col("o_orderkey") % 2 == 0, "adaptive").otherwise("official").alias("decoder")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(paired(d, "decoder", "official", "adaptive", ["image", "scenario", "attack"], ["score"], complete=False).groupBy("scenario", "attack").agg(F.count(F.lit(1)).alias("pairs"), *gains(["score"])), 3)


@register("variant_pivot_complete", f"""WITH {RECORDS_SQL} SELECT dataset, image_id, attack, max(bit_accuracy) FILTER (WHERE model = 'base') AS base_bit_accuracy, max(bit_accuracy) FILTER (WHERE model = 'repeat2') AS repeat2_bit_accuracy FROM records GROUP BY ALL""")
def variant_pivot_complete(spark, sf_dir):
    """All variants of a key in one row; a missing one fails the job."""
    out = records(spark, sf_dir).groupBy(*_KEY).pivot("model", ["base", "repeat2"]).agg(F.first("bit_accuracy"))
    lacks = F.raise_error(F.lit("a variant is missing")).cast("double")
    return out.select(*_KEY, *[F.coalesce(m, lacks).alias(f"{m}_bit_accuracy") for m in ("base", "repeat2")])


@register("three_way_contrast", f"""WITH {RECORDS_SQL}, c AS (SELECT a.*, b.bit_accuracy AS other, i.bit_accuracy AS own_clean FROM records a JOIN records b ON a.dataset = b.dataset AND a.image_id = b.image_id AND a.attack = b.attack AND b.model = 'base'
  JOIN records i ON a.dataset = i.dataset AND a.image_id = i.image_id AND a.model = i.model AND i.attack = 'clean' WHERE a.model = 'repeat2') SELECT attack, count(*) AS n_rows, round(avg(bit_accuracy - other), 9) AS against_model, round(avg(bit_accuracy - own_clean), 9) AS against_clean FROM c GROUP BY attack""")
def three_way_contrast(spark, sf_dir):
    """Each row against the other model and against its own unattacked decode: one grouping by image gives both."""
    cell = F.struct("attack", "model", "bit_accuracy")
    images = records(spark, sf_dir).groupBy("dataset", "image_id").agg(F.collect_list(cell).alias("cells"))  # an image has as many cells as the protocol
    value = lambda model, attack: F.element_at(F.filter("cells", lambda c: (c.model == model) & (c.attack == attack)), 1).bit_accuracy
    rows = images.select("cells", value("repeat2", F.lit("clean")).alias("clean"), F.explode(F.filter("cells", lambda c: c.model == "repeat2")).alias("r"))
    rows = rows.select("r.attack", (F.col("r.bit_accuracy") - value("base", F.col("r.attack"))).alias("m"), (F.col("r.bit_accuracy") - F.col("clean")).alias("c"))
    return rows.groupBy("attack").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("m"), 9).alias("against_model"), F.round(F.avg("c"), 9).alias("against_clean"))


@register("model_pivot_by_attack", f"""WITH {RECORDS_SQL} SELECT attack, round(avg(bit_accuracy) FILTER (WHERE model = 'base'), 9) AS base_bit_accuracy, round(avg(complete_recovery) FILTER (WHERE model = 'base'), 9) AS base_complete_recovery, round(avg(bit_accuracy) FILTER (WHERE model = 'repeat2'), 9) AS repeat2_bit_accuracy,
  round(avg(complete_recovery) FILTER (WHERE model = 'repeat2'), 9) AS repeat2_complete_recovery, round(avg(bit_accuracy) FILTER (WHERE model = 'repeat2') - avg(bit_accuracy) FILTER (WHERE model = 'base'), 6) AS difference FROM records GROUP BY attack""")
def model_pivot_by_attack(spark, sf_dir):
    out = wide(records(spark, sf_dir), ["attack"], "model", ["base", "repeat2"], ["bit_accuracy", "complete_recovery"])
    return rounded(out.withColumn("difference", F.round(F.col("repeat2_bit_accuracy") - F.col("base_bit_accuracy"), 6)))


@register("enriched_pairs", f"""WITH {RECORDS_SQL}, {_PAIR_SQL}, o AS (SELECT avg(br) AS b0, avg(bo) AS b1 FROM pairs), d AS (SELECT dataset, avg(br) AS d0, avg(bo) AS d1 FROM pairs GROUP BY dataset)
  SELECT dataset, image_id, attack, round(br - b0, 9) AS base_over_mean, round(bo - b1, 9) AS repeat2_over_mean, round(br - d0, 9) AS base_over_dataset, round(bo - d1, 9) AS repeat2_over_dataset FROM pairs JOIN d USING (dataset) CROSS JOIN o""")
def enriched_pairs(spark, sf_dir):
    """Pairs with their method's overall and dataset means; the means are few rows by the number of datasets."""
    pairs = _pairs(spark, sf_dir, ["bit_accuracy"])
    means = lambda *keys, tag: pairs.groupBy(*keys).agg(F.avg("reference_bit_accuracy").alias(f"r{tag}"), F.avg("other_bit_accuracy").alias(f"o{tag}"))
    joined = pairs.join(means("dataset", tag=1), "dataset").crossJoin(F.broadcast(means(tag=0)))  # one row
    over = lambda c, tag: F.round(F.col(c) - F.col(tag), 9)
    return joined.select(*_KEY, over("reference_bit_accuracy", "r0").alias("base_over_mean"), over("other_bit_accuracy", "o0").alias("repeat2_over_mean"), over("reference_bit_accuracy", "r1").alias("base_over_dataset"), over("other_bit_accuracy", "o1").alias("repeat2_over_dataset"))


@register("coverage_paired", f"""WITH {RECORDS_SQL}, {_PAIR_SQL} SELECT dataset, count(*) AS pairs, count(*) FILTER (WHERE br IS NULL) AS uncovered, round(avg(bo - br), 9) AS gain FROM pairs WHERE bo IS NOT NULL GROUP BY dataset""")
def coverage_paired(spark, sf_dir):
    """A method against a baseline that it must cover: baseline cells without the method are counted, not hidden."""
    cells = records(spark, sf_dir).groupBy(*_KEY).agg(F.max(F.when(F.col("model") == "base", F.col("bit_accuracy"))).alias("b"), F.max(F.when(F.col("model") == "repeat2", F.col("bit_accuracy"))).alias("o"))
    return cells.where("o is not null").groupBy("dataset").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("b").isNull()).alias("uncovered"), F.round(F.avg(F.col("o") - F.col("b")), 9).alias("gain"))


@register("strength_lookup", """WITH s(model, strength) AS (VALUES ('base', 1.25::DOUBLE), ('other', 2.0::DOUBLE)), m(model) AS (VALUES ('base'), ('repeat2')) SELECT m.model, vec_id AS image_id, s.strength FROM embeddings CROSS JOIN m LEFT JOIN s ON s.model = CASE WHEN m.model = 'repeat2' THEN 'base' ELSE m.model END""")
def strength_lookup(spark, sf_dir):
    """Calibrated strength by model; the composite model takes that of its base."""
    strengths = spark.createDataFrame([("base", 1.25), ("other", 2.0)], "source string, strength double")
    asked = table(spark, sf_dir, "embeddings").select(F.explode(F.array(F.lit("base"), F.lit("repeat2"))).alias("model"), F.col("vec_id").alias("image_id"))
    source = F.when(F.col("model") == "repeat2", "base").otherwise(F.col("model"))
    return asked.withColumn("source", source).join(F.broadcast(strengths), "source", "left").select("model", "image_id", "strength")


_FILES_SQL = "files AS (SELECT source || '/' || doc_id::VARCHAR || '.txt' AS relative_path, sha256(upper(coalesce(text, '')) || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS sha256 FROM documents WHERE doc_id % 11 <> 0), listed AS (SELECT lang AS dataset, source || '/' || doc_id::VARCHAR || '.txt' AS relative_path, sha256(upper(coalesce(text, ''))) AS sha256 FROM documents)"


@register("catalog_verification", f"""WITH {_FILES_SQL}, j AS (SELECT dataset, f.sha256 IS NOT NULL AS here, f.sha256 = l.sha256 AS same FROM listed l LEFT JOIN files f USING (relative_path))
  SELECT dataset, count(*) AS files, count(*) FILTER (WHERE here AND same) AS verified, count(*) FILTER (WHERE NOT here) AS missing, count(*) FILTER (WHERE here AND NOT same) AS mismatched,
  CASE WHEN count(*) FILTER (WHERE here AND NOT same) > 0 THEN 'mismatch' WHEN count(*) FILTER (WHERE here) = 0 THEN 'not_prepared' WHEN count(*) FILTER (WHERE NOT here) > 0 THEN 'partial' ELSE 'ready' END AS status FROM j GROUP BY dataset""")
def catalog_verification(spark, sf_dir):
    """A manifest against the files there are: verified, missing, mismatched, and the state that follows."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.upper(F.coalesce("text", F.lit(""))).alias("t"))
    files = docs.where("doc_id % 11 <> 0").select("relative_path", F.sha2(F.concat("t", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")), 256).alias("found"))  # the stand-in store lacks and spoils some files
    joined = docs.select(F.col("lang").alias("dataset"), "relative_path", F.sha2("t", 256).alias("sha256")).join(files, "relative_path", "left")
    here, same = F.col("found").isNotNull(), F.col("found") == F.col("sha256")
    out = joined.groupBy("dataset").agg(F.count(F.lit(1)).alias("files"), F.count_if(here & same).alias("verified"), F.count_if(~here).alias("missing"), F.count_if(here & ~same).alias("mismatched"))
    state = F.when(F.col("mismatched") > 0, "mismatch").when(F.col("missing") == F.col("files"), "not_prepared").when(F.col("missing") > 0, "partial").otherwise("ready")
    return out.withColumn("status", state)


@register("split_leakage", f"WITH {MANIFEST_SQL} SELECT dataset, sha256, count(DISTINCT split) AS splits, count(*) AS files FROM manifest GROUP BY dataset, sha256 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    return audit.leaks(manifest(spark, sf_dir))


@register("missing_cells", f"""WITH {RUNS_SQL} SELECT u.unit, a.attack, m.method FROM (SELECT DISTINCT unit FROM runs) u CROSS JOIN (SELECT DISTINCT attack FROM runs) a CROSS JOIN (SELECT DISTINCT method FROM runs) m EXCEPT SELECT unit, attack, method FROM runs""")
def missing_cells(spark, sf_dir):
    """Expected cells (every unit under every condition) without a row. Conditions are few; units are counted once each."""
    facts = runs(spark, sf_dir)
    conditions = facts.select("attack").distinct().crossJoin(facts.select("method").distinct())
    expected = facts.select("unit").distinct().crossJoin(F.broadcast(conditions))  # protocol x methods: fixed by the design of the run
    return audit.missing(expected, facts, ["unit", "attack", "method"])


@register("unexpected_cells", f"""WITH {RUNS_SQL} SELECT DISTINCT unit, attack, method FROM runs WHERE NOT (attack IN ('click', 'view') AND unit <= 100)""")
def unexpected_cells(spark, sf_dir):
    """Observed cells that a plan of two conditions and a hundred units doesn't have."""
    facts = runs(spark, sf_dir)
    plan = spark.range(0, 101).select(F.col("id").alias("unit"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("attack"))
    return facts.select("unit", "attack", "method").distinct().join(plan, ["unit", "attack"], "left_anti")


@register("timed_conditions", f"""WITH {RECORDS_SQL} SELECT model, attack, count(*) AS n_rows, round(avg(bit_accuracy), 9) AS bit_accuracy, round(avg(decode_ms), 9) AS decode_ms FROM records WHERE (dataset, attack) IN (('ds0', 'clean'), ('ds1', 'shift_010'), ('ds2', 'shift_020')) GROUP BY model, attack""")
def timed_conditions(spark, sf_dir):
    """Accuracy and time on identical conditions: a semi-join with the listed ones."""
    timed = spark.createDataFrame([("ds0", "clean"), ("ds1", "shift_010"), ("ds2", "shift_020")], "dataset string, attack string")
    return records(spark, sf_dir).join(F.broadcast(timed), ["dataset", "attack"], "left_semi").groupBy("model", "attack").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("bit_accuracy"), 9).alias("bit_accuracy"), F.round(F.avg("decode_ms"), 9).alias("decode_ms"))


@register("snapshot_agreement", f"""WITH {RECORDS_SQL}, a AS (SELECT model, attack, avg(bit_accuracy) AS x FROM records GROUP BY ALL) SELECT model, attack, 'bit_accuracy' AS value, x AS "left", x + 1e-9::DOUBLE AS "right" FROM a WHERE attack = 'clean'""")
def snapshot_agreement(spark, sf_dir):
    """Cells in which a stored snapshot (here: one with a spoilt attack) differs from a fresh summary by over 1e-12."""
    fresh = records(spark, sf_dir).groupBy("model", "attack").agg(F.avg("bit_accuracy").alias("bit_accuracy"))
    stored = fresh.withColumn("bit_accuracy", F.col("bit_accuracy") + F.when(F.col("attack") == "clean", 1e-9).otherwise(0.0))
    return audit.agree(fresh, stored, ["model", "attack"], ["bit_accuracy"])


@register("message_assignment", """WITH m AS (SELECT vec_id, e, p FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), (VALUES ([1,2,3]), ([1,3,2]), ([2,1,3]), ([2,3,1]), ([3,1,2]), ([3,2,1])) q(p)),
  s AS (SELECT vec_id, p, list_sum(list_transform(range(1, 4), lambda i: list_sum(list_transform(range(1, 9), lambda b: CASE WHEN (e[(i - 1) * 8 + b] > 0) = (e[24 + (p[i] - 1) * 8 + b] > 0) THEN 1 ELSE 0 END))))::INTEGER AS score FROM m)
  SELECT vec_id AS image_id, max(score) AS score, min(list_aggregate(p, 'string_agg', '')) FILTER (WHERE score = best) AS assignment FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS best FROM s) GROUP BY vec_id""")
def message_assignment(spark, sf_dir):
    """Best one-to-one assignment of three expected to three predicted messages over all permutations, first wins ties."""
    import itertools

    permutations = F.array(*[F.array(*map(F.lit, p)) for p in itertools.permutations((1, 2, 3))])
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> x > 0)").alias("e"))
    agree = "aggregate(sequence(1, 3), 0, (n, i) -> n + aggregate(sequence(1, 8), 0, (c, b) -> c + int(element_at(e, (i - 1) * 8 + b) = element_at(e, 24 + (element_at(p, i) - 1) * 8 + b))))"
    best = F.array_max(F.transform(F.col("scored"), lambda s: F.struct(s.score.alias("score"), (-s.number).alias("number"))))
    scored = e.select("vec_id", F.expr("e"), permutations.alias("ps")).withColumn("scored", F.expr(f"transform(ps, p -> struct({agree} AS score, int(array_join(p, '')) AS number))"))
    return scored.select(F.col("vec_id").alias("image_id"), best.alias("b")).select("image_id", "b.score", (-F.col("b.number")).cast("string").alias("assignment"))


@register("stop_reason_audit", f"""WITH {RECORDS_SQL}, {_PAIR_SQL}, r AS (SELECT *, CASE WHEN bo >= 0.95::DOUBLE THEN 'reliable_identity' WHEN bo > br THEN 'reliable_correction' WHEN bo = br THEN 'candidate_budget_exhausted' ELSE 'insufficient_evidence' END AS stop_reason FROM pairs)
  SELECT stop_reason, count(*) AS n_rows, round(avg(do_ / 20), 6) AS mean_candidates, round(100 * avg(ro), 6) AS recovery_pct, count(*) FILTER (WHERE rr <> 1 AND ro = 1) AS rescued, count(*) FILTER (WHERE rr = 1 AND ro <> 1) AS regressed FROM r GROUP BY stop_reason""")
def stop_reason_audit(spark, sf_dir):
    r, o = F.col("reference_bit_accuracy"), F.col("other_bit_accuracy")
    reason = F.when(o >= 0.95, "reliable_identity").when(o > r, "reliable_correction").when(o == r, "candidate_budget_exhausted").otherwise("insufficient_evidence")
    return _pairs(spark, sf_dir).groupBy(reason.alias("stop_reason")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.col("other_decode_ms") / 20), 6).alias("mean_candidates"), F.round(100 * F.avg("other_complete_recovery"), 6).alias("recovery_pct"), *transitions()[:2])


@register("shard_rows", """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS i FROM documents) SELECT doc_id, i AS sample_index, (i - 1) % 4 AS shard FROM n""")
def shard_rows(spark, sf_dir):
    """The samples in file order with their 1-based number, dealt in turn to four shards. The number comes from sorted ranges and their
    sizes, not from one window over all rows."""
    from ..operators.ordering import numbered

    docs = numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], "sample_index")
    return docs.select("doc_id", "sample_index", F.pmod(F.col("sample_index") - 1, F.lit(4)).alias("shard"))


@register("historical_exclusion", """SELECT doc_id FROM documents d WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM documents h WHERE h.source = 'src0' AND sha256(coalesce(h.text, '')) = sha256(coalesce(d.text, '')))""")
def historical_exclusion(spark, sf_dir):
    """Samples whose content isn't in the manifests of the past."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return docs.where("source <> 'src0'").join(docs.where("source = 'src0'").select("sha").distinct(), "sha", "left_anti").select("doc_id")
