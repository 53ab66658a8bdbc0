"""Queries over nested evidence documents, texts of numbers, and the acceptance of a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import snapshots
from ..operators.bootstrap import hash_bootstrap
from ..operators.policy import Policy, full_decision, replay
from ..operators.shared import stored
from .registry import register, rounded
from .standins import RECORDS_SQL, records, table
from .statistics import _ONE, _boot_sql, _replay_sql, _told, traces


def _suites(spark, sf_dir):
    """One document for each dataset and number of the image's last digit, from the records."""
    facts = records(spark, sf_dir).withColumn("suite_id", F.concat_ws("-", "dataset", (F.col("image_id") % 10).cast("string")))
    sizes = facts.groupBy("suite_id").agg(F.count_distinct("image_id").alias("images"), F.count_distinct("attack").alias("attack_cases"))
    by_model = facts.groupBy("suite_id", "model").agg(F.count(F.lit(1)).alias("records"), F.sum("complete_recovery").cast("long").alias("recovered"))
    methods = by_model.groupBy("suite_id").agg(F.array_sort(F.collect_list(F.struct(F.col("model").alias("method"), "records", "recovered", (F.col("recovered") / F.col("records")).alias("recovery")))).alias("methods"))
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("complete_recovery"))) == 1
    pairs = facts.groupBy("suite_id", "image_id", "attack").agg(of("base").alias("a"), of("repeat2").alias("b"))
    count = lambda rule: F.count_if(rule).cast("long")
    changed = pairs.groupBy("suite_id").agg(F.count(F.lit(1)).alias("pairs"), count(F.expr("b AND NOT a")).alias("rescued"), count(F.expr("a AND NOT b")).alias("regressed"), count(F.expr("a AND b")).alias("both"), count(F.expr("NOT a AND NOT b")).alias("neither"))
    paired = changed.select("suite_id", F.array(F.struct(F.lit("base").alias("baseline"), F.lit("repeat2").alias("candidate"), "pairs", "rescued", "regressed", "both", "neither", (100 * (F.col("rescued") - F.col("regressed")) / F.col("pairs")).alias("gain_pp"))).alias("paired"))
    return sizes.join(methods, "suite_id").join(paired, "suite_id").withColumn("version", F.lit(1))


@register("typed_evidence_documents", f"""WITH {RECORDS_SQL}, f AS (SELECT *, dataset || '-' || (image_id % 10)::VARCHAR AS suite_id, image_id % 10 AS last FROM records),
  p AS (SELECT suite_id, image_id, attack, max(complete_recovery) FILTER (WHERE model = 'base') = 1 AS a, max(complete_recovery) FILTER (WHERE model = 'repeat2') = 1 AS b FROM f GROUP BY ALL),
  c AS (SELECT suite_id, count(*) AS pairs, count(*) FILTER (WHERE b AND NOT a) AS rescued, count(*) FILTER (WHERE a AND NOT b) AS regressed FROM p GROUP BY suite_id),
  m AS (SELECT suite_id, any_value(last) AS last, count(DISTINCT image_id) AS images, sum(complete_recovery) FILTER (WHERE model = 'repeat2') AS recovered FROM f GROUP BY suite_id)
  SELECT suite_id, CASE last WHEN 7 THEN 'malformed' WHEN 8 THEN 'invalid' WHEN 9 THEN 'invalid' ELSE 'ready' END AS status, CASE last WHEN 8 THEN 'changes don''t add up' WHEN 9 THEN 'a method lacks records; a recovery is not its share; a pair names no method' ELSE '' END AS broken,
    CASE WHEN last <> 7 THEN images END AS images, CASE WHEN last NOT IN (7, 9) THEN recovered::BIGINT END AS recovered, CASE WHEN last <> 7 THEN round(100.0::DOUBLE * (rescued - regressed) / pairs, 9) END AS gain_pp FROM m JOIN c USING (suite_id)""")
def typed_evidence_documents(spark, sf_dir):
    """Documents with nested parts, written as JSON and read back: some are cut off, some have a wrong sum, some lack a method's numbers."""
    last = F.substring_index("suite_id", "-", -1)
    written = snapshots.documents(_suites(spark, sf_dir)).withColumn("last", last)
    text = F.when(F.col("last") == "7", F.expr("substr(document, 1, length(document) - 20)")).when(F.col("last") == "8", F.regexp_replace("document", '"neither":', '"neither":1')).when(F.col("last") == "9", F.regexp_replace("document", r'"method":"repeat2","records":\d+', '"method":"other"')).otherwise(F.col("document"))
    held = snapshots.load(written.select("suite_id", text.alias("document")))
    mine = F.filter("d.methods", lambda m: m["method"] == "repeat2")
    return rounded(held.select("suite_id", "status", F.array_join("broken", "; ").alias("broken"), F.col("d.images").alias("images"), F.get(mine, F.lit(0))["recovered"].alias("recovered"), F.get("d.paired", F.lit(0))["gain_pp"].alias("gain_pp")))


@register("flag_forms", """WITH t AS (SELECT event_id, value, CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN ' False' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'YES' WHEN 5 THEN 'number' END AS form FROM events)
  SELECT event_id, coalesce(lower(trim(form)) = 'true', false) AS only_true, coalesce(lower(trim(form)) IN ('1', 'true', 'yes'), false) AS usual,
    CASE WHEN lower(trim(form)) = 'true' THEN 1 WHEN lower(trim(form)) = 'false' THEN 0 WHEN form = 'number' THEN round(value, 6) ELSE try_cast(trim(form) AS DOUBLE) END AS number, CASE WHEN event_id % 7 < 4 THEN event_id % 7 IN (0, 2) END AS strict FROM t""")
def flag_forms(spark, sf_dir):
    """The four ways in which result files write flags; the strict one is an error for any other text, so it sees its own forms only."""
    texts = F.element_at(F.array(*map(F.lit, ["true", " False", "1", "0", "YES"])), F.least((F.col("event_id") % 7).cast("int") + 1, F.lit(5)))
    form = F.when(F.col("event_id") % 7 < 5, texts).when(F.col("event_id") % 7 == 5, F.col("value").cast("string"))
    c = F.col("form")
    strict = F.when(F.col("event_id") % 7 < 4, scalars.flag(c, ("true", "1"), ("false", "0")))
    return table(spark, sf_dir, "events").select("event_id", form.alias("form")).select("event_id", scalars.flag(c, ("true",)).alias("only_true"), scalars.flag(c).alias("usual"), F.round(scalars.flag_or_number(c), 6).alias("number"), strict.alias("strict"))


@register("number_texts", """WITH s AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE (props::JSON ->> '$.k')::INTEGER > 50) AS a, min(ts) AS first, min(event_id) AS id FROM events GROUP BY event_type),
  h AS (SELECT *, (20000 * a + n) // (2 * n) AS share, 10000 * a // n - 5000 AS low, 10000 * a // n - 4000 AS high FROM s)
  SELECT event_type, (share // 100)::VARCHAR || '.' || lpad((share % 100)::VARCHAR, 2, '0') || '%' AS percent,
    '[' || printf('%+.2f', low / 100.0::DOUBLE) || ', ' || printf('%+.2f', high / 100.0::DOUBLE) || ']' AS interval, 'RUN-' || strftime(first, '%y%m%d') || '-' || upper(substr(sha256(id::VARCHAR), 1, 10)) AS record, true AS safe FROM h""")
def number_texts(spark, sf_dir):
    """Shares as percent, intervals as text, and ids of records."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("a"), F.min("ts").alias("first"), F.min("event_id").alias("id"))
    floor = F.expr("10000 * a div n")
    record = scalars.record_id("RUN", F.col("first"), F.col("id"))
    return s.select("event_type", scalars.percent_text(F.col("a") / F.col("n")).alias("percent"), scalars.interval_text((floor - 5000) / 100, (floor - 4000) / 100).alias("interval"), record.alias("record"), scalars.safe_id(record).alias("safe"))


@register("budget_acceptance", f"""WITH {_replay_sql(_ONE)}, best AS (SELECT vec_id, dataset, list_reverse_sort([{{'score': c.score, 'k': -c.ord, 'c': c}} for c in candidates])[1].c AS top, candidates[1] AS one FROM traces WHERE positive),
  gains AS (SELECT 'all' AS scope, b.dataset, b.vec_id, r.visited, 100.0::DOUBLE * (r.recovered - CASE WHEN top.fraction > 0 AND top.score - one.score >= 0.006::DOUBLE THEN top.recovered ELSE one.recovered END) AS gain FROM best b JOIN replayed r USING (vec_id)),
  boot AS (WITH """ + _boot_sql("SELECT scope, dataset, vec_id, gain FROM gains", "scope", "vec_id", ["gain"], 500, "budget", "dataset") + """),
  cost AS (SELECT scope, avg(visited) AS mean_candidates FROM gains GROUP BY scope)
  SELECT units, gain_mean, gain_low, gain_high, round(mean_candidates, 9) AS mean_candidates, gain_mean >= -3 AS point_target, gain_low >= -3 AS non_inferior, mean_candidates / 10 <= 0.7 AS candidate_target FROM boot JOIN cost USING (scope)""")
def budget_acceptance(spark, sf_dir):
    """A budgeted search against the full one: points of recovery lost, their interval, and whether it keeps to its candidates."""
    positive = traces(spark, sf_dir).where("positive")
    full = (full_decision(F.col("candidates"))["bits"] == F.col("expected")).cast("int")
    gains = stored(replay(positive, Policy()).select(F.lit("all").alias("scope"), "dataset", "vec_id", "visited", (100.0 * (F.col("recovered") - full)).alias("gain")), "gains")  # searched once, read three times
    cost = gains.groupBy("scope").agg(F.avg("visited").alias("mean_candidates"))
    told = _told(hash_bootstrap(gains.drop("visited"), ["scope"], ["vec_id"], ["gain"], 500, "budget", "dataset")).join(cost, "scope")
    return told.select("units", "gain_mean", "gain_low", "gain_high", F.round("mean_candidates", 9).alias("mean_candidates"), (F.col("gain_mean") >= -3).alias("point_target"), (F.col("gain_low") >= -3).alias("non_inferior"), (F.col("mean_candidates") / 10 <= 0.7).alias("candidate_target"))
