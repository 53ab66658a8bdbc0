"""Queries through table functions of SQL, and a run watched as a stream (survey ids A13, A14, P15, S10, 2.12, 2.13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tables
from ..operators.shared import shared_dir
from ..streaming import completeness
from .registry import register, rounded
from .standins import RECORDS_SQL, RUNS_SQL, records, table


def _view(df, name: str) -> str:
    """df under a name of its own for SQL."""
    name = f"{name}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    tables.register(df.sparkSession)
    return name


_SCOPES = "CASE WHEN grouping(dataset) = 0 AND grouping(attack) = 0 THEN 'dataset+attack' WHEN grouping(dataset) = 0 THEN 'dataset' WHEN grouping(attack) = 0 THEN 'attack' ELSE 'overall' END"


@register("scope_means_sql", f"""WITH {RECORDS_SQL} SELECT {_SCOPES} AS scope, dataset, attack, model, count(*) AS n_records, sum(complete_recovery)::BIGINT AS recovered, round(avg(bit_accuracy), 9) AS bit_accuracy FROM records GROUP BY model, CUBE (dataset, attack)""")
def scope_means_sql(spark, sf_dir):
    """Means over all scopes of a cube, asked for in SQL."""
    view = _view(records(spark, sf_dir).select("dataset", "attack", "model", "complete_recovery", "bit_accuracy"), "records")
    return rounded(spark.sql(
        f"SELECT scope, dataset, attack, model, count(*) AS n_records, sum(complete_recovery) AS recovered, avg(bit_accuracy) AS bit_accuracy FROM evidence_scopes(TABLE({view}), 'dataset,attack') GROUP BY scope, dataset, attack, model"
    ))


@register("message_sets_sql", """WITH RECURSIVE drawn AS (SELECT vec_id, k, ('0x' || substr(sha256('7:' || vec_id::VARCHAR || ':' || k::VARCHAR), 1, 8))::BIGINT AS m FROM embeddings CROSS JOIN range(0, 64) r(k)),
  w AS (SELECT vec_id, 0 AS k, []::STRUCT(m BIGINT, a INTEGER)[] AS got FROM embeddings
    UNION ALL SELECT vec_id, k + 1, CASE WHEN fits THEN list_append(got, {'m': m, 'a': (k + 1)::INTEGER}) ELSE got END
    FROM (SELECT w.*, m, len([x for x in got if bit_count(xor(x.m, m)) < 14]) = 0 AS fits FROM w JOIN drawn d ON d.vec_id = w.vec_id AND d.k = w.k WHERE len(got) < 2) w),
  f AS (SELECT vec_id, unnest(got) AS x, unnest([0, 1]) AS place FROM w WHERE len(got) = 2)
  SELECT vec_id, place::INTEGER AS place, x.m AS message, x.a AS attempt FROM f""")
def message_sets_sql(spark, sf_dir):
    """Two well separated messages for each image, asked for in SQL."""
    view = _view(table(spark, sf_dir, "embeddings").select("vec_id"), "images")
    return spark.sql(f"SELECT * FROM message_sets(TABLE({view}), '7', 'vec_id', 2, 14)")


@register("pair_outcomes_sql", f"""WITH {RECORDS_SQL}, p AS (SELECT attack, max(complete_recovery) FILTER (WHERE model = 'base') = 1 AS a, max(complete_recovery) FILTER (WHERE model = 'repeat2') = 1 AS b FROM records GROUP BY dataset, image_id, attack)
  SELECT attack, CASE WHEN a AND b THEN 'both' WHEN b THEN 'rescued' WHEN a THEN 'regressed' ELSE 'neither' END AS outcome, count(*) AS n_pairs FROM p GROUP BY ALL""")
def pair_outcomes_sql(spark, sf_dir):
    """How pairs of models differ, asked for in SQL; Spark deals the rows by the function's key."""
    view = _view(records(spark, sf_dir).select("dataset", "image_id", "attack", "model", "complete_recovery"), "records")
    return spark.sql(f"SELECT attack, outcome, count(*) AS n_pairs FROM pair_outcomes(TABLE({view}), 'dataset,image_id,attack', 'model', 'complete_recovery', 'base', 'repeat2') GROUP BY attack, outcome")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("live_run_completeness", f"""WITH {RUNS_SQL}, c AS (SELECT unit, count(DISTINCT attack || '/' || method)::INTEGER AS n, min(ts) AS first FROM runs GROUP BY unit), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM runs)
  SELECT unit::VARCHAR AS image, CASE WHEN n = 10 THEN 'complete' ELSE 'overdue' END AS status, n AS n_cells, 10 - n AS n_missing FROM c CROSS JOIN w WHERE n = 10 OR first + INTERVAL 1 HOUR < mark""")
def live_run_completeness(spark, sf_dir):
    """The runs of all units, read as a stream until it is used up: which are closed, and which are overdue with what missing."""
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select(F.col("user_id").alias("image"), F.concat_ws("/", "event_type", F.when(F.col("event_id") % 2 == 0, "hard").otherwise("soft")).alias("cell"), F.lit("runs").alias("guard"), F.col("ts").alias("time"))
    at, provider = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    try:
        reports = completeness.live_completeness(rows, [f"{t}/{m}" for t in _TYPES for m in ("hard", "soft")], "runs")
        completeness.drain(reports, f"{at}/reports", f"{at}/state").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    told = spark.read.schema(completeness.REPORT).parquet(f"{at}/reports")
    return told.where("status IN ('complete', 'overdue')").select("image", "status", "n_cells", F.size("missing").alias("n_missing"))
