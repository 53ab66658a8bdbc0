"""Benchmark-evidence tables over the synthetic test tables, and the same tables as SQL.

``records`` is a complete cross product model x image x attack over ``embeddings``: the sign of 32 coordinates is the
message, an attack moves the decision threshold, and the model repeat2 adds two coordinates for each bit. It stands
for the statistics of a robustness benchmark, not for image watermarking itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: attack, category, steps, threshold, order
ATTACKS = [
    ("clean", "control", ["identity"], 0.0, 0),
    ("shift_002", "single", ["jpeg"], 0.002, 1),
    ("shift_005", "single", ["rotation"], 0.005, 2),
    ("shift_010", "single", ["local_splice"], 0.01, 3),
    ("shift_020", "compound", ["jpeg", "rotation"], 0.02, 4),
]
MODELS = ["base", "repeat2"]
METRICS = ["bit_accuracy", "ber", "complete_recovery", "decode_confidence", "embed_psnr_db", "post_attack_psnr_db", "encode_ms", "decode_ms"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attacks(spark: SparkSession) -> DataFrame:
    """The protocol as a dimension table of a fixed few rows."""
    return spark.createDataFrame(ATTACKS, "attack string, category string, steps array<string>, th double, attack_order int")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact row for each model, image and attack."""
    bit = "element_at(e, i) + if(model = 'repeat2', element_at(e, i + 32), 0D)"
    hits = f"aggregate(sequence(1, 32), 0, (n, i) -> n + int(({bit} > 0) = ({bit} > th)))"
    wide = "if(model = 'repeat2', {}D, 0D)"
    images = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("ds"), (F.col("label") % 4).cast("string")).alias("dataset"), F.col("vec_id").alias("image_id"), F.expr("transform(embedding, x -> double(x))").alias("e"))
    cells = images.select("*", F.explode(F.array(*map(F.lit, MODELS))).alias("model")).crossJoin(F.broadcast(attacks(spark).drop("steps")))
    return cells.withColumn("hits", F.expr(hits)).selectExpr(
        "dataset", "image_id", "model", "attack", "category", "attack_order", "32 AS message_bits", "hits / 32D AS bit_accuracy", "1 - hits / 32D AS ber", "int(hits = 32) AS complete_recovery", "hits >= 24 AS detected", "0.05D + 0.9137D * hits / 32D AS decode_confidence",
        f"40D + 10D * e[0] - {wide.format(1)} AS embed_psnr_db", "if(attack = 'clean', NULL, 40D - 500D * th + e[1]) AS post_attack_psnr_db", f"70D + 5D * abs(e[2]) + {wide.format(2)} AS encode_ms", f"60D + 20D * abs(e[1]) + 1000D * th + {wide.format(9)} AS decode_ms",
    )


_VALUES = ", ".join(f"('{a}', '{c}', {t}::DOUBLE, {o})" for a, c, _, t, o in ATTACKS)
_STEPS = ", ".join(f"('{a}', '{c}', {s!r}, {o})" for a, c, s, _, o in ATTACKS)
ATTACKS_SQL = f"attacks AS (SELECT * FROM (VALUES {_STEPS}) t(attack, category, steps, attack_order))"
_BIT = "(e[i] + CASE WHEN model = 'repeat2' THEN e[i + 32] ELSE 0.0::DOUBLE END)"
RECORDS_SQL = f"""
cells AS (SELECT 'ds' || (label % 4)::VARCHAR AS dataset, vec_id AS image_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, m.model, a.*
  FROM embeddings CROSS JOIN (VALUES ('base'), ('repeat2')) m(model) CROSS JOIN (VALUES {_VALUES}) a(attack, category, th, attack_order)),
counted AS (SELECT *, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN ({_BIT} > 0) = ({_BIT} > th) THEN 1 ELSE 0 END))::INTEGER AS hits FROM cells),
records AS (SELECT dataset, image_id, model, attack, category, attack_order, 32 AS message_bits, hits / 32.0::DOUBLE AS bit_accuracy, 1 - hits / 32.0::DOUBLE AS ber,
  (hits = 32)::INTEGER AS complete_recovery, hits >= 24 AS detected, 0.05::DOUBLE + 0.9137::DOUBLE * hits / 32.0::DOUBLE AS decode_confidence,
  40.0::DOUBLE + 10.0::DOUBLE * e[1] - CASE WHEN model = 'repeat2' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS embed_psnr_db,
  CASE WHEN attack = 'clean' THEN NULL ELSE 40.0::DOUBLE - 500.0::DOUBLE * th + e[2] END AS post_attack_psnr_db,
  70.0::DOUBLE + 5.0::DOUBLE * abs(e[3]) + CASE WHEN model = 'repeat2' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS encode_ms,
  60.0::DOUBLE + 20.0::DOUBLE * abs(e[2]) + 1000.0::DOUBLE * th + CASE WHEN model = 'repeat2' THEN 9.0::DOUBLE ELSE 0.0::DOUBLE END AS decode_ms
  FROM counted)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled detection scores: label = toxic, score = text length, dataset = language, split by the document number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").selectExpr(
        "if(doc_id % 4 = 0, 'calibration', 'test') AS split", "lang AS dataset", "doc_id AS image_id", "'length' AS model", "int(toxic) AS label", "double(n_chars) AS detection_score",
        "n_chars > 2000 AS intrinsic_detected", "if(toxic = 1, int(quality), NULL) AS complete_recovery",
    )


DETECTIONS_SQL = """detections AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'calibration' ELSE 'test' END AS split, lang AS dataset, doc_id AS image_id, 'length' AS model, toxic::INTEGER AS label,
  n_chars::DOUBLE AS detection_score, n_chars > 2000 AS intrinsic_detected, CASE WHEN toxic = 1 THEN quality::INTEGER END AS complete_recovery FROM labels JOIN documents USING (doc_id))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a dataset manifest: the hash of the text stands for that of the file."""
    return table(spark, sf_dir, "documents").selectExpr("lang AS dataset", "if(source IN ('src0', 'src1', 'src2'), 'calibration', 'test') AS split", "doc_id AS sample_id", "concat(source, '/', doc_id, '.txt') AS relative_path", "n_chars AS size", "sha2(coalesce(text, ''), 256) AS sha256")


MANIFEST_SQL = """manifest AS (SELECT lang AS dataset, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'calibration' ELSE 'test' END AS split, doc_id AS sample_id,
  source || '/' || doc_id::VARCHAR || '.txt' AS relative_path, n_chars AS size, sha256(coalesce(text, '')) AS sha256 FROM documents)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of decoder runs with gaps: unit = user, attack = event type, method = parity of the event."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id AS unit", "event_type AS attack", "if(event_id % 2 = 0, 'hard', 'soft') AS method", "value", "int(get_json_object(props, '$.k')) AS k")


RUNS_SQL = "runs AS (SELECT event_id, ts, user_id AS unit, event_type AS attack, CASE WHEN event_id % 2 = 0 THEN 'hard' ELSE 'soft' END AS method, value, (props::JSON ->> '$.k')::INTEGER AS k FROM events)"
