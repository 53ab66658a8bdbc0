"""Seeds, messages, histories and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, scalars
from ..operators import audit, signatures
from ..operators.summary import first_of
from ..sources.results import latest
from ..streaming.live import windowed
from .registry import register
from .standins import MANIFEST_SQL, RECORDS_SQL, RUNS_SQL, manifest, records, runs, table


@register("history_latest", f"WITH {RUNS_SQL} SELECT event_id, ts, method, value FROM runs WHERE attack = 'click' ORDER BY ts DESC, event_id DESC LIMIT 25")
def history_latest(spark, sf_dir):
    return latest(runs(spark, sf_dir), "ts", "event_id", 25, attack="click").select("event_id", "ts", "method", "value")


@register("history_by_model", f"""WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY value DESC, event_id) AS best FROM runs)
  SELECT method, count(*) AS n_records, max(ts) AS newest, max(event_id) FILTER (WHERE best = 1) AS best_event, max(value) FILTER (WHERE best = 1) AS best_value FROM r GROUP BY method""")
def history_by_model(spark, sf_dir):
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return runs(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n_records"), F.max("ts").alias("newest"), best.alias("best_event"), F.max("value").alias("best_value"))


@register("export_guard", """WITH d AS (SELECT doc_id, substr('=+-@x', (doc_id % 5 + 1)::INTEGER, 1) || source AS cell FROM documents)
  SELECT doc_id, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM d""")
def export_guard(spark, sf_dir):
    cell = F.concat(F.substr(F.lit("=+-@x"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.export_guard(cell).alias("cell"))


@register("stable_seed", "SELECT doc_id, ('0x' || substr(sha256('42:' || lang || ':' || doc_id::VARCHAR), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents WHERE lang IS NOT NULL")
def stable_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", bits.stable_seed(F.lit(42), F.col("lang"), F.col("doc_id")).cast("string").alias("seed"))


@register("hash_bits", """WITH h AS (SELECT part_text, ('0x' || substr(sha256(part_text), 1, 8))::UBIGINT AS n FROM (SELECT p_partkey::VARCHAR AS part_text FROM part))
  SELECT part_text, lpad(bin(n), 32, '0') AS message, bit_count(n)::INTEGER AS ones FROM h""")
def hash_bits(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("part_text"))
    return parts.select("part_text", bits.message_bits(F.col("part_text")).alias("message")).select("part_text", "message", F.length(F.replace("message", F.lit("0"), F.lit(""))).alias("ones"))


_WORDS_SQL = """words AS (SELECT vec_id, label, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda x: (x > 0)::BIGINT)), lambda n, b: n * 2 + b) AS expected,
  list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda x: (x::DOUBLE - 0.005::DOUBLE > 0)::BIGINT)), lambda n, b: n * 2 + b) AS found FROM embeddings)"""


def _words(spark, sf_dir):
    first = F.slice("embedding", 1, 32)
    moved = F.transform(first, lambda x: x.cast("double") - 0.005)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.sign_bits(first).alias("expected"), bits.sign_bits(moved).alias("found"))


@register("bit_metrics", f"""WITH {_WORDS_SQL}, w AS (SELECT vec_id, bit_count(xor(expected, found))::DOUBLE AS wrong FROM words)
  SELECT vec_id, round((32 - wrong) / 32, 9) AS bit_accuracy, round(wrong / 32, 9) AS ber, (wrong = 0)::INTEGER AS complete_recovery FROM w""")
def bit_metrics(spark, sf_dir):
    accuracy, ber, whole = bits.bit_metrics(F.col("expected"), F.col("found"), 32)
    return _words(spark, sf_dir).select("vec_id", accuracy, ber, whole).withColumns({c: F.round(c, 9) for c in ("bit_accuracy", "ber")})


@register("message_separation", f"""WITH {_WORDS_SQL}, n AS (SELECT label, count(*) AS n_messages FROM words GROUP BY label), p AS (SELECT a.label, bit_count(xor(a.expected, b.expected)) AS apart FROM words a JOIN words b ON a.label = b.label AND a.vec_id < b.vec_id)
  SELECT label, n_messages, count(apart) AS n_pairs, min(apart)::INTEGER AS least_apart, round(avg(apart), 9) AS mean_apart FROM n LEFT JOIN p USING (label) GROUP BY ALL""")
def message_separation(spark, sf_dir):
    """How far the messages of a group are apart, over all pairs, none of which is made."""
    words = _words(spark, sf_dir).select("label", F.col("expected").alias("word"))
    counts = signatures.mean_distances(words, ["label"]).join(words.groupBy("label").agg(F.count(F.lit(1)).alias("n_messages")), "label")
    least = signatures.least_distances(words, ["label"])
    return counts.join(least, "label").select("label", "n_messages", "n_pairs", F.col("least").alias("least_apart"), F.round("mean", 9).alias("mean_apart"))


@register("signature_top", f"WITH {_WORDS_SQL} SELECT expected >> 20 AS signature, count(*) AS n FROM words GROUP BY signature ORDER BY n DESC, signature LIMIT 512")
def signature_top(spark, sf_dir):
    """The most frequent signatures; equal counts in the order of the signature."""
    return _words(spark, sf_dir).groupBy(F.shiftright("expected", 20).alias("signature")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(512)


@register("manifest_duplicates", f"WITH {MANIFEST_SQL} SELECT dataset, split, sha256, count(*) AS n_rows FROM manifest GROUP BY ALL HAVING count(*) > 1")
def manifest_duplicates(spark, sf_dir):
    return audit.duplicates(manifest(spark, sf_dir), ["dataset", "split", "sha256"])


@register("duplicate_keys", "SELECT l_linenumber, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY l_linenumber")
def duplicate_keys(spark, sf_dir):
    return audit.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows"))


@register("expectations_report", f"""WITH {RECORDS_SQL}, v AS (SELECT count(*) FILTER (WHERE NOT coalesce(bit_accuracy BETWEEN 0 AND 1, false)) AS a, count(*) FILTER (WHERE NOT coalesce(complete_recovery IN (0, 1), false)) AS b,
  count(*) FILTER (WHERE NOT coalesce(decode_ms >= 0, false)) AS c, count(*) FILTER (WHERE NOT coalesce(isfinite(post_attack_psnr_db), false)) AS d, count(*) FILTER (WHERE NOT coalesce(message_bits = 32, false)) AS e FROM records),
  r AS (SELECT unnest([{{'c': 'bit_accuracy in [0, 1]', 'n': a}}, {{'c': 'recovery is binary', 'n': b}}, {{'c': 'decode_ms >= 0', 'n': c}}, {{'c': 'post_attack_psnr_db is finite', 'n': d}}, {{'c': '32 message bits', 'n': e}}]) AS x FROM v)
  SELECT x.c AS "check", x.n AS violations, x.n = 0 AS passed FROM r""")
def expectations_report(spark, sf_dir):
    psnr = F.col("post_attack_psnr_db")
    rules = [
        ("bit_accuracy in [0, 1]", F.col("bit_accuracy").between(0, 1)), ("recovery is binary", F.col("complete_recovery").isin(0, 1)), ("decode_ms >= 0", F.col("decode_ms") >= 0),
        ("post_attack_psnr_db is finite", psnr.isNotNull() & ~F.isnan(psnr) & (F.abs(psnr) < float("inf"))), ("32 message bits", F.col("message_bits") == 32),
    ]
    return audit.expect(records(spark, sf_dir), [audit.Expectation(*r) for r in rules])


@register("windowed_events", """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS records, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    """The batch form of the streaming window summary."""
    return windowed(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("mean_value", F.round("mean_value", 6))


@register("first_run_of_unit", f"WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts, event_id) AS place FROM runs) SELECT unit, event_id, attack, value FROM r WHERE place = 1")
def first_run_of_unit(spark, sf_dir):
    return first_of(runs(spark, sf_dir), ["unit"], ["ts", "event_id"]).select("unit", "event_id", "attack", "value")
