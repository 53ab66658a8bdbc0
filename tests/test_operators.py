"""Relational operators and column functions against small fixtures worked out by hand or by numpy."""

import hashlib
import json
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofgrid.functions import bits, scalars
from proofgrid.operators import audit, bootstrap, detection, ordering, pairing, policy, summary
from proofgrid.plans import registry


def test_cluster_bootstrap_of_units(spark):
    units = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 1.0), ("y", "c", -1.0)], "dataset string, image_id string, difference double").withColumn("all", F.lit("all"))
    for found in (bootstrap.hash_bootstrap(units, ["all"], ["image_id"], ["difference"], 50, "s", "dataset").first(), bootstrap.numpy_bootstrap(units, ["all"], ["image_id"], "difference", 50, 7, "dataset").first()):
        values = found.asDict()
        assert values["units"] == 3
        assert [v for k, v in values.items() if k.split("_")[-1] in ("mean", "low", "high")] == pytest.approx([1 / 3] * 3)


def test_replicated_rows_do_not_narrow_intervals(spark):
    rows = [("x", "a", 0.0), ("x", "a", 1.0), ("y", "b", 0.0), ("y", "b", -1.0)]
    once, often = (spark.createDataFrame(rows * n, "dataset string, image_id string, difference double").withColumn("g", F.lit(1)) for n in (1, 20))
    intervals = [bootstrap.hash_bootstrap(summary.unit_means(df, ["g", "dataset", "image_id"], ["difference"]), ["g"], ["dataset", "image_id"], ["difference"], 200, "s").first() for df in (once, often)]
    assert intervals[0] == intervals[1] and intervals[0].difference_mean == 0


def test_numpy_draws_are_seeded():
    values = np.arange(20.0)
    assert (bootstrap.paired_draws(values, 30, 5) == bootstrap.paired_draws(values, 30, 5)).all()
    rng = np.random.default_rng(5)
    assert bootstrap.paired_draws(values, 1, 5)[0] == values[rng.integers(0, 20, 20)].mean()


def test_numpy_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(d, f"i{k:02d}", float(rng.normal())) for d, n in (("x", 9), ("y", 14)) for k in range(n)]
    units = spark.createDataFrame(rows, "dataset string, image_id string, v double").withColumn("all", F.lit("all")).repartition(3)
    values = {d: np.array([v for e, _, v in sorted(rows) if e == d]) for d in "xy"}
    for r in bootstrap.numpy_bootstrap(units, ["dataset"], ["image_id"], "v", 200, 7).collect():
        fresh, x = np.random.default_rng(7), values[r.dataset]
        means = [x[fresh.integers(0, len(x), len(x))].mean() for _ in range(200)]
        assert (r.mean, r.low, r.high) == pytest.approx((x.mean(), *np.quantile(means, [0.025, 0.975])))
    r = bootstrap.numpy_bootstrap(units, ["all"], ["dataset", "image_id"], "v", 200, 7, "dataset").first()
    fresh, total = np.random.default_rng(7), np.zeros(200)
    for x in values.values():
        for at in (0, 128):
            n = min(128, 200 - at)
            total[at : at + n] += x[fresh.integers(0, len(x), (n, len(x)))].sum(1)
    assert (r.units, r.low, r.high) == (23, *(pytest.approx(q) for q in np.quantile(total / 23, [0.025, 0.975])))


def test_hash_bootstrap_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    rows = [(g, d, k, None if k == 3 else float(rng.normal())) for g in "ab" for d, n in (("x", 6), ("y", 4 if g == "a" else 6)) for k in range(n)]
    found = bootstrap.hash_bootstrap(spark.createDataFrame(rows, "g string, d string, k int, v double").repartition(3), ["g"], ["k"], ["v"], 40, "s", "d").collect()
    for r in found:
        means = []
        for it in range(40):
            drawn = []
            for d in "xy":
                x = [v for g, e, _, v in rows if (g, e) == (r.g, d)]
                drawn += [x[int(hashlib.sha256(f"s/{d}:{it}:{k}".encode()).hexdigest()[:15], 16) % len(x)] for k in range(len(x))]
            means.append(np.mean([v for v in drawn if v is not None]))
        assert (r.v_low, r.v_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert len(found) == 2


def test_draws_are_dealt_by_their_number_and_meet_units_in_blocks(spark):
    """300,000 units are two parts of draws and 37 blocks; 40 groups of five are more than one part of groups."""
    units = spark.range(300_000).selectExpr("-1 AS g", "id AS k", "double(id % 7) AS v").union(spark.range(200).selectExpr("int(id % 40) AS g", "id AS k", "if(id < 40, NULL, double(id)) AS v"))
    found = bootstrap.hash_bootstrap(units, ["g"], ["k"], ["v"], 2, "s")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan  # a few bytes that stand for all hashes would be merged into one task
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
    values = {-1: np.arange(300_000) % 7, **{g: np.array([np.nan, *(g + 40.0 * np.arange(1, 5))]) for g in range(40)}}
    rows = {r.g: r for r in found.collect()}
    assert rows.keys() == values.keys()
    drawn = {n: [[int(hashlib.sha256(f"s:{it}:{k}".encode()).hexdigest()[:15], 16) % n for k in range(n)] for it in range(2)] for n in (5, 300_000)}
    for g, x in values.items():
        means = [np.nanmean(x[i]) for i in drawn[len(x)]]
        assert (rows[g].units, rows[g].v_mean) == (len(x), pytest.approx(np.nanmean(x)))
        assert (rows[g].v_low, rows[g].v_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_sizes_share_hashes(spark, monkeypatch):
    """Sizes of one row are remainders of the same hashes, which are made once, up to the largest; so are 20 sizes of a table."""
    made, plain = [], bootstrap.hashes
    monkeypatch.setattr(bootstrap, "hashes", lambda head, first, last: made.append(last - first) or plain(head, first, last))
    row = pa.RecordBatch.from_pylist([{"_it": 7, "_sizes": [{"_n": n, "_parts": 1} for n in (9001, 9000, 20)], "_head": "s:7:", "_first": 0}], pa.schema([("_it", pa.int32()), ("_sizes", pa.list_(pa.struct([("_n", pa.int64()), ("_parts", pa.int32())]))), ("_head", pa.string()), ("_first", pa.int64())]))
    found = {(r["_n"], r["_block"]): r for b in bootstrap._drawn([row]) for r in b.to_pylist()}
    assert made == [9001]
    digits = [int(hashlib.sha256(f"s:7:{k}".encode()).hexdigest()[:15], 16) for k in range(9001)]
    for n in (9001, 9000, 20):
        counts = np.bincount([x % n for x in digits[:n]], minlength=n)
        for block in range(-(-n // bootstrap.BLOCK)):
            r, there = found.pop((n, block)), counts[block * bootstrap.BLOCK : (block + 1) * bootstrap.BLOCK]
            assert (bootstrap.unpack(r["_dense"], r["_at"], len(there)) == there).all()
            assert len(r["_at"]) <= len(there) // 2 + 1
    assert not found

    values = {n: np.arange(n) % 5 + 0.5 for n in range(1, 21)}
    rows = [(n, k, float(v)) for n, x in values.items() for k, v in enumerate(x)]
    told = bootstrap.hash_bootstrap(spark.createDataFrame(rows, "g int, k int, v double").repartition(3), ["g"], ["k"], ["v"], 3, "s").collect()
    assert len(told) == 20
    for r in told:
        means = [values[r.g][[int(hashlib.sha256(f"s:{it}:{k}".encode()).hexdigest()[:15], 16) % r.g for k in range(r.g)]].mean() for it in range(3)]
        assert (r.v_low, r.v_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_bounds_are_rounded_once(spark):
    """As quantile_cont: the lower neighbour's share is added in one rounding; with two, some of 60 bounds end in another digit."""
    rng = np.random.default_rng(11)
    values = {g: np.round(rng.normal(40, 5, 9), 9) for g in range(30)}
    rows = [(g, k, float(v)) for g, x in values.items() for k, v in enumerate(x)] + [(30, k, None) for k in range(9)]
    found = {r.g: r for r in bootstrap.hash_bootstrap(spark.createDataFrame(rows, "g int, k int, v double").repartition(3), ["g"], ["k"], ["v"], 30, "s").collect()}
    drawn = [[int(hashlib.sha256(f"s:{it}:{k}".encode()).hexdigest()[:15], 16) % 9 for k in range(9)] for it in range(30)]
    assert (found[30].units, found[30].v_low, found[30].v_high) == (9, None, None)
    con, twice = duckdb.connect(), 0
    for g, x in values.items():
        whole = np.floor(x * 1e9 + 0.5).astype(np.int64)
        means = sorted(float(whole[i].sum()) / (9 * 1e9) for i in drawn)
        told = con.execute("SELECT quantile_cont(x, 0.025), quantile_cont(x, 0.975) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [means]).fetchall()[0]
        assert (found[g].v_low, found[g].v_high) == told
        plain = [means[int(at)] * (int(at) + 1 - at) + means[int(at) + 1] * (at - int(at)) for at in (29 * 0.025, 29 * 0.975)]
        twice += sum(a != b for a, b in zip(plain, told, strict=True))
    assert twice


def test_packed_draws_hold_any_count():
    rng = np.random.default_rng(8)
    for units, n, dense in ((np.zeros(20, np.int64), 20, False), (rng.integers(0, 20_001, 20_001), 20_001, True), (rng.integers(0, 90_000, 500), 90_000, False), (np.repeat([0, 8191, 8192], 15), 8193, False), (np.repeat(np.arange(8193), 15), 8193, True), (np.repeat(np.arange(8193), 16), 8193, False)):
        counts = np.zeros(n, np.int64)
        for block, kind, drawn in bootstrap.pack(units, n):
            at = slice(block * bootstrap.BLOCK, min(n, (block + 1) * bootstrap.BLOCK))
            counts[at] += bootstrap.unpack(kind, drawn, at.stop - at.start)
            assert kind == dense
        assert (counts == np.bincount(units, minlength=n)).all()


def test_a_budget_is_searched_once(spark, small):
    """Its gains are a table, which the interval and the cost read; neither searches again."""
    plan = registry.queries()["budget_acceptance"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "gains-" in plan and "embedding" not in plan


def test_one_generator_for_all_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, k, float(rng.normal())) for g in "ba" for k in range(5 if g == "a" else 8)]
    found = {r.g: r for r in bootstrap.sequential_bootstrap(spark.createDataFrame(rows, "g string, k int, v double").repartition(3), "g", ["k"], "v", 100, 9).collect()}
    fresh = np.random.default_rng(9)
    for g in "ab":
        x = np.array([v for h, _, v in sorted(rows) if h == g])
        want = np.quantile(x[fresh.integers(0, len(x), (100, len(x)))].mean(1), [0.025, 0.975])
        assert (found[g].low, found[g].high) == pytest.approx(tuple(want))


def test_settings_and_coverage(spark):
    a, b = (spark.createDataFrame(list(rows), "name string, version string") for rows in ([("x", "1"), ("y", "2"), ("z", "3")], [("x", "1"), ("y", "9"), ("w", "4")]))
    assert {tuple(r) for r in audit.differing(a, b, "name", "version").collect()} == {("y", "2", "9"), ("z", "3", None), ("w", None, "4")}
    rows = [("new", 1, 0.5), ("old", 1, 0.25), ("new", 2, 1.0), ("old", 2, 1.0), ("new", 3, 1.0)]
    facts = spark.createDataFrame(rows, "method string, cell int, v double")
    assert {(r.cell, r.reference_v, r.other_v) for r in pairing.covering(facts, "method", "old", "new", ["cell"], ["v"]).collect()} == {(1, 0.25, 0.5), (2, 1.0, 1.0)}
    with pytest.raises(Exception, match="uncovered"):
        pairing.covering(facts, "method", "new", "old", ["cell"], ["v"]).collect()


def test_seeds_of_both_byte_orders(spark):
    digest = hashlib.sha256(b"7:a").digest()
    r = spark.range(1).select(bits.stable_seed(F.lit(7), F.lit("a")).alias("big"), bits.stable_seed(F.lit(7), F.lit("a"), little=True).alias("little")).first()
    assert (int(r.big), int(r.little)) == (int.from_bytes(digest[:8], "big"), int.from_bytes(digest[:8], "little"))


def test_messages_are_matched_by_bits_and_places(spark):
    import itertools

    from proofgrid.operators import messages

    rng, rows = np.random.default_rng(2), []
    for k in range(40):
        make = lambda n: [(rng.integers(0, 2, 4).tolist(), (rng.random(5) < 0.4).tolist()) for _ in range(n)]
        rows.append((k, make(k % 5), make(k // 5 % 5)))
    rows += [(40, make(8), make(8)), (41, make(7), make(5)), (42, make(3), make(9))]
    kind = "array<struct<bits:array<int>,mask:array<boolean>>>"
    found = {r.k: r for r in messages.evaluate_messages(spark.createDataFrame(rows, f"k int, expected {kind}, predicted {kind}")).collect()}
    for k, expected, predicted in rows:
        n, m = len(expected), len(predicted)
        bit = [[np.mean([a == b for a, b in zip(x[0], p[0], strict=True)]) for p in predicted] for x in expected]
        iou = [[(np.sum(np.array(x[1]) & np.array(p[1])) / np.sum(np.array(x[1]) | np.array(p[1])) if np.sum(np.array(x[1]) | np.array(p[1])) else 1.0) for p in predicted] for x in expected]
        ways = [list(enumerate(c)) for c in itertools.permutations(range(m), n)] if n <= m else [[(e, p) for p, e in enumerate(c)] for c in itertools.permutations(range(n), m)]
        best = max(ways, key=lambda w: round(sum(bit[i][j] + 0.01 * iou[i][j] for i, j in w), 9)) if n and m else []
        r, exact = found[k], sum(bit[i][j] == 1 for i, j in best)
        assert (r.matched_count, r.exact_match_count, r.count_correct, r.all_messages_recovered) == (len(best), exact, n == m, n == m and exact == n)
        assert r.message_recall == pytest.approx(exact / n if n else 1.0) and r.message_precision == pytest.approx(exact / m if m else 0.0)
        assert r.mean_matched_bit_accuracy == pytest.approx(np.mean([bit[i][j] for i, j in best]) if best else 0.0)
        assert r.mean_matched_iou == pytest.approx(np.mean([iou[i][j] for i, j in best]) if best else 0.0)


def test_assignment_takes_the_first_of_equal_ones():
    import itertools

    from proofgrid.operators.messages import assignment

    r = np.random.default_rng(0)
    for turn in range(300):
        n, m = r.integers(1, 6, 2).tolist()
        scores = r.integers(0, 4, (n, m)) / 4.0 if turn % 2 else r.random((n, m))
        ways = [list(enumerate(c)) for c in itertools.permutations(range(m), n)] if n <= m else [[(e, p) for p, e in enumerate(c)] for c in itertools.permutations(range(n), m)]
        want = dict(max(ways, key=lambda w: round(sum(scores[i, j] for i, j in w), 9)))
        assert assignment(scores) == [want[i] + 1 if i in want else 0 for i in range(n)]
    assert assignment(np.zeros((3, 0))) == [0, 0, 0]


def test_null_sets_of_messages_are_empty(spark):
    from proofgrid.operators import messages

    kind = "array<struct<bits:array<int>,mask:array<boolean>>>"
    one = [([1, 0], [True, False])]
    found = messages.evaluate_messages(spark.createDataFrame([(0, None, one), (1, one, None), (2, None, None), (3, one, one)], f"k int, expected {kind}, predicted {kind}")).orderBy("k").collect()
    assert [(r.matched_count, r.message_recall, r.message_precision) for r in found] == [(0, 1.0, 0.0), (0, 0.0, 0.0), (0, 1.0, 0.0), (1, 1.0, 1.0)]


def test_configurations_keep_their_domains(spark):
    from proofgrid.operators import domains

    good = [("a", "budget", "max_candidates", 7.0), ("a", "budget", "minimum_search_fraction", 0.25), ("a", "budget", "reliable_fraction", 0.25), ("a", "adaptive", "minimum_psnr_db", 38.0), ("a", "adaptive", "target_psnr_db", 40.0),
            ("a", "geometry", "rotation_correction", -45.0), ("a", "geometry", "rotation_correction", 10.0), ("a", "messages", "maximum_messages", 4.0), ("a", "messages", "candidate_limit", 4.0), ("a", "other", "anything", -1.0)]
    bad = [("b", "budget", "max_candidates", 11.0), ("b", "budget", "reliable_agreement", 0.0), ("b", "budget", "stop_minimum_margin", math.inf), ("b", "adaptive", "minimum_strength", 8.0), ("b", "adaptive", "maximum_strength", 8.0),
           ("b", "geometry", "perspective_correction", 0.25), ("b", "messages", "assignment_temperature", math.nan), ("b", "messages", "seed_hamming_radius", None)]
    found = domains.violations(spark.createDataFrame(good + bad, "config string, kind string, name string, value double")).collect()
    assert {(r.config, r.rule) for r in found} == {("b", f"{n} is out of range") for n in ("max_candidates", "reliable_agreement", "stop_minimum_margin", "perspective_correction", "assignment_temperature", "seed_hamming_radius")} | {("b", "minimum_strength is not below maximum_strength")}


def test_numbers_within_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 2 else int(g), int(v)) for g, v in zip(rng.integers(0, 3, 400), rng.permutation(400), strict=True)]
    got = {(r.g, r.v): (r["_i"], r["_n"]) for r in ordering.numbered_within(spark.createDataFrame(rows, "g int, v int"), ["g"], ["v"]).collect()}
    members = {g: sorted(v for h, v in rows if h == g) for g in (0, 1, None)}
    assert got == {(g, v): (members[g].index(v), len(members[g])) for g, v in rows}


# --- searches under a budget


def search(spark, bounds=None, **changed):
    """The replay of one trace: like evidence everywhere, but for what changed says of a candidate (- and + and . as words)."""
    base = {"score": 0.7, "fraction": 0.9, "agreement": 0.98, "min_margin": 0.1, "recovered": 0}
    word = lambda name: name.replace("-", "m").replace("+", "p").replace(".", "_")
    rows = [(name, *(base | changed.get(word(name), {}) | changed.get("every", {})).values()) for name in policy.CANDIDATES]
    trace = spark.createDataFrame([(rows,)], "candidates array<struct<name string, score double, fraction double, agreement double, min_margin double, recovered int>>")
    names = [r.name for r in trace.select(policy.walk().alias("w")).first().w]
    return policy.replay(trace, policy.Policy(**(bounds or {}))).first(), names


def test_searches_stop_as_their_evidence_says(spark):
    found, _ = search(spark, every={"min_margin": 2.0})
    assert (found.visited, found.stop_reason, found.selected) == (1, "reliable_identity", "identity")
    found, _ = search(spark, every={"fraction": 0.001})
    assert (found.visited, found.stop_reason, found.detected) == (1, "insufficient_watermark_evidence", False)
    found, _ = search(spark, rotation_m6={"score": 0.99, "min_margin": 2.0})  # both signs are probed before the search stops
    assert (found.visited, found.stop_reason, found.selected) == (3, "reliable_correction", "rotation_-6")
    found, _ = search(spark, **{k: {"score": 0.99, "fraction": 0.1} for k in ("rotation_m6", "rotation_p6", "perspective_0_06")})
    assert found.selected == "identity"


@pytest.mark.parametrize("budget", [1, 3, 5, 7, 10])
def test_budgets_count_identity_and_probes(spark, budget):
    found, names = search(spark, {"max_candidates": budget})
    assert found.visited == budget and found.stop_reason == "candidate_budget_exhausted"
    assert len(set(names)) == 10 and names[:4] == ["identity", "rotation_-6", "rotation_+6", "perspective_0.06"]


def test_the_order_follows_the_best_correction_so_far(spark):
    # A negative rotation leads: its refinements, then the others in their own order.
    _, names = search(spark, rotation_m6={"score": 0.9})
    assert names[4:] == ["rotation_-10", "rotation_-3", "rotation_+10", "rotation_+3", "perspective_0.03", "perspective_0.1"]
    _, names = search(spark, rotation_p6={"score": 0.9})
    assert names[4:] == ["rotation_+10", "rotation_+3", "rotation_-10", "rotation_-3", "perspective_0.03", "perspective_0.1"]
    _, names = search(spark, perspective_0_06={"score": 0.9})
    assert names[4:] == ["perspective_0.03", "perspective_0.1", "rotation_-10", "rotation_+10", "rotation_-3", "rotation_+3"]
    # Equal scores: the first that was seen leads. A later, better one turns the search over.
    _, names = search(spark)
    assert names[4:6] == ["rotation_-10", "rotation_-3"]
    _, names = search(spark, perspective_0_06={"score": 0.8}, perspective_0_1={"score": 0.8}, rotation_m10={"score": 0.95}, rotation_p10={"score": 0.97})
    assert names[4:] == ["perspective_0.03", "perspective_0.1", "rotation_-10", "rotation_-3", "rotation_+10", "rotation_+3"]
    _, names = search(spark, rotation_m10={"score": 0.75}, rotation_m3={"score": 0.7}, rotation_p10={"score": 0.8}, perspective_0_03={"score": 0.9})
    assert names[4:] == ["rotation_-10", "rotation_-3", "rotation_+10", "rotation_+3", "perspective_0.03", "perspective_0.1"]
    _, names = search(spark, rotation_m6={"score": 0.8}, rotation_m10={"score": 0.85}, rotation_m3={"score": 0.6}, rotation_p10={"score": 0.99})
    assert names.index("rotation_+3") == names.index("rotation_+10") + 1


def test_policies_are_validated(spark):
    for bad in ({"max_candidates": 0}, {"max_candidates": 11}, {"max_candidates": 1.5}, {"identity_minimum_margin": math.inf}, {"stop_minimum_margin": -1.0}, {"reliable_agreement": 0.0}, {"minimum_search_fraction": 0.5}):
        with pytest.raises(ValueError):
            policy.as_struct(policy.Policy(**bad))


def test_grids_number_the_product_of_their_axes(spark):
    import itertools

    axes = {"max_candidates": [5, 7], "minimum_search_fraction": [0.01, 0.05, 0.1], "reliable_agreement": [0.9, 0.95]}
    rows = spark.range(12).select(policy.grid_policy(F.col("id"), axes).alias("p")).select("p.*").collect()
    assert [tuple(r[k] for k in axes) for r in rows] == list(itertools.product(*axes.values()))
    assert {r.stop_minimum_margin for r in rows} == {0.8}


def scores(spark, rows):
    return spark.createDataFrame([("g", label, float(s)) for label, s in rows], "g string, label int, detection_score double")


def test_auc_gives_ties_half(spark):
    assert detection.auc(scores(spark, [(0, 0), (0, 0.5), (1, 0.5), (1, 1)]), ["g"]).first().auc == 0.875
    r = np.random.default_rng(1)
    label, value = r.integers(0, 2, 300), r.integers(0, 20, 300)
    good, bad = value[label == 1], value[label == 0]
    want = ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean()
    assert detection.auc(scores(spark, zip(label.tolist(), value.tolist(), strict=True)), ["g"]).first().auc == pytest.approx(want, abs=1e-9)
    assert detection.auc(scores(spark, [(1, 3)]), ["g"]).first().auc is None


def test_thresholds_respect_ties(spark):
    found = detection.tie_safe_threshold(scores(spark, [(0, s) for s in (0.1, 0.2, 0.2, 0.4, 0.9)]), ["g"], 0.2).first()
    assert (found.threshold, found.strict) == (0.9, False)
    found = detection.tie_safe_threshold(scores(spark, [(0, 0.1)] * 3), ["g"], 0.01).first()
    assert (found.threshold, found.strict) == (0.1, True)


def test_wilson(spark):
    low, high = detection.wilson(F.col("h"), F.col("n"))
    rows = spark.createDataFrame([(4, 80), (0, 5), (5, 5), (0, 0)], "h int, n int").select(low.alias("l"), high.alias("u")).collect()
    assert (round(rows[0].l, 4), round(rows[0].u, 4)) == (0.0196, 0.1216)
    assert rows[1].l == 0 and rows[2].u == 1 and rows[3].l is None


def test_pairing_and_transitions(spark):
    models = {"wam": {("a", "clean"): 1, ("a", "rot"): 0, ("b", "clean"): 1, ("b", "rot"): 0}, "am": {("a", "clean"): 1, ("a", "rot"): 1, ("b", "clean"): 0, ("b", "rot"): 0}}
    facts = spark.createDataFrame([("x", m, i, a, v) for m, cells in models.items() for (i, a), v in cells.items()], "dataset string, model string, image_id string, attack string, complete_recovery int")
    pairs = pairing.paired(facts, "model", "wam", "am", ["dataset", "image_id", "attack"], ["complete_recovery"])
    found = pairs.agg(*pairing.transitions()).first()
    assert list(found)[:4] == [1, 1, 1, 1]
    with pytest.raises(Exception):  # noqa: B017  a cell without its partner is refused
        pairing.paired(facts.where("NOT (model = 'am' AND attack = 'rot')"), "model", "wam", "am", ["dataset", "image_id", "attack"], ["complete_recovery"]).collect()


def test_key_audits(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "i int, c string")
    one = audit.same_keys(keys, keys.unionByName(keys.limit(1)).where("i = 1"), ["i", "c"]).first()
    assert (one.missing_keys, one.unexpected_keys, one.duplicated_keys, one.complete) == (2, 0, 1, False)
    assert audit.same_keys(keys, keys, ["i", "c"]).first().complete
    values = keys.withColumn("v", F.lit(1.0))
    assert audit.agree(values, values.withColumn("v", F.col("v") + 1e-13), ["i", "c"], ["v"]).isEmpty()
    assert audit.agree(values, values.where("i = 1"), ["i", "c"], ["v"]).count() == 2


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_bits_and_hashes(spark):
    digest = hashlib.sha256(b"42:ds:img").digest()
    seed, message, kept, five = one(spark, bits.stable_seed(F.lit(42), F.lit("ds"), F.lit("img")), bits.hash_bits(F.lit("42:ds:img")), bits.message_bits(F.lit("01" * 16)), bits.to_bits(F.lit(5), 8))
    assert int(seed) == int.from_bytes(digest[:8], "big") and message == f"{int.from_bytes(digest[:4], 'big'):032b}"
    assert kept == "01" * 16 and five == "00000101"
    assert one(spark, *bits.bit_metrics(F.lit(0b0101), F.lit(0b0111), 4)) == [0.75, 0.25, 0]
    parts = {"b": F.lit("2"), "a": F.lit("1")}
    assert one(spark, bits.fingerprint(parts)) == [hashlib.sha256(json.dumps({"a": "1", "b": "2"}, separators=(",", ":")).encode()).hexdigest()]


def test_scalars(spark):
    text = F.lit
    assert one(spark, scalars.flag(text(" True ")), scalars.flag(text("no")), scalars.flag(F.lit(None)), scalars.number(text(" ")), scalars.number(text("x")), scalars.number(text("1.5"))) == [True, False, False, None, None, 1.5]
    with pytest.raises(Exception, match="not a flag"):
        one(spark, scalars.flag(text("maybe"), ("true",), ("false",)))
    assert one(spark, scalars.ratio(F.lit(1.0), F.lit(0.0)), scalars.ratio(F.lit(1.0), F.lit(4.0)), scalars.clip(F.lit(7.0), 0.0, 1.0), scalars.sigmoid(F.lit(0.0))) == [0.0, 0.25, 1.0, 0.5]
    assert sum(one(spark, scalars.softmax(F.array(F.lit(1.0), F.lit(2.0)), 0.15))[0]) == pytest.approx(1)
    assert one(spark, scalars.psnr(F.lit(0.0)), scalars.psnr(F.lit(1.0))) == [math.inf, pytest.approx(48.1308, abs=1e-4)]
    assert one(spark, scalars.branch_score(*[F.lit(1.0)] * 4))[0] == pytest.approx(0.6 + 0.3 * math.tanh(0.5) + 0.1)
    assert one(spark, scalars.two_digits(F.lit(1234.565)), scalars.two_digits(F.lit(0.5), True), scalars.finite_text(F.lit(float("-inf")))) == ["1234.57", "+0.50", "-inf"]
    assert one(spark, *[scalars.inside(text(p)) for p in ("a/b.png", "../x", "/x", "a/../../x", "C:\\x", "a..b")]) == [True, False, False, False, False, True]
    assert one(spark, scalars.safe_id(text("REC-2611-0A")), scalars.safe_id(text("short")), scalars.safe_id(F.lit(None))) == [True, False, False]
    assert list(one(spark, scalars.mask_box(F.lit(100), F.lit(50), 0.08))[0]) == [40, 15, 60, 35]


def test_marks_survive_what_keeps_low_bits(spark, small):
    rows = registry.queries()["lsb_roundtrip"](spark, small).collect()
    assert rows and all(r.message == r.found and r.detected and r.psnr_db > 40 for r in rows)
    by = {r.attack: r for r in registry.queries()["attack_contract"](spark, small).collect()}
    assert by["identity"].mean_squared_difference == 0 and by["identity"].recovered == by["identity"].images == len(rows)
    assert by["pixelate"].recovered < len(rows)
