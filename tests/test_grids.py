"""Grids as arrays in rows: linear systems, maps between grids, stencils and masks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.functions import grids


def test_systems_are_solved(spark):
    r = np.random.default_rng(1)
    systems = [np.c_[a, b] for a, b in ((r.normal(size=(n, n)), r.normal(size=n)) for n in (1, 2, 5, 8, 8, 8))]
    systems.append(np.array([[0.0, 1, 2], [1, 0, 3]]))  # needs a swap
    systems.append(np.array([[1.0, 2, 3], [2, 4, 6]]))  # singular
    rows = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(systems)], "k int, s array<array<double>>").select("k", F.expr(grids.solve("s")).alias("x"))
    found = {r.k: r.x for r in rows.collect()}
    for k, s in enumerate(systems[:-1]):
        assert found[k] == pytest.approx(np.linalg.solve(s[:, :-1], s[:, -1]), rel=1e-8)
    assert None in found[len(systems) - 1]


def corner_map(width: int, height: int, share: float) -> np.ndarray:
    """The map from the whole canvas to the four corners of a tilted one."""
    x, y = width - 1.0, height - 1.0
    rows, right = [], []
    for (a, b), (u, v) in zip([(0, 0), (x, 0), (x, y), (0, y)], [(x * share, y * share), (x - x * share, 0), (x, y - y * share), (0, y)], strict=True):
        rows += [[a, b, 1, 0, 0, 0, -u * a, -u * b], [0, 0, 0, a, b, 1, -v * a, -v * b]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)


@pytest.mark.parametrize("shape", [(120, 240), (40, 40), (30, 60)])
def test_a_landmark_returns_to_its_place(spark, shape):
    """A spot of a corrected branch, moved back: turned about the centre, or through the corners of a tilt."""
    rows, want = [], {}
    for (width, height), share in (((240, 120), 0.15), ((120, 240), 0.06)):
        m = corner_map(width, height, share)
        spot = np.array([0.6 * width, 0.4 * height])
        there = m @ [*spot, 1]
        rows.append((f"perspective_{share}", width, height, spot))
        want[f"perspective_{share}"] = there[:2] / there[2]
    for degrees in (-30, 30):
        a, spot, centre = np.deg2rad(degrees), np.array([170.0, 45.0]), np.array([120.0, 60.0])
        rows.append((f"rotation_{degrees:+d}", 240, 120, spot))
        want[f"rotation_{degrees:+d}"] = centre + np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) @ (spot - centre)
    h, w = shape
    given = []
    for branch, width, height, (sx, sy) in rows:
        y, x = np.indices(shape, dtype=float)
        cells = np.exp(-(((x + 0.5) * width / w - sx) ** 2 + ((y + 0.5) * height / h - sy) ** 2) / 80)
        given.append((branch, width, height, w, cells.ravel().tolist()))
    frame = spark.createDataFrame(given, "branch string, image_width int, image_height int, width int, cells array<double>")
    for r in grids.in_input_coordinates(frame).collect():
        cells = np.array(r.located).reshape(shape)
        y, x = np.indices(shape, dtype=float)
        centre = (((x + 0.5) * r.image_width / w * cells).sum() / cells.sum(), ((y + 0.5) * r.image_height / h * cells).sum() / cells.sum())
        assert centre == pytest.approx(want[r.branch], abs=0.8), r.branch
        assert cells.min() >= 0 and cells.max() <= 1


def test_maps_invent_nothing_and_keep_identity(spark):
    r = np.random.default_rng(2).random((24, 32))
    rows = [("identity", 320, 180, 32, r.ravel().tolist()), ("rotation_30", 240, 120, 40, [1.0] * 1600)]
    found = {x.branch: x.located for x in grids.in_input_coordinates(spark.createDataFrame(rows, "branch string, image_width int, image_height int, width int, cells array<double>")).collect()}
    assert found["identity"] == r.ravel().tolist()
    turned = np.array(found["rotation_30"]).reshape(40, 40)
    assert turned[0, 0] == turned[-1, -1] == 0 and turned[20, 20] == 1
    with pytest.raises(Exception, match="unknown branch"):
        grids.in_input_coordinates(spark.createDataFrame([("shear_1", 2, 2, 2, [0.0] * 4)], "branch string, image_width int, image_height int, width int, cells array<double>")).collect()


def test_stencils_and_masks_equal_numpy(spark):
    r = np.random.default_rng(3)
    pictures = {0: r.random((20, 24)), 1: np.full((12, 16), 0.25), 2: np.tile(np.linspace(0, 1, 30), (10, 1)), 3: r.random((2, 2)), 4: np.zeros((1, 1))}
    pictures[5] = pictures[0].copy()
    pictures[5][:3, :4] = pictures[5][-3:, -4:] = 0.5
    masks = {k: r.random(p.shape) < 0.3 for k, p in pictures.items()}
    rows = [(k, p.shape[1], p.ravel().tolist(), (p * 255).ravel().tolist(), masks[k].ravel().tolist()) for k, p in pictures.items()]
    frame = spark.createDataFrame(rows, "k int, width int, cells array<double>, levels array<double>, mask array<boolean>")
    columns = grids.content_features("cells", "width") | grids.spatial_metrics("cells", "width", 0.4, "mask") | {"evidence": grids.border_evidence("levels", "width")}
    for x in frame.select("k", *[c.alias(n) for n, c in columns.items()]).collect():
        p, mask = pictures[x.k], masks[x.k]
        h, w = p.shape
        if min(h, w) > 1:
            assert x.gradient_energy == pytest.approx(0.5 * (np.abs(np.diff(p, axis=1)).mean() + np.abs(np.diff(p, axis=0)).mean()))
        inner = p[1:-1, 1:-1]
        laplacian = -4 * inner + p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] if inner.size else np.zeros(1)
        share = np.histogram(p, bins=32, range=(0, 1))[0] / p.size
        assert (x.deviation, x.laplacian_variance) == pytest.approx((p.std(), laplacian.var()), abs=1e-12)
        assert x.entropy == pytest.approx(-(share[share > 0] * np.log2(share[share > 0])).sum() / 5, abs=1e-12)
        binary, total = p > 0.4, p.sum()
        centroid = [(p * np.linspace(0, 1, w)[None]).sum() / total, (p * np.linspace(0, 1, h)[:, None]).sum() / total] if total else [0, 0]
        assert (x.centroid_x, x.centroid_y) == pytest.approx(centroid if h > 1 else [centroid[0], 0])
        width = max(1, round(min(h, w) * 0.1))
        border = np.ones(p.shape, bool)
        border[width:-width, width:-width] = False
        assert x.border_probability == pytest.approx(p[border].mean()) and x.centre_probability == (pytest.approx(p[~border].mean()) if (~border).any() else None)
        tp, fp, fn = (binary & ~mask).sum(), (binary & mask).sum(), (~binary & ~mask).sum()
        assert x.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0) and x.recall == pytest.approx(tp / (tp + fn) if tp + fn else 0)
        assert x.overlap == pytest.approx(tp / (tp + fp + fn) if tp + fp + fn else 0)
        levels = p * 255
        near = np.abs(levels - np.median(levels)) <= 12
        ch, cw = max(1, round(h * 0.15)), max(1, round(w * 0.15))
        corners, centre = np.zeros(p.shape, bool), np.zeros(p.shape, bool)
        for ys in (slice(0, ch), slice(-ch, None)):
            for xs in (slice(0, cw), slice(-cw, None)):
                corners[ys, xs] = True
        centre[h // 4 : max(h // 4 + 1, h - h // 4), w // 4 : max(w // 4 + 1, w - w // 4)] = True
        assert x.evidence == pytest.approx(max(0.0, near[corners].mean() - near[centre].mean()))


def test_perturbations_and_marks_equal_numpy(spark):
    r = np.random.default_rng(4)
    pictures = {k: r.integers(0, 256, (12, 16)).astype(float) for k in range(4)}
    messages = {k: "".join(map(str, r.integers(0, 2, 16))) for k in pictures}
    frame = spark.createDataFrame([(k, 16, p.ravel().tolist(), messages[k]) for k, p in pictures.items()], "k int, width int, cells array<double>, message string")
    whole = lambda x: np.round(np.clip(x, 0, 255))
    blocks = lambda p, n: np.kron(p.reshape(12 // n, n, 16 // n, n).mean((1, 3)), np.ones((n, n)))
    want = {
        ("identity", 0.0): lambda p: p, ("brightness", 1.5): lambda p: whole(p * 1.5), ("contrast", 0.6): lambda p: whole(np.round(p.mean()) + (p - np.round(p.mean())) * 0.6), ("gamma", 2.0): lambda p: whole(255 * (p / 255) ** 2.0),
        ("horizontal_flip", 0.0): lambda p: p[:, ::-1], ("pixelate", 0.25): lambda p: whole(blocks(p, 4)),
    }
    columns = [F.expr(grids.perturbed("cells", "width", *key)).alias(key[0]) for key in want]
    for x in frame.select("k", *columns).collect():
        for (name, _), f in want.items():
            assert np.array(x[name]).reshape(12, 16) == pytest.approx(f(pictures[x.k])), name
    with pytest.raises(ValueError):
        grids.perturbed("cells", "width", "blur", 1.0)
    seen = frame.withColumn("marked", F.expr(grids.marked("cells", "message")))
    for x in seen.select("k", "message", "marked", grids.squared_difference("cells", "marked").alias("mse"), *[c.alias(f"found_{n}") for n, c in grids.read_mark("marked", 16).items()]).collect():
        assert (x.found_message, x.found_sync, x.found_detected) == (x.message, 1.0, True)
        assert x.mse == pytest.approx(np.mean((pictures[x.k].ravel() - np.array(x.marked)) ** 2)) and x.mse <= 1
    assert [r[0] for r in frame.select(grids.read_mark("cells", 16)["detected"]).collect()] == [False] * 4


def test_pixelated_edges_and_marks_are_one_walk(spark, small):
    """Blocks of five over 12 x 16 are cut at two sides; each sample is looked up, not sought among all others."""
    from proofgrid.plans import registry

    p = np.random.default_rng(6).integers(0, 256, (12, 16)).astype(float)
    frame = spark.createDataFrame([(16, p.ravel().tolist())], "width int, cells array<double>")
    found = np.array(frame.select(F.expr(grids.perturbed("cells", "width", "pixelate", 0.2))).first()[0]).reshape(12, 16)
    for y in range(0, 12, 5):
        for x in range(0, 16, 5):
            assert (found[y : y + 5, x : x + 5] == np.round(p[y : y + 5, x : x + 5].mean())).all()
    assert "filter(" not in grids.perturbed("cells", "width", "pixelate", 0.2)
    assert frame.select(F.expr("slice(cells, 1, 20)").alias("cells")).select(grids.read_mark("cells", 16)["message"]).first()[0][4:] == "0" * 12  # no votes there
    plan = registry.queries()["attack_contract"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
