"""Grids of samples as arrays in rows: linear systems, maps between grids, stencils and masks, all as column expressions.

A grid is a flat array, row by row, with its width. Everything is a SQL expression over such columns, so a table of
grids is worked on in place, without a shuffle and inside the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: str, name: str, body: str) -> str:
    """body with a name for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def solve(rows: str) -> str:
    """The solution of a linear system, array<array<double>> with the right side as last column, by elimination with
    the largest pivot; null for a singular one."""
    pivot = "array_max(transform(filter(sequence(0, size(s) - 1), i -> i >= k), i -> named_struct('m', abs(s[i][k]), 'i', i))).i"
    cleared = "transform(s, (r, i) -> CASE WHEN i = k THEN q WHEN i = p THEN zip_with(s[k], q, (x, y) -> x - s[k][k] * y) ELSE zip_with(r, q, (x, y) -> x - r[k] * y) END)"
    step = _let(pivot, "p", _let("transform(s[p], x -> try_divide(x, s[p][k]))", "q", cleared))
    return f"aggregate(sequence(0, size({rows}) - 1), {rows}, (s, k) -> {step}, s -> transform(s, r -> element_at(r, -1)))"


def homography(source: str, target: str) -> str:
    """The nine numbers, the last one 1, of the map that takes four points (array<array<double>>) to four others."""
    rows = (
        f"flatten(zip_with({source}, {target}, (a, b) -> array(array(a[0], a[1], 1D, 0D, 0D, 0D, -b[0] * a[0], -b[0] * a[1], b[0]), "
        "array(0D, 0D, 0D, a[0], a[1], 1D, -b[1] * a[0], -b[1] * a[1], b[1]))))"
    )
    return _let(rows, "system", f"concat({solve('system')}, array(1D))")


def inverse(m: str) -> str:
    """The inverse of nine numbers as a 3 x 3 matrix, scaled so that the last is 1."""
    minor = lambda a, b, c, d: f"({m}[{a}] * {m}[{d}] - {m}[{b}] * {m}[{c}])"
    adjoint = [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]
    return f"transform(array({', '.join(adjoint)}), x -> try_divide(x, {minor(0, 1, 3, 4)}))"


def branch_matrix(branch: str, width: str, height: str) -> str:
    """Where a pixel of the input lies in a corrected branch: rotation_<degrees> or perspective_<share>."""
    amount = f"double(regexp_extract({branch}, '^[a-z]+_(.+)$', 1))"
    turned = _let(
        f"named_struct('c', cos(radians({amount})), 's', sin(radians({amount})), 'x', {width} / 2D, 'y', {height} / 2D)", "t",
        "array(t.c, t.s, t.x - t.c * t.x - t.s * t.y, -t.s, t.c, t.y + t.s * t.x - t.c * t.y, 0D, 0D, 1D)",
    )
    corners = "array(array(0D, 0D), array(t.x, 0D), array(t.x, t.y), array(0D, t.y))"
    moved = "array(array(t.x * t.a, t.y * t.a), array(t.x - t.x * t.a, 0D), array(t.x, t.y - t.y * t.a), array(0D, t.y))"
    tilted = _let(f"named_struct('x', double({width} - 1), 'y', double({height} - 1), 'a', {amount})", "t", _let(homography(corners, moved), "h", inverse("h")))
    return f"CASE WHEN startswith({branch}, 'rotation_') THEN {turned} WHEN startswith({branch}, 'perspective_') THEN {tilted} ELSE raise_error(concat('unknown branch ', {branch})) END"


def in_input_coordinates(grids: DataFrame, name: str = "located") -> DataFrame:
    """grids(branch, image_width, image_height, width, cells) with cells moved back to where they lie in the input.

    The map is made in image coordinates and scaled to the grid, which may be stretched. Cells are sampled between their
    four neighbours; what lies outside of the branch's canvas is 0. The branch identity keeps its cells as they are.
    """
    height = "int(size(cells) / width)"
    scaled = _let(
        f"named_struct('x', image_width / double(width), 'y', image_height / double({height}))", "g",
        _let("transform(_matrix, (m, i) -> m * element_at(array(g.x, g.y, 1D), i % 3 + 1) / element_at(array(g.x, g.y, 1D), int(floor(i / 3)) + 1))", "m", "transform(m, x -> x / m[8])"),
    )
    place = "named_struct('x', i % width + 0.5D, 'y', floor(i / width) + 0.5D)"
    source = "transform(array(_map[6] * p.x + _map[7] * p.y + 1D), d -> named_struct('x', (_map[0] * p.x + _map[1] * p.y + _map[2]) / d, 'y', (_map[3] * p.x + _map[4] * p.y + _map[5]) / d))[0]"
    corner = "named_struct('x', floor(s.x - 0.5D), 'y', floor(s.y - 0.5D), 'u', s.x - 0.5D - floor(s.x - 0.5D), 'v', s.y - 0.5D - floor(s.y - 0.5D))"
    cell = lambda dx, dy: f"cells[int(greatest(0, least({height} - 1, q.y + {dy})) * width + greatest(0, least(width - 1, q.x + {dx})))]"
    mixed = f"(1 - q.v) * ((1 - q.u) * {cell(0, 0)} + q.u * {cell(1, 0)}) + q.v * ((1 - q.u) * {cell(0, 1)} + q.u * {cell(1, 1)})"
    seen = f"CASE WHEN s.x < 0 OR s.x >= width OR s.y < 0 OR s.y >= {height} THEN 0D ELSE greatest(0D, least(1D, {_let(corner, 'q', mixed)})) END"
    moved = "transform(sequence(0, size(cells) - 1), i -> " + _let(place, "p", _let(source, "s", seen)) + ")"
    identity = F.col("branch") == "identity"
    mapped = grids.withColumn("_matrix", F.when(~identity, F.expr(branch_matrix("branch", "image_width", "image_height")))).withColumn("_map", F.when(~identity, F.expr(scaled)))
    return mapped.withColumn(name, F.when(identity, F.col("cells")).otherwise(F.expr(moved))).drop("_matrix", "_map")


def _mean(values: str) -> str:
    return _let(values, "w", "IF(size(w) = 0, NULL, aggregate(w, 0D, (t, x) -> t + x) / size(w))")


def _variance(values: str) -> str:
    return _let(values, "a", f"coalesce({_let(_mean('a'), 'c', _mean('transform(a, x -> (x - c) * (x - c))'))}, 0D)")


def content_features(cells: str, width: str, bins: int = 32) -> dict[str, Column]:
    """Deviation, gradient energy, variance of the Laplacian, and entropy of a histogram of samples from 0 to 1."""
    across = f"transform(filter(sequence(0, size({cells}) - 1), i -> i % {width} < {width} - 1), i -> abs({cells}[i + 1] - {cells}[i]))"
    down = f"zip_with(slice({cells}, 1, size({cells}) - {width}), slice({cells}, {width} + 1, size({cells})), (a, b) -> abs(b - a))"
    inner = f"filter(sequence(0, size({cells}) - 1), i -> i % {width} BETWEEN 1 AND {width} - 2 AND i >= {width} AND i < size({cells}) - {width})"
    laplacian = f"transform({inner}, i -> {cells}[i - 1] + {cells}[i + 1] + {cells}[i - {width}] + {cells}[i + {width}] - 4 * {cells}[i])"
    counted = f"transform(sequence(0, {bins - 1}), b -> size(filter({cells}, x -> x BETWEEN 0 AND 1 AND least(floor(x * {bins}), {bins - 1}) = b)))"
    entropy = f"-aggregate({counted}, 0D, (t, n) -> t + IF(n = 0, 0D, n / double(size({cells})) * log2(n / double(size({cells})))))"
    return {
        "deviation": F.expr(f"sqrt({_variance(cells)})"), "gradient_energy": F.expr(f"0.5D * ({_mean(across)} + {_mean(down)})"),
        "laplacian_variance": F.expr(_variance(laplacian)), "entropy": F.expr(f"{entropy} / log2({bins}D)"),
    }


def border_evidence(cells: str, width: str, share: float = 0.15, tolerance: float = 12.0) -> Column:
    """How much more often samples near the median lie in the corners than in the middle; 0 if not more often."""
    height = f"int(size({cells}) / {width})"
    middle = _let(f"array_sort({cells})", "o", "(o[int((size(o) - 1) / 2)] + o[int(size(o) / 2)]) / 2D")
    side = lambda n: f"int(greatest(1, bround({n} * {share}D)))"
    corner = f"(i % {width} < {side(width)} OR i % {width} >= {width} - {side(width)}) AND (floor(i / {width}) < {side(height)} OR floor(i / {width}) >= {height} - {side(height)})"
    inside = lambda at, n: f"{at} >= floor({n} / 4) AND {at} < greatest(floor({n} / 4) + 1, {n} - floor({n} / 4))"
    centre = f"{inside(f'i % {width}', width)} AND {inside(f'floor(i / {width})', height)}"
    rate = lambda where: _mean(f"transform(filter(sequence(0, size({cells}) - 1), i -> {where}), i -> IF(abs({cells}[i] - m) <= {tolerance}D, 1D, 0D))")
    return F.expr(_let(middle, "m", f"greatest(0D, {rate(corner)} - {rate(centre)})"))


def spatial_metrics(cells: str, width: str, threshold: float, mask: str | None = None) -> dict[str, Column]:
    """Where a detector sees something: fraction, means, centroid (0 to 1), border and centre; with a mask of what was
    changed (array<boolean>), precision, recall, F1 and overlap of what is detected outside of it."""
    height = f"int(size({cells}) / {width})"
    border = f"int(greatest(1, bround(least({width}, {height}) * 0.1D)))"
    middle = f"(i % {width} >= {border} AND i % {width} < {width} - {border} AND floor(i / {width}) >= {border} AND floor(i / {width}) < {height} - {border})"
    of = lambda where: _mean(f"transform(filter(sequence(0, size({cells}) - 1), i -> {where}), i -> {cells}[i])")
    weighed = lambda axis: f"coalesce(try_divide(aggregate(transform({cells}, (x, i) -> greatest(x, 0D) * ({axis})), 0D, (t, x) -> t + x), aggregate({cells}, 0D, (t, x) -> t + greatest(x, 0D))), 0D)"
    along = lambda at, n: f"IF({n} > 1, {at} / double({n} - 1), 0D)"
    out = {
        "detected_fraction": _mean(f"transform({cells}, x -> IF(x > {threshold}D, 1D, 0D))"), "mean_probability": _mean(cells), "highest_probability": f"array_max({cells})",
        "centroid_x": weighed(along(f"(i % {width})", width)), "centroid_y": weighed(along(f"floor(i / {width})", height)), "border_probability": of(f"NOT {middle}"), "centre_probability": of(middle),
    }
    if mask:
        count = lambda where: f"size(filter(sequence(0, size({cells}) - 1), i -> {where}))"
        found = f"{cells}[i] > {threshold}D"
        hits, wrong, missed = count(f"{found} AND NOT {mask}[i]"), count(f"{found} AND {mask}[i]"), count(f"NOT ({found}) AND NOT {mask}[i]")
        ratio = lambda a, b: f"coalesce(try_divide(double({a}), double({b})), 0D)"
        out |= {
            "inside_probability": of(f"{mask}[i]"), "outside_probability": of(f"NOT {mask}[i]"), "precision": ratio(hits, f"{hits} + {wrong}"), "recall": ratio(hits, f"{hits} + {missed}"),
            "f1": ratio(f"2 * {hits}", f"2 * {hits} + {wrong} + {missed}"), "overlap": ratio(hits, f"{hits} + {wrong} + {missed}"),
        }
    return {k: F.expr(v) for k, v in out.items()}


#: The synchronisation word before a message.
SYNC = "1010010101011010"


def perturbed(cells: str, width: str, name: str, amount: float) -> str:
    """A grid of samples from 0 to 255 after a perturbation; samples are rounded half to even and cut at both ends."""
    whole = lambda values: f"transform({values}, x -> double(bround(greatest(0D, least(255D, x)))))"
    if name == "identity":
        return cells
    if name == "brightness":
        return whole(f"transform({cells}, x -> x * {amount}D)")
    if name == "contrast":
        return whole(_let(f"bround({_mean(cells)})", "m", f"transform({cells}, x -> m + (x - m) * {amount}D)"))
    if name == "gamma":
        return whole(f"transform({cells}, x -> 255D * pow(x / 255D, {amount}D))")
    if name == "horizontal_flip":
        return f"transform(sequence(0, size({cells}) - 1), i -> {cells}[i - i % {width} + {width} - 1 - i % {width}])"
    if name == "pixelate":
        step = max(1, round(1 / amount))
        across, down = f"int(ceil({width} / {step}D))", f"int(ceil(size({cells}) / {width} / {step}D))"
        # A block's samples are slices of its rows; its mean is made once and looked up by each of them.
        x, y = f"b % {across} * {step}", f"b div {across} * {step}"
        block = f"flatten(transform(sequence(0, {step - 1}), r -> slice({cells}, int(({y} + r) * {width} + {x} + 1), int(least({step}, {width} - {x})))))"
        means = f"transform(sequence(0, {across} * {down} - 1), b -> {_mean(block)})"
        return whole(_let(means, "m", f"transform(sequence(0, size({cells}) - 1), i -> m[int(i div {width} div {step} * {across} + i % {width} div {step})])"))
    raise ValueError(f"unknown perturbation {name}")


def marked(cells: str, message: str) -> str:
    """Samples with SYNC and a message (a text of 0 and 1) in their least significant bits, over and over."""
    bits = f"concat('{SYNC}', {message})"
    return _let(bits, "b", f"transform({cells}, (x, i) -> x - x % 2 + int(substr(b, 1 + i % length(b), 1)))")


def read_mark(cells: str, bits: int) -> dict[str, Column]:
    """The message of so many bits by majority of its repetitions, the share of right synchronisation bits, and whether
    it is 0.875 or more. A bit with as many votes for either is 0."""
    total = len(SYNC) + bits
    # A bit's votes are looked up where they are, so a grid is walked once for all bits; a null sample has no vote.
    vote = f"aggregate(sequence(b, size({cells}) - 1, {total}), 0D, (s, i) -> s + coalesce({cells}[i] % 2 * 2 - 1, 0D))"
    votes = f"transform(sequence(0, {total - 1}), b -> IF(b < size({cells}), {vote}, 0D))"
    read = f"array_join(transform({votes}, v -> IF(v > 0, '1', '0')), '')"
    right = f"aggregate(sequence(1, {len(SYNC)}), 0, (n, i) -> n + int(substr(r, i, 1) = substr('{SYNC}', i, 1))) / {float(len(SYNC))}D"
    return {"message": F.expr(f"substr({read}, {len(SYNC) + 1})"), "sync": F.expr(_let(read, "r", right)), "detected": F.expr(_let(read, "r", f"{right} >= 0.875D"))}


def squared_difference(a: str, b: str) -> Column:
    """Mean squared difference of two grids; null if their sizes differ."""
    return F.expr(f"IF(size({a}) = size({b}), {_mean(f'zip_with({a}, {b}, (x, y) -> (x - y) * (x - y))')}, NULL)")
