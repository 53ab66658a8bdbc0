"""Signatures, density clusters and soft messages against plain versions."""

import itertools
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from proofgrid.operators import signatures

SETTINGS = replace(signatures.SoftSettings(), minimum_cluster_pixels=12, minimum_cluster_fraction=0.03, localization_threshold=0.2, density_schedule=(40, 90, 200))


def apart(a: int, b: int) -> int:
    return (a ^ b).bit_count()


def test_least_and_mean_distance_equal_all_pairs(spark):
    r = random.Random(1)
    words = [(g, r.getrandbits(32)) for g in range(3) for _ in range(40 * (1 + g))] + [(9, 5), (9, 5), (9, 1), (8, 77), (7, 0), (7, 3), (6, 0), (6, 1), (5, 0), (5, 15), (4, 0), (4, 7)]
    frame = spark.createDataFrame(words, "g int, word long")
    groups = defaultdict(list)
    for g, w in words:
        groups[g].append(w)
    pairs = {g: [apart(a, b) for a, b in itertools.combinations(ws, 2)] for g, ws in groups.items()}
    assert {x.g: x.least for x in signatures.least_distances(frame, ["g"]).collect()} == {g: min(p, default=None) for g, p in pairs.items()}
    for x in signatures.mean_distances(frame, ["g"]).collect():
        assert x.n_pairs == len(pairs[x.g]) and x.mean == (pytest.approx(np.mean(pairs[x.g])) if pairs[x.g] else None)


def plain_density(weights: dict[int, int], least: int, radius: int = 1) -> dict[int, tuple[bool, int]]:
    """word -> core, cluster by comparing all pairs; clusters are named by their least word."""
    near = {a: [b for b in weights if apart(a, b) <= radius] for a in weights}
    core = {a for a in weights if sum(weights[b] for b in near[a]) >= least}
    name = {a: a for a in core}
    while True:
        lower = {a: min(name[b] for b in near[a] if b in core) for a in core}
        if lower == name:
            break
        name = lower
    out = {a: (True, name[a]) for a in core}
    for a in weights:
        touched = [name[b] for b in near[a] if b in core]
        if a not in core and touched:
            out[a] = (False, min(touched))
    return out


@pytest.mark.parametrize("radius", [1, 2])
def test_density_clusters_equal_all_pairs(spark, radius):
    r = random.Random(radius)
    words = {g: {r.getrandbits(8): r.randint(1, 5) for _ in range(50)} for g in ("a", "b")}
    frame = spark.createDataFrame([(g, w, n) for g, ws in words.items() for w, n in ws.items()], "g string, word long, weight long")
    levels = [1, 6, 12, 1000]
    found = {(x.g, x.level, x.word): (x.core, x.cluster) for x in signatures.density_clusters(frame, ["g"], levels, 8, radius).collect()}
    want = {(g, level, w): v for g, ws in words.items() for level in levels for w, v in plain_density(ws, level, radius).items()}
    assert found == want and any(not core for core, _ in found.values())


def plain_messages(pixels: list, width: int, s: signatures.SoftSettings):
    """Messages (bits, support, fraction, confidence, fallback) and labels of one image."""
    seen = [(place, d, np.array(logits)) for place, d, logits in pixels if d > s.detection_threshold]
    if not seen:
        return [], {}
    p = 1 / (1 + np.exp(-np.clip((np.stack([x[2] for x in seen]) - s.bit_logit_threshold) / s.bit_probability_temperature, -30, 30)))
    d = np.array([x[1] for x in seen])
    words = [int("".join(map(str, row)), 2) for row in (p >= 0.5).astype(int)]
    least = max(float(s.minimum_cluster_pixels), s.minimum_cluster_fraction * len(seen))
    weights = dict(sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[: s.candidate_limit])
    bits = lambda w: np.array([int(c) for c in format(w, f"0{width}b")])
    solutions = []
    for level in sorted({max(1, int(np.ceil(least))), *s.density_schedule}):
        if level > len(seen):
            continue
        found = plain_density(weights, level)
        clusters = []
        for name in sorted({c for _, c in found.values()}):
            members = [w for w in found if found[w][1] == name]
            support = sum(weights[w] for w in members)
            centroid = sum(weights[w] * bits(w) for w in members) / support
            agreement = sum(weights[w] * (bits(w) == (centroid >= 0.5)).mean() for w in members) / support
            clusters.append((support, name, centroid, agreement))
        clusters = sorted(clusters, key=lambda c: (-c[0], c[1]))[: s.maximum_messages]
        if not clusters:
            continue
        messages = [c[2] >= 0.5 for c in clusters]
        separation = min((int((a != b).sum()) for a, b in itertools.combinations(messages, 2)), default=width)
        agreement = np.mean([c[3] for c in clusters])
        if separation >= s.minimum_message_hamming_separation and agreement >= s.minimum_agreement:
            solutions.append(((len(clusters), round(agreement, 12), sum(c[0] for c in clusters) / len(seen), -level), clusters, found))
    if solutions:
        _, clusters, found = max(solutions, key=lambda x: x[0])
        seeds, priors, names = [c[2] for c in clusters], [c[0] for c in clusters], [c[1] for c in clusters]
    else:
        found, names = {}, []
        support = {a: sum(n for b, n in weights.items() if apart(a, b) <= s.seed_hamming_radius) for a in weights}
        taken = []
        for w in sorted(weights, key=lambda w: (-support[w], w)):
            if len(taken) < s.maximum_messages and (support[w] >= least or not taken) and all(apart(w, t) >= s.minimum_message_hamming_separation for t in taken):
                taken.append(w)
        seeds, priors = [bits(w).astype(float) for w in taken], [support[w] for w in taken]
    seeds, priors = np.stack(seeds), np.array(priors, float)
    centroids, strength = seeds.copy(), priors * s.seed_prior_strength
    for _ in range(s.refinement_iterations):
        sure = np.maximum(np.abs(2 * p - 1), 0.05)
        distance = (sure[:, None] * np.abs(p[:, None] - centroids)).sum(2) / np.maximum(sure.sum(1), 1e-8)[:, None]
        share = np.exp((distance.min(1, keepdims=True) - distance) / s.assignment_temperature)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
        share[distance.min(1) > s.maximum_soft_hamming] = 0
        weighted = share * d[:, None]
        support = weighted.sum(0)
        updated = (weighted.T @ p + strength[:, None] * seeds) / np.maximum(support + strength, 1e-8)[:, None]
        centroids = np.where((support > 1e-8)[:, None], updated, centroids)
    retain = (support >= least) | (priors >= least)
    if not retain.any():
        retain[int(np.argmax(support))] = True
    at = np.flatnonzero(retain)
    messages = [centroids[k] >= 0.5 for k in at]
    fallback = min((int((a != b).sum()) for a, b in itertools.combinations(messages, 2)), default=width) < s.minimum_message_hamming_separation
    share = share[:, at]
    if fallback:
        messages = [seeds[k] >= 0.5 for k in at]
        if names:
            share = np.array([[float(found.get(w, (0, None))[1] == names[k]) for k in at] for w in words])
    values = share * d[:, None]
    order = sorted(range(len(at)), key=lambda i: (-values[:, i].sum(), i))
    out = []
    for i in order:
        support = values[:, i].sum()
        sure = np.abs(2 * centroids[at[i]] - 1).mean()
        out.append((messages[i].astype(int).tolist(), support, support / d.sum(), min(1.0, sure * min(1.0, support / least)), fallback))
    values = values[:, order]
    labels = {x[0]: int(np.argmax(v)) if v.max() >= s.localization_threshold else -1 for x, v in zip(seen, values, strict=True)}
    return out, labels


def image(seed: int, messages: list, noise: float, detected: bool = True, height: int = 20, width: int = 24) -> list:
    """Pixels of an image in which each message has a band of columns."""
    r, out = np.random.default_rng(seed), []
    for y in range(height):
        for x in range(width):
            k = x * (len(messages) + 1) // width  # the last band has none
            inside = k < len(messages) and detected
            bits = np.array(messages[k]) if inside else r.integers(0, 2, 32)
            out.append(((y, x), 0.95 if inside else 0.1, (np.where(bits == 1, 3.0, -2.0) + r.normal(0, noise, 32)).tolist()))
    return out


def test_soft_messages_equal_a_plain_run(spark):
    zero, alternating, r = [0] * 32, [0, 1] * 16, np.random.default_rng(0)
    close = [1] * 3 + [0] * 29  # nearer to zero than two messages may be
    images = {
        "two": image(1, [zero, alternating], 0.08), "noisy": image(2, [zero, alternating, [1] * 32], 1.6), "none": image(3, [zero], 0.1, detected=False),
        "close": image(4, [zero, close], 0.3), "random": [((0, k), 0.6 + 0.3 * r.random(), r.normal(0, 2, 32).tolist()) for k in range(60)], "one": image(5, [[1, 0] * 16], 0.5),
    }
    rows = [(name, y, x, d, logits) for name, pixels in images.items() for (y, x), d, logits in pixels]
    frame = spark.createDataFrame(rows, "image string, y int, x int, detection double, logits array<double>")
    messages, labels = signatures.soft_messages(frame, ["image"], ["y", "x"], 32, SETTINGS)
    got, where = defaultdict(dict), defaultdict(dict)
    for m in messages.collect():
        got[m.image][m["rank"]] = (m.message, m.support, m.support_fraction, m.confidence, m.seed_fallback)
    for p in labels.collect():
        where[p.image][p.y, p.x] = p.label
    for name, pixels in images.items():
        want, spots = plain_messages(pixels, 32, SETTINGS)
        assert len(got[name]) == len(want), name
        for k, m in enumerate(want):
            assert got[name][k][0] == m[0] and got[name][k][4] == m[4], name
            assert got[name][k][1:4] == pytest.approx(m[1:4], rel=1e-9), name
        assert where[name] == spots, name
    # Both planted messages are found in one image, each where it was put.
    assert {tuple(m[0]) for m in got["two"].values()} == {tuple(zero), tuple(alternating)}
    assert not got["none"]


def test_soft_messages_query_equals_a_plain_run(spark, small):
    from proofgrid.plans import clusters

    rows = clusters.soft_pixels(spark, small).collect()
    got = defaultdict(dict)
    for m in clusters.soft_messages(spark, small).collect():
        got[m.image][m["rank"]] = (m.message, m.support, m.confidence)
    for name in sorted({r.image for r in rows}):
        want, _ = plain_messages([(r.vec_id, r.detection, r.logits) for r in rows if r.image == name], 32, clusters.QUERY_SETTINGS)
        assert len(want) == len(got[name]) > 0
        for k, m in enumerate(want):
            assert got[name][k][0] == "".join(map(str, m[0])) and got[name][k][1:] == pytest.approx((m[1], m[3]), abs=1e-8)
