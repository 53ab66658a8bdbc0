"""Source mixing, centroid clustering and collocations against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import data
import numpy as np
import pyarrow as pa
import pytest

from proofgrid.llm import collocations, sort_means, source_mix


def filled(sizes: dict, weights: dict, budget: Fraction, most: int) -> dict:
    """Targets in whole fractions, by taking the source that is furthest above its limit out, one at a time."""
    total, full = budget * sum(sizes.values()), {s for s in sizes if not sizes[s]}
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {s: share.get(s, Fraction(most * sizes[s])) for s in sizes}
        full.add(max(over, key=lambda s: share[s] / sizes[s]))


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def cyclic(sources, weights=(5, 2, 1)):
    ordered = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    return {s: weights[k % len(weights)] for k, s in enumerate(ordered)}


def test_mix_targets_and_copies(spark):
    docs = data.table(spark)
    got = source_mix.plan_mix(docs).collect()
    rows = data.rows()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = filled(dict(sizes), cyclic(sizes), Fraction(3, 2), 2)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert math.floor(r.rate) <= r.copies <= min(2, math.ceil(r.rate)) and r.taken == r.copies * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, source_mix.plan_mix(docs.repartition(7)).collect()))
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in got)
    assert source_mix.plan_mix(docs.limit(0)).collect() == [] and source_mix.mix(docs.limit(0)).collect() == []


def test_mix_comes_near_its_targets(spark):
    texts = {k: " ".join(["w"] * (1 + k % 7)) for k in range(6_000)}
    docs = spark.createDataFrame([(k, t, "abcde"[min(4, k // 1000)] if k % 11 else None) for k, t in texts.items()], "doc_id long, text string, source string")
    got = source_mix.plan_mix(docs).groupBy("source", "target", "source_size").sum("taken").collect()
    assert {r.source for r in got} == {*"abcde", None}
    for r in got:
        assert r.target <= 2 * r.source_size + 1e-6
        assert abs(r["sum(taken)"] - r.target) < 0.08 * r.source_size
    assert sum(r.target for r in got) == pytest.approx(1.5 * sum(r.source_size for r in got))


def test_equal_rows_have_draws_of_their_own(spark):
    docs = spark.createDataFrame([(None, "a b c", "hot")] * 4_000 + [(1, "x " * 4_000, "cold")], "doc_id long, text string, source string")
    got = source_mix.plan_mix(docs, weights=(1, 1))
    hot = got.where("source = 'hot'").groupBy("copies").count().collect()
    rate = got.where("source = 'hot'").first().rate
    assert 1 < rate < 2 and {r.copies for r in hot} == {1, 2}
    assert sum(r.copies * r["count"] for r in hot) == pytest.approx(4_000 * rate, rel=0.05)
    assert sorted(map(str, got.collect())) == sorted(map(str, source_mix.plan_mix(docs.repartition(9), weights=(1, 1)).collect()))


def test_mix_by_given_weights(spark):
    docs = spark.createDataFrame([(k, "a b", s) for k, s in enumerate("aaabbbcccc")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "source string, weight long")
    got = {r.source: r.target for r in source_mix.plan_mix(docs, weights, Fraction(1, 2), 2).collect()}
    assert got == {"a": 7.5, "b": 2.5, "c": 0.0}


def plain_clusters(vectors: list, clusters: int = 40, rounds: int = 5) -> tuple[list, list]:
    """Every vector against every centroid, in Python's whole numbers."""
    kept = [(k, [math.floor(256 * float(x)) for x in v]) for k, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"2:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(column) // len(members[k]) for column in zip(*members[k], strict=True)] if members[k] else c for k, c in enumerate(centroids)]
    return [(k, nearest(v)[1], nearest(v)[0]) for k, v in kept], centroids


def test_clusters_equal_plain_ones(spark):
    r = np.random.default_rng(7)
    vectors = [(k, (r.normal(size=64) * (1 + k % 5)).astype("float32").tolist()) for k in range(160)]
    vectors += [(0, vectors[0][1]), (200, [0.0] * 64), (201, [-0.001] * 64), (202, vectors[3][1]), (None, vectors[4][1])]
    vectors += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [1.0] * 63 + [float("nan")]), (305, [float("inf")] * 64)]
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in vectors], "vec_id long, embedding array<float>, cluster string, v int")
    want, centroids = plain_clusters(vectors)
    got, found = sort_means.clustered(frame.repartition(5))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert found.tolist() == centroids
    full = sort_means.with_inertia(got, found).collect()
    assert {x.inertia for x in full} == {sum(d for _, _, d in want)}
    assert all(x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest() and x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster) for x in full)


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    got, centroids = sort_means.clustered(spark.createDataFrame([(k, [float(k)] * 64) for k in range(3)], schema))
    assert len(centroids) == 3 and {x.distance for x in got.collect()} == {0}
    assert sort_means.with_inertia(*sort_means.clustered(spark.createDataFrame([], schema))).collect() == []
    assert sort_means.with_inertia(*sort_means.clustered(spark.createDataFrame([(1, None)], schema))).collect() == []


def test_a_scan_stops_strictly_beyond_twice_the_distance():
    # A vector midway between two centroids: the other one lies at exactly twice its distance and has the smaller number.
    centroids = np.array([[4] + [0] * 63, [0] * 64], np.int64)
    who, best = sort_means.sort_means(np.array([[2] + [0] * 63], np.int64), np.array([1]), centroids)
    assert who.tolist() == [0] and best.tolist() == [4]


def plain_collocations(rows: list, least: int, top: int) -> dict:
    """lang -> rows (phrase, a, l, r, n, score) by counting every phrase of every text."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(found)
            for k in range(1, 5):
                for i in range(len(found) - k + 1):
                    f[lang or "und"][tuple(found[i : i + k])] += 1
    out = {}
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, left, right, n[lang], score))
        out[lang] = sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top]
    return out


def mined(frame) -> dict:
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.lang, r["rank"])):
        assert r["rank"] == len(out[r.lang]) + 1
        out[r.lang].append((r.phrase, r.a, r.l, r.r, r.n, r.score))
    return dict(out)


def awkward_texts() -> list[tuple]:
    r = np.random.default_rng(3)
    vocabulary = ["New", "york", "city", "ünï", "日本", "a\x00b", "it's", "x", "é", "　y", "longer-than-sixteen-bytes-word", "longer-than-sixteen-bytes-ward"]
    texts = [(["en", "de", None][k % 3], "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";"]) for w in r.choice(vocabulary, 40 + k % 50))) for k in range(150)]
    texts += [("en", "New York city hall. " * 400), ("en", None), (None, ""), ("de", " .,; "), ("en", "only"), ("und", "x x x x x"), ("en", "Yes. Yes. No")] + [("en", "the same old piece, the same old piece")] * 30
    return texts + [("en", "word " * 3_000)]


def test_collocations_equal_plain_counts(spark, monkeypatch):
    rows = awkward_texts()
    frame = spark.createDataFrame([(lang, text, "p", 1) for lang, text in rows], "lang string, text string, piece string, words int")
    for least, top, langs in ((3, 2000, 3), (30, 2, 1)):
        want = {lang: found for lang, found in plain_collocations(rows, least, top).items() if found}
        assert len(want) == langs and mined(collocations.collocations(frame.repartition(3), least=least, top=top)) == want
    assert collocations.collocations(frame.limit(0)).collect() == []


def test_collocations_do_not_depend_on_blocks_or_filters(spark, monkeypatch):
    rows = [(lang, text) for lang, text in awkward_texts() if text]
    cut = collocations.pieces(spark.createDataFrame(rows, "lang string, text string"))
    langs = [r.lang for r in cut.collect()]
    text, times = pa.array([r.piece for r in cut.collect()]), np.array([r.times for r in cut.collect()], np.int64)
    code, salt = collocations._salts(pa.array(langs))

    def counts(known):
        found = Counter()
        for _, lang, phrases, weight in collocations.block_phrases(text, code, salt, times, 2, known):
            for k, phrase, n in zip(lang.tolist(), phrases.to_pylist(), weight.tolist(), strict=True):
                found[k, phrase] += n
        return found

    every = counts(None)
    full = collocations.Filter(np.full(16, 0xFFFFFFFFFFFFFFFF, np.uint64))  # a filter that lets all through
    assert counts(full) == every
    monkeypatch.setattr(collocations, "BLOCK", 300)
    assert counts(None) == every
    assert not counts(collocations.Filter(np.zeros(16, np.uint64)))
