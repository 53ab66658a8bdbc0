"""Manifests, results, protocols, traces and streams against hand-made files."""

import hashlib
import json
import struct
import zlib
from datetime import datetime

import pytest

from proofgrid.sources import frozen, manifests, protocols, results
from proofgrid.streaming import live


def png(width: int, height: int, shade: int) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([shade]) * width * 3 for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.fixture
def images(tmp_path):
    (tmp_path / "in/sub dir").mkdir(parents=True)
    (tmp_path / "in/b.png").write_bytes(png(32, 24, 7))
    (tmp_path / "in/sub dir/a.png").write_bytes(png(16, 8, 9))
    return tmp_path / "in"


def test_manifest_is_built_written_and_read(spark, images, tmp_path):
    built = manifests.build_manifest(spark, f"file://{images}", "ds", "test", "*.png")
    rows = built.collect()
    assert [(r.relative_path, r.width, r.height, r.image_format) for r in rows] == [("b.png", 32, 24, "PNG"), ("sub dir/a.png", 16, 8, "PNG")]
    assert rows[0].sha256 == hashlib.sha256((images / "b.png").read_bytes()).hexdigest()
    assert manifests.build_manifest(spark, str(images), "ds", "test", limits=[None, 1, 5]).count() == 1
    manifests.write_manifest(built, f"{tmp_path}/manifest")
    assert sorted(manifests.read_manifest(spark, f"{tmp_path}/manifest").collect()) == sorted(rows)
    with pytest.raises(manifests.ManifestError):
        manifests.write_manifest(built.limit(0), f"{tmp_path}/none")


def test_bad_manifests_are_refused(spark, tmp_path):
    header = ",".join(manifests.HEADER)
    for name, text in {"header": header.replace("width", "w") + "\n", "empty": header + "\n", "twice": header + "\n" + "d,t,a,a.png,1,1,PNG,00\n" * 2}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(manifests.ManifestError):
            manifests.read_manifest(spark, str(tmp_path / name))
    (tmp_path / "number").write_text(header + "\nd,t,a,a.png,wide,1,PNG,00\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        manifests.read_manifest(spark, str(tmp_path / "number")).collect()


def test_files_are_verified(spark, images):
    manifest = manifests.build_manifest(spark, str(images), "ds", "test")
    more = manifest.limit(1).selectExpr("dataset", "split", "'x' AS sample_id", "explode(array('../b.png', 'gone.png')) AS relative_path", "width", "height", "image_format", "sha256")
    found = manifests.verify(manifest.unionByName(more), manifests.files(spark, str(images)))
    assert {r.relative_path: r.status for r in found.collect()} == {"b.png": "verified", "sub dir/a.png": "verified", "../b.png": "escape", "gone.png": "missing"}
    changed = manifest.selectExpr("*").withColumn("sha256", manifest.split)
    assert {r.status for r in manifests.verify(changed, manifests.files(spark, str(images))).collect()} == {"mismatch"}


def test_results_keep_infinities_and_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, 'say "x"'), ("b", float("inf"), None)], "dataset string, psnr double, note string")
    schema = "dataset string, psnr double, note string"
    results.write_results(rows, f"{tmp_path}/csv", form="csv")
    assert sorted(results.read_results(spark, f"{tmp_path}/csv", schema, "csv").collect()) == sorted(rows.collect())
    results.write_results(rows, f"{tmp_path}/parts", by=["dataset"])
    results.write_results(rows.where("dataset = 'a'").withColumn("psnr", rows.psnr + 1), f"{tmp_path}/parts", by=["dataset"])
    assert {(r.dataset, r.psnr) for r in results.read_results(spark, f"{tmp_path}/parts", schema).collect()} == {("a", 2.5), ("b", float("inf"))}


def test_shards_are_merged_after_checks(spark):
    shard = lambda name, n=2: spark.createDataFrame([(name, k, 0.5) for k in range(n)], "dataset string, image_id int, x double")
    key = ["dataset", "image_id"]
    assert results.merge_shards([shard("a"), shard("b")], key, 2, ["a", "b"]).count() == 4
    for shards, each, names in (([shard("a"), shard("a")], 2, None), ([shard("a"), shard("b", 3)], 2, None), ([shard("a")], 2, ["a", "b"]), ([], None, None), ([shard("a"), shard("b").drop("x")], 2, None), ([shard("a"), shard("b", 0)], None, None)):
        with pytest.raises(results.ResultError):
            results.merge_shards(shards, key, each, names)
    assert results.complete(shard("a"), shard("a"), key) and not results.complete(shard("a", 3), shard("a"), key) and not results.complete(shard("a"), shard("a").unionByName(shard("a")), key)


def test_history(spark, tmp_path):
    schema = "record_id string, created_at timestamp, model string, note string"
    history = results.History(spark, f"{tmp_path}/h", schema)
    history.append(spark.createDataFrame([(f"r{k}", datetime(2026, 1, 1 + k), "ab"[k % 2], "=1+1") for k in range(6)], schema))
    history.append(spark.createDataFrame([("r9", datetime(2025, 1, 1), "a", "ok")], schema))
    assert [r.record_id for r in history.latest(2).collect()] == ["r5", "r4"]
    assert [r.record_id for r in history.latest(9, model="a").collect()] == ["r4", "r2", "r0", "r9"]
    assert history.get("r9").count() == 1 and history.latest(0).count() == 1
    history.export(f"{tmp_path}/csv")
    assert {r.note for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()} == {"'=1+1", "ok"}


def test_protocols(spark):
    good = {"id": "p", "version": 1, "attacks": [{"id": "clean", "category": "control", "pipeline": [{"name": "identity"}]}, {"id": "two", "pipeline": [{"name": "jpeg"}, {"name": "identity"}]}]}
    assert [(r.case_id, r.category, r.steps) for r in protocols.protocol_table(spark, good, {"identity", "jpeg"}).orderBy("position").collect()] == [("clean", "control", ["identity"]), ("two", "single", ["jpeg", "identity"])]
    for change in ({"id": None}, {"version": 0}, {"attacks": []}, {"attacks": good["attacks"] * 2}, {"attacks": [{"id": "x", "pipeline": []}]}):
        with pytest.raises(protocols.ProtocolError):
            protocols.protocol_table(spark, good | change, {"identity", "jpeg"})
    with pytest.raises(protocols.ProtocolError):
        protocols.protocol_table(spark, good, {"identity"})


def test_traces(spark, tmp_path):
    cells = spark.createDataFrame([(True, "clean"), (False, "clean")], "positive boolean, attack string")
    record = lambda p, n=10: {"positive": p, "attack": "clean", "candidates": [{"name": f"c{k}", "score": k / 10, "selected_fraction": 0.1} for k in range(n)]}

    def save(name, **change):
        (tmp_path / name).mkdir()
        for k in "ab":
            (tmp_path / name / f"{k}.json").write_text(json.dumps({"status": "complete", "fingerprint": "f", "image_id": k, "records": [record(True), record(False)]} | (change if k == "b" else {}), indent=1))
        return str(tmp_path / name)

    assert protocols.read_traces(spark, save("good"), 2, cells).count() == 4
    for name, change in {"open": {"status": "running"}, "print": {"fingerprint": "g"}, "same": {"image_id": "a"}, "cells": {"records": [record(True)]}, "few": {"records": [record(True, 9), record(False)]}}.items():
        with pytest.raises(protocols.ProtocolError):
            protocols.read_traces(spark, save(name, **change), 2, cells)


def test_stream_counts_each_row_once_and_closes_windows(spark, tmp_path):
    schema = "event_id long, ts timestamp, kind string, value double"
    rows = [(k, datetime(2026, 1, 1, k // 4, 10), "xy"[k % 2], float(k)) for k in range(40)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows + rows[:5], schema).coalesce(1).write.parquet(folder)
    stream = live.once(live.result_stream(spark, folder, schema), ["event_id"], "ts", "2 hours")
    query = live.sink(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(60)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))
    summary = live.windowed(live.result_stream(spark, folder, schema), "ts", "1 hour", ["kind"], "value", "1 hour")
    live.sink(summary, f"{tmp_path}/windows", f"{tmp_path}/state2").awaitTermination(60)
    closed = {(r.window_start, r.kind): r.records for r in spark.read.parquet(f"{tmp_path}/windows").collect()}
    want = {(r.window_start, r.kind): r.records for r in live.windowed(spark.read.parquet(folder), "ts", "1 hour", ["kind"], "value").collect()}
    assert closed and closed.items() <= want.items() and max(w for w, _ in closed) < max(w for w, _ in want)
    counts = live.batch_counts(live.result_stream(spark, folder, schema), ["kind"], f"{tmp_path}/counts", f"{tmp_path}/state3")
    counts.awaitTermination(60)
    want = {r.kind: r["count"] for r in spark.read.parquet(folder).groupBy("kind").count().collect()}
    assert {r.kind: r.records for r in live.totals(spark, f"{tmp_path}/counts", ["kind"]).collect()} == want


def test_files_by_number_and_changed_sizes(spark, tmp_path):
    for name in ("10", "9", "100"):
        (tmp_path / f"{name}.png").write_bytes(png(4, 3, int(name)))
    by_path, by_number = (manifests.build_manifest(spark, str(tmp_path), "ds", "test", numeric=n) for n in (False, True))
    assert [r.relative_path for r in by_path.collect()] == ["10.png", "100.png", "9.png"]
    assert [r.relative_path for r in by_number.collect()] == ["9.png", "10.png", "100.png"]
    found = by_path.selectExpr("relative_path", "sha256", "if(relative_path = '9.png', width + 1, width) AS width", "height")
    assert {r.relative_path: r.status for r in manifests.verify(by_path, found).collect()} == {"9.png": "resized", "10.png": "verified", "100.png": "verified"}


def test_frozen_documents_stay(spark, tmp_path):
    path, started = f"file://{tmp_path}/policy", tmp_path / "provenance"
    document = {"selection_split": "calibration", "policy": {"max_candidates": 7}, "grid_sha256": frozen.sha256("grid")}
    frozen.freeze(spark, path, document, f"file://{started}")
    frozen.freeze(spark, path, document)  # the same again
    with pytest.raises(frozen.FrozenError, match="another"):
        frozen.freeze(spark, path, document | {"policy": {}})
    assert frozen.load(spark, path, "calibration", {"grid_sha256": frozen.sha256("grid")}) == document
    with pytest.raises(frozen.FrozenError, match="grid_sha256"):
        frozen.load(spark, path, "calibration", {"grid_sha256": frozen.sha256("other")})
    with pytest.raises(frozen.FrozenError, match="selected on"):
        frozen.load(spark, path, "test")
    started.mkdir()
    with pytest.raises(frozen.FrozenError, match="closed"):
        frozen.freeze(spark, path, document, f"file://{started}")


def test_categories_are_selected(spark):
    table = protocols.protocol_table(spark, {"id": "p", "version": 1, "attacks": [{"id": "a", "category": "x", "pipeline": [{"name": "s"}]}, {"id": "b", "category": "y", "pipeline": [{"name": "s"}]}]}, ["s"])
    assert protocols.select(table).count() == 2
    assert [r.case_id for r in protocols.select(table, ["y"]).collect()] == ["b"]
    with pytest.raises(protocols.ProtocolError, match="no case"):
        protocols.select(table, ["y", "z"])


def test_sizes_are_read_from_headers_of_many_forms(spark, tmp_path):
    import struct

    from proofgrid.sources import manifests

    frame = lambda n, body: b"\xff" + bytes([n]) + struct.pack(">H", len(body) + 2) + body
    jpeg = b"\xff\xd8" + frame(0xE0, b"JFIF\0" + b"\0" * 9) + frame(0xE1, b"x" * 3000) + frame(0xC4, b"h" * 40) + frame(0xC2, struct.pack(">BHH", 8, 480, 640) + b"\x03") + b"\xff\xd9"
    files = {
        "a.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 200), "b.gif": b"GIF89a" + struct.pack("<HH", 320, 70_000 % 65_536), "c.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 17, -9),
        "d.jpg": jpeg, "e.webp": b"RIFF\0\0\0\0WEBPVP8X" + b"\x0a\0\0\0" + b"\0" * 4 + (99_999).to_bytes(3, "little") + (49).to_bytes(3, "little"), "f.txt": b"hello", "g.jpg": b"\xff\xd8\x00", "h.png": b"\x89PNG\r\n\x1a\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r.sample_id: (r.width, r.height) for r in manifests.build_manifest(spark, str(tmp_path), "d", "test").collect()}
    assert found == {"a.png": (300, 200), "b.gif": (320, 4464), "c.bmp": (17, 9), "d.jpg": (640, 480), "e.webp": (100_000, 50), "f.txt": (None, None), "g.jpg": (None, None), "h.png": (None, None)}


def test_partial_files_are_combined_when_complete(spark, tmp_path):
    from proofgrid.sources import results

    schema, cells = "image_id string, attack string, score double", ["clean", "jpeg"]
    expected = spark.createDataFrame([(c,) for c in cells], "attack string")

    def part(name, rows):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / name).write_text("image_id,attack,score\n" + "".join(f"{i},{a},{s}\n" for i, a, s in rows))

    part("000_a.csv", [("a", "clean", 1.0), ("a", "jpeg", "inf")])
    part("001_b.csv", [("b", "clean", 0.5), ("b", "jpeg", 0.25)])
    table = results.combine_partials(spark, f"{tmp_path}/p", schema, expected, "image_id", ["attack"])
    assert table.columns == ["image_id", "attack", "score"] and {(r.image_id, r.attack) for r in table.collect()} == {(i, a) for i in "ab" for a in cells}
    for name, rows in (("002_short.csv", [("c", "clean", 1)]), ("002_two.csv", [("c", "clean", 1), ("d", "jpeg", 1)]), ("002_other.csv", [("c", "clean", 1), ("c", "blur", 1)]), ("002_again.csv", [("c", "clean", 1), ("c", "jpeg", 1), ("c", "jpeg", 1)])):
        part(name, rows)
        status = {r.source_file.rsplit("/", 1)[1]: r.complete for r in results.partial_status(results.read_partials(spark, f"{tmp_path}/p", schema), expected, "image_id", ["attack"]).collect()}
        assert status == {"000_a.csv": True, "001_b.csv": True, name: False}
        with pytest.raises(results.ResultError, match=name):
            results.combine_partials(spark, f"{tmp_path}/p", schema, expected, "image_id", ["attack"])
        (tmp_path / "p" / name).unlink()
    part("003_b.csv", [("b", "clean", 0.5), ("b", "jpeg", 0.25)])
    with pytest.raises(results.ResultError, match="more than one file"):
        results.combine_partials(spark, f"{tmp_path}/p", schema, expected, "image_id", ["attack"])


def test_documents_are_typed_and_held_against_their_rules(spark):
    from proofgrid.operators import snapshots

    good = '{"suite_id":"s","version":1,"images":2,"attack_cases":3,"methods":[{"method":"a","records":6,"recovered":3,"recovery":0.5},{"method":"b","records":6,"recovered":6,"recovery":1.0}],"paired":[{"baseline":"a","candidate":"b","pairs":6,"rescued":3,"regressed":0,"both":3,"neither":0,"gain_pp":50.0}]}'
    rows = {
        "good": good, "cut": good[:-10], "not": "hello", "null": None, "sum": good.replace('"neither":0', '"neither":1'), "share": good.replace('"recovery":0.5', '"recovery":0.6'),
        "twice": good.replace('"method":"b"', '"method":"a"'), "empty": '{"suite_id":"s","version":1,"images":2,"attack_cases":3,"methods":[],"paired":[]}', "gain": good.replace("50.0", "40.0"), "type": good.replace('"version":1', '"version":"one"'),
    }
    found = {r.suite_id: (r.status, r.broken, r.d) for r in snapshots.load(spark.createDataFrame(list(rows.items()), "suite_id string, document string")).collect()}
    assert found["good"][:2] == ("ready", []) and found["good"][2].methods[1].recovered == 6
    assert {k for k, v in found.items() if v[0] == "malformed"} == {"cut", "not", "null", "type"} and all(found[k][2] is None for k in ("cut", "not", "null", "type"))
    broken = {k: v[1] for k, v in found.items() if v[0] == "invalid"}
    assert broken == {"sum": ["changes don't add up"], "share": ["a recovery is not its share"], "twice": ["methods occur twice", "a pair names no method"], "empty": ["no methods"], "gain": ["a gain is not its changes"]}
