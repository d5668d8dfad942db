"""Places where a query once did less than the whole job."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerspark.operators import hierarchy
from ledgerspark.sources import log


def run(spark, name, folder):
    return __spark_entry__.queries()[name](spark, str(folder))


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


WAL = "repo_id string, seq long, updates array<struct<Name:string,Old:string,New:string>>, packs array<struct<name:string,data:string,idx:string>>, received_at timestamp_ntz"


def test_log_files_are_shared(spark, tmp_path, monkeypatch):
    save(spark, tmp_path, "wal_entry", [("a", 1, [("x", None, "1")], None, None), ("a", 2, [("x", "1", "2"), ("y", None, "3")], None, None), ("b", 1, [("x", None, "4")], None, None)], WAL)
    monkeypatch.setattr(tempfile, "mkdtemp", lambda *a, **k: pytest.fail("a folder of the driver's machine"))
    got = {tuple(r) for r in run(spark, "s10_log_state", tmp_path).select("repo", "name", "target").collect()}
    assert got == {("a", "x", "2"), ("a", "y", "3"), ("b", "x", "4")}


def test_lost_log_files_are_noticed(spark, tmp_path):
    body = spark.createDataFrame([("a", i) for i in (1, 2)], "repo string, seq long").withColumn("data", F.encode(F.lit('{"seq": 1, "updates": []}'), "UTF-8"))
    n = log.write_entries(body, f"file://{tmp_path}/log")
    assert n == 2 and log.read_written(spark, f"file://{tmp_path}/log", n).count() == 2
    os.unlink(glob.glob(f"{tmp_path}/log/a/refs/wal/*.json")[0])
    with pytest.raises(RuntimeError):
        log.read_written(spark, f"file://{tmp_path}/log", n)


def test_driver_knows_no_log_files(spark, tmp_path):
    root, repos = f"file://{tmp_path}/log", ["a", "_b", "c d", "org/e"]
    rows = [(r, q) for r in repos for q in (1, 2, 4096, 70_000)]
    body = spark.createDataFrame(rows, "repo string, seq long").withColumn("data", F.encode(F.concat(F.lit('{"updates": [{"Name": "'), "seq", F.lit('"}]}')), "UTF-8"))
    n = log.write_entries(body, root)
    (tmp_path / "log/a/refs/wal/x.json").write_text("no entry")
    (tmp_path / "log/a/refs/snapshot.json").write_text("{}")
    got = log.read_entries(spark, root)
    assert n == len(rows) and not got.inputFiles()  # none of them is in the driver's plan
    assert sorted((r.repo, r.seq, r.updates[0].Name) for r in got.collect()) == sorted((r, q, str(q)) for r, q in rows)
    for limits in ({}, {"at_once": 3}, {"at_once": 1, "most": 2}):
        got = log.through_store(body, f"{root}s", **limits)
        assert sorted((r.repo, r.seq, r.updates[0].Name) for r in got.collect()) == sorted((r, q, str(q)) for r, q in rows)
        assert not os.path.exists(f"{tmp_path}/logs")
    assert log.through_store(body.limit(0), f"{root}s").count() == 0


def test_lineage_of_deep_commits(spark, tmp_path):
    parent = {f"d{i}": f"d{i - 1}" if i else "absent" for i in range(150)}  # beyond the depth that paths() takes
    parent |= {f"w{i}": "d3" for i in range(40)} | {f"v{i}": f"w{i}" for i in range(9)}
    parent |= {"l0": "l1", "l1": "l2", "l2": "l3", "l3": "l0", "m0": "l2", "m1": "m0", "n0": "l0", "self": "self", "o": "self", "alone": None}
    save(spark, tmp_path, "commits", [(k, [p] if p else []) for k, p in parent.items()], "sha string, parents array<string>")
    want = set()
    for v in parent:
        a, steps, seen = v, 0, set()
        while a in parent and a not in seen:
            seen.add(a)
            want.add((a, v, steps))
            a, steps = parent[a], steps + 1
    rows = run(spark, "p2_lineage", tmp_path).cache()
    assert rows.count() == len(parent)
    assert {tuple(r) for r in hierarchy.chains(rows, rows, "sha").collect()} == want
    some = rows.filter("sha IN ('d3', 'l2', 'm0', 'w1')")
    assert {tuple(r) for r in hierarchy.descendants(rows, some, "sha").collect()} == {x for x in want if x[0] in ("d3", "l2", "m0", "w1")}


def test_advertised_list_is_whole(spark, tmp_path):
    seqs = [*range(1, 41), 70_000, 70_001]
    save(spark, tmp_path, "wal_entry", [(r, q, None, None, None) for r in ("a", "A ", "b", None) for q in seqs], WAL)
    got = {(r.repo_id, r.name, r.pos) for r in run(spark, "b9_advertised_list", tmp_path).collect()}
    assert got == {(r, f"{q:010d}.bundle", i) for r in ("a", "b", None) for i, q in enumerate(seqs, 1)}


def test_limits_are_the_originals(spark, tmp_path):
    up = lambda n: [(f"u{i}", None, "1") for i in range(n)]
    save(spark, tmp_path, "wal_entry", [("a", n, up(n), None, None) for n in (0, 4, 512, 513)], WAL)
    assert {r.seq: r["count"] for r in run(spark, "m23_transitions", tmp_path).groupBy("seq").count().collect()} == {4: 4, 512: 512}
    spark.createDataFrame([(1, 2001), (2, 10 << 20), (3, (10 << 20) + 1)], "doc_id long, n int").select("doc_id", F.expr("repeat('x', n)").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = run(spark, "f22_size_gate", tmp_path).select("doc_id", "too_large", F.octet_length("content").alias("n"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, False, 2668), (2, False, 13981016), (3, True, None)]


def test_unflushed_packs_hold_entries(spark, tmp_path):
    up, pack = [("x", None, "1")], lambda n, data="AQ==": [(n, data, None)]
    wal = [("a", q, up, pack(f"p{q}") if q in (5, 9, 130) else None, None) for q in range(1, 131)]
    wal += [("a", 7, [], pack("lone"), None), ("b", 63, up, None, None), ("a", 129, up, pack("p5", "Ag=="), None)]
    save(spark, tmp_path, "wal_entry", wal, WAL)
    save(spark, tmp_path, "packs", [("A", "p9", 1, "s", None, None)], "repo_id string, name string, size_bytes long, source string, created_at timestamp_ntz, blob_repo string")
    assert sorted(tuple(r) for r in run(spark, "m7_prunable", tmp_path).collect()) == [("a", q) for q in range(1, 129) if q not in (5, 7)]
    got = {(r.repo, r.name): (r.seq, r.data) for r in run(spark, "m9_inline_packs", tmp_path).collect()}
    assert got == {("a", "p5"): (129, "02"), ("a", "p9"): (9, "01"), ("a", "p130"): (130, "01"), ("a", "lone"): (7, "01")}
