"""Pushes, imports, bundles, patches, stores and upkeep on small fixtures."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerspark import shared
from ledgerspark.functions import codec
from ledgerspark.operators import commit, maintain
from ledgerspark.plans import streams
from ledgerspark.sources import blobs, log, packs
from ledgerspark.streaming import events

UPDATES = "array<struct<name:string,old:string,new:string>>"
NAMED = "array<struct<name:string,payload:string>>"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_entries_reach_all_tables(spark):
    e = spark.createDataFrame(
        [
            ("a", 1, [("m", None, "1"), ("n", None, "2")], [("push", "x"), ("", "y"), (None, "z")], [("p1",), ("p1",)]),
            ("a", 2, [("m", "1", None)], None, None),
            ("b", 1, None, [("push", "b"), ("push", "b")], [("p2",), (None,)]),
        ],
        f"repo string, seq long, updates {UPDATES}, events {NAMED}, packs array<struct<name:string>>",
    ).withColumn("target", F.lit("clash"))
    hooks = spark.createDataFrame([("h1", "a", ["push"], True), ("h2", "a", ["*", "push"], True), ("h3", "a", ["push"], False), ("h4", "b", None, True), ("h5", "b", [], None), ("h6", "b", ["*"], True)], "id string, repo string, events array<string>, active boolean")
    refs = spark.createDataFrame([("a", "old", "9"), ("a", "n", "0")], "repo string, name string, target string")
    had = spark.createDataFrame([("a", "p1"), ("c", "p")], "repo string, name string")
    out = commit.apply_entries(e, refs, had, hooks)
    assert rows(out["refs"]) == [("a", "n", "2"), ("a", "old", "9")]
    assert rows(out["packs"]) == [("a", "p1"), ("b", "p2"), ("c", "p")]
    assert rows(out["outbox"], "repo", "seq", "pos", "hook_id") == [("a", 1, 0, "h1"), ("a", 1, 0, "h2"), ("b", 1, 0, "h6"), ("b", 1, 1, "h6")]
    assert rows(out["seqs"]) == [("a", 2), ("b", 1)]
    empty = commit.apply_entries(e.limit(0), refs, had, hooks)
    assert rows(empty["refs"]) == [("a", "n", "0"), ("a", "old", "9")] and empty["outbox"].count() == 0


def test_a_stream_of_entries_is_applied(spark, tmp_path):
    schema = f"repo string, seq long, updates {UPDATES}, events {NAMED}, packs array<struct<name:string>>"
    for i, e in enumerate([("a", 1, [("m", None, "1")], [("push", "x")], [("p1",)]), ("a", 2, [("m", "1", "2"), ("n", None, "3")], None, [("p1",)]), ("b", 1, None, [("push", "y")], None)]):
        spark.createDataFrame([e], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    hooks = spark.createDataFrame([("h", "a", ["push"], True), ("h", "a", ["push"], True)], "id string, repo string, events array<string>, active boolean")
    at = str(tmp_path / "out")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        # the second run starts anew and overwrites
        events.apply_log(stream, hooks, at)
        out = events.read_applied(spark, at)
        assert rows(out["refs"]) == [("a", "m", "2"), ("a", "n", "3")] and rows(out["packs"]) == [("a", "p1")]
        assert rows(out["outbox"], "repo", "seq", "hook_id") == [("a", 1, "h")] and rows(out["seqs"]) == [("a", 2), ("b", 1)]


def test_pushes_and_deletes(spark):
    p = spark.createDataFrame(
        [
            ("a", 1, "t1", [("m", None, "1")], [("push", "1")], [("p1",)]),
            ("a", 2, "t2", [("m", None, "2")], [("push", "2")], [("p2",)]),
            ("a", 3, "t3", [("m", "1", None), ("refs/heads/x", None, None)], [("push", "3")], None),
        ],
        f"repo string, arrival long, tx_id string, updates {UPDATES}, events {NAMED}, packs array<struct<name:string>>",
    )
    hooks = spark.createDataFrame([("h", "a", ["push"], True)], "id string, repo string, events array<string>, active boolean")
    verdicts, stored, jobs = commit.apply_pushes(p, hooks)
    assert rows(verdicts, "tx_id", "ok") == [("t1", True), ("t2", False), ("t3", True)]
    assert rows(stored) == [("a", "p1"), ("a", "p2")] and rows(jobs, "seq", "payload") == [(1, "1"), (3, "3")]
    d = spark.createDataFrame(
        [("a", 1, [("refs/heads/x", "1", None)]), ("a", 2, [("refs/heads/main", "1", None)]), ("a", 3, [("x", "1", "2"), ("y", "1", None)]), ("a", 4, []), ("a", 5, None), ("gone", 6, [("x", "1", None)]), ("b", 7, [("refs/heads/main", "1", None)]), (None, 8, [("x", "1", None)])],
        f"repo string, n long, updates {UPDATES}",
    )
    repos = spark.createDataFrame([("a", None), ("b", "trunk")], "repo string, default_branch string")
    assert dict(rows(commit.route_deletes(d, repos), "n", "way")) == {1: "batch", 2: "full", 3: "full", 4: "full", 5: "full", 6: "full", 7: "batch", 8: "full"}


def test_claims_imports_and_stages(spark):
    known = spark.createDataFrame([("a", 0)], "id string, at long")
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), (None, 3), ("c", 5)], "id string, at long")
    after, verdict = commit.claim(known, asked, "id", "at")
    assert rows(after) == [("a", 0), ("b", 1), ("c", 5)]
    assert rows(verdict, "id", "at", "created") == sorted([("a", 1, False), ("b", 1, True), ("b", 2, False), ("c", 5, True), (None, 3, False)], key=repr)
    theirs = spark.createDataFrame([("a", "refs/x", "1"), ("a", "refs/x", "1"), ("a", "HEAD", "1"), ("b", "refs/x", "1"), ("b", "refs/y", "1"), ("c", "refs/z", None)], "repo string, name string, target string")
    ours = spark.createDataFrame([("b", "refs/y")], "repo string, name string")
    assert rows(commit.import_refs(theirs, ours)) == [("a", 1, True), ("b", 2, False)]
    stored = spark.createDataFrame([("k", b"x" * 30), ("s", b"short"), ("n", None)], "k string, c binary")
    staged = spark.createDataFrame([("k", b"y" + b"x" * 20), ("k", b"x" * 19 + b"z"), ("s", b"short"), ("n", None), ("q", b"")], "k string, c binary")
    assert rows(commit.claim_staged(staged, stored, "k", "c")) == [("k", bytearray(b"y" + b"x" * 20)), ("s", bytearray(b"short"))]


def test_deliveries_settle(spark):
    jobs = spark.createDataFrame([("a", "pending", 0), ("b", "pending", 0), ("c", "pending", 4), ("d", "pending", 1), ("e", "done", 1), ("f", "pending", None)], "id string, status string, attempts int").withColumn("next_attempt_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    answers = spark.createDataFrame([("a", 204), ("b", 302), ("c", 500), ("e", 200), ("f", None), ("x", 200)], "id string, code int")
    got = {r.id: (r.status, r.attempts, str(r.next_attempt_at)) for r in commit.settle_deliveries(jobs, answers, F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert got == {
        "a": ("delivered", 1, "2024-01-01 00:00:00"), "b": ("pending", 1, "2024-02-01 00:00:30"), "c": ("failed", 5, "2024-01-01 00:00:00"),
        "d": ("pending", 1, "2024-01-01 00:00:00"), "e": ("done", 1, "2024-01-01 00:00:00"), "f": ("pending", 1, "2024-02-01 00:00:30"),
    }


def test_patches():
    rng = random.Random(3)
    for _ in range(300):
        old = "".join(rng.choice(["a\n", "b\n", "\n", "c\r\n", "long line\n"]) for _ in range(rng.randrange(12))) + rng.choice(["", "end", "\n"])
        new = old.split("\n")
        for _ in range(rng.randrange(4)):
            new[rng.randrange(len(new)) : rng.randrange(len(new)) + 1] = rng.choice([[], ["x"], ["y", "z"]])
            new = new or [""]
        new = "\n".join(new)
        diff = codec.make_diff(old, new, rng.randrange(4))
        assert codec.apply_patch(old, diff) == new
        if any(x[:1] in ("-", " ") for x in diff.split("\n")[3:]):
            with pytest.raises(ValueError):
                codec.apply_patch("another text\nof two lines\n" * 2, diff.replace("@@ -0,0", "@@ -9,0"))
    assert codec.apply_patch("", "") == "" and codec.apply_patch("kept", "") == "kept"


def test_objects_through_the_index(spark):
    data = [("blob", bytes([i]) * (i + 1)) for i in range(50)] + [("tree", b""), ("blob", random.Random(1).randbytes(70_000))]
    wire = codec.write_pack(data)
    idx = codec.write_index(codec.read_pack(wire), wire[-20:])
    for k, d in data:
        assert codec.read_object(wire, idx, codec.oid_of(k, d)) == (k, d)
    assert codec.read_object(wire, idx, "ab" * 20) is None
    df = spark.createDataFrame([(1, wire, idx)], "pack int, content binary, idx binary")
    want = [codec.oid_of(*data[3]), codec.oid_of(*data[50]), "00" * 20]
    got = packs.point_read(df, spark.createDataFrame([(w,) for w in [*want, None]], "oid string"))
    assert rows(got, "oid", "kind") == sorted([(want[0], "blob"), (want[1], "tree")])


def test_bundles(spark):
    objects = spark.createDataFrame([("a", "blob", b"1"), ("a", "blob", b"1"), ("a", "blob", b"2"), ("b", "blob", b"3")], "repo string, kind string, data binary")
    one, two = "1" * 40, "2" * 40
    refs = spark.createDataFrame([("a", "refs/y", one), ("a", "refs/x", two), ("a", "refs/bad", "12"), ("c", "refs/z", one), ("b", None, one)], "repo string, name string, target string")
    full = {r.repo: bytes(r.content) for r in packs.bundles(objects, refs, "repo").collect()}
    assert set(full) == {"a", "c"} and codec.read_bundle(full["a"])[0] == [("refs/x", two), ("refs/y", one)]
    assert len(codec.read_pack(codec.read_bundle(full["a"])[1])) == 2 and codec.read_pack(codec.read_bundle(full["c"])[1]) == []
    part = packs.bundles(objects, refs.filter("repo = 'a'"), "repo", spark.createDataFrame([("a", two)], "repo string, target string")).head().content
    with pytest.raises(ValueError):
        codec.read_bundle(bytes(part))
    assert bytes(part).startswith(codec.BUNDLE_MAGIC + f"-{two}\n".encode())


def test_consolidation(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    store = maintain.Packs(spark, blobs.store_at(spark, at), at)
    objects = spark.createDataFrame([("a", ["b"]), ("b", []), ("c", ["b"]), ("d", ["gone"]), ("x", [])], "oid string, dst array<string>")
    first, second = store.write(objects.filter("oid < 'c'")), store.write(objects.filter("oid >= 'b'"))
    assert store.put(1, [first, second]) and not store.put(1, [first])
    tips = lambda: spark.createDataFrame([("a",), ("d",)], "node string")
    got = maintain.consolidate(store, tips)
    assert got == {"swapped": True, "packs_before": 2, "packs_after": 1, "objects_before": 5, "objects_after": 3}
    number, names = store.manifest()
    assert number == 2 and rows(store.read(names), "oid") == [("a",), ("b",), ("d",)] and not (tmp_path / "store" / first).exists()
    # a tip that moves while the pack is built, to what the new pack lacks: nothing is swapped
    moving = iter([["a"], ["a", "d"]] * 3)
    got = maintain.consolidate(store, lambda: spark.createDataFrame([(t,) for t in next(moving)], "node string"))
    assert not got["swapped"] and store.manifest() == (number, names)
    # a manifest that comes first
    real = store.put
    store.put = lambda n, names: real(n, [*store.manifest()[1]]) and False
    assert not maintain.consolidate(store, tips, tries=1)["swapped"] and store.manifest()[0] == 3
    assert rows(store.read(store.manifest()[1]), "oid") == [("a",), ("b",), ("d",)]


def test_single_flight():
    flight, ran, inside, go = maintain.SingleFlight(), [], threading.Event(), threading.Event()

    def job():
        ran.append(1)
        inside.set()
        go.wait(5)

    t = threading.Thread(target=flight.run, args=("k", job))
    t.start()
    inside.wait(5)
    assert flight.run("k", job) == 0 and flight.run("k", job) == 0 and flight.run("other", lambda: None) == 1
    go.set()
    t.join(5)
    assert len(ran) == 2 and flight.run("k", lambda: ran.append(1)) == 1


def test_hadoop_store(spark, tmp_path):
    s = blobs.HadoopStore(spark, f"file://{tmp_path}/h")
    assert s.get("r", "a/b") is None and s.names("r") == []
    with pytest.raises(FileNotFoundError):
        s.fetch("r", "a/b")
    with pytest.raises(ValueError):
        s.put("r", "../x", b"")
    s.put("r", "n", b"0123456789")
    s.put("r", "n", b"abcdefghij")
    assert s.fetch("r", "n") == b"abcdefghij" and s.get_range("r", "n", 8, 5) == b"ij"
    assert s.put_if_absent("r", "one", b"1") and not s.put_if_absent("r", "one", b"2") and s.get("r", "one") == b"1"
    s.copy("r", "n", "m")
    s.delete("r", "n")
    s.delete("r", "n")
    assert [n for n in s.names("r") if not n.startswith(".")] == ["m", "one"]
    w = log.LogWriter(s, "r")
    assert w.commit([[{"Name": "m", "Old": None, "New": "1"}]]) == [True] and log.LogWriter(s, "r").refs == {"m": "1"}


def test_listing_names_every_file(spark, tmp_path):
    folder = tmp_path / "all" / "tables"
    for name, n in (("one.bin", 3), ("deep/two.bin", 5), ("deep/er/three.bin", 7)):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x" * n)
    (tmp_path / "all" / "other").mkdir()
    (tmp_path / "all" / "other" / "four.bin").write_bytes(b"x")
    assert rows(streams.R.queries["s5_listing"](spark, str(folder)), "name", "size") == [("deep/er/three.bin", 7), ("deep/two.bin", 5), ("one.bin", 3)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Session:
        conf = Conf

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared.shared_dir(Session).startswith("file://")
