"""Relational operators, folds, graphs, sources and streams, on small fixtures with known answers."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import codec
from ledgerspark.operators import folds, graph, maintain, relational, windows
from ledgerspark.sources import blobs, log, packs
from ledgerspark.streaming import events


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=repr)


def test_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("a", 5), ("a", 9), ("b", 3), (None, None)], "k string, s long")
    assert rows(relational.sequence_gaps(df, ["k"], "s")) == [("a", 3, 4), ("a", 6, 8)]


def test_nearest_rank(spark):
    rng = random.Random(1)
    values = [rng.randrange(30) for _ in range(101)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 7)], "g string, v int")
    got = {r.g: r for r in relational.nearest_rank(df, ["g"], "v", [0.5, 0.95, 1.0]).collect()}
    s = sorted(values)
    assert (got["g"].p50, got["g"].p95, got["g"].p100) == (s[50], s[int(101 * 0.95)], s[-1]) and got["h"].p50 == 7


def test_table_changes(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 5), ("c", 6), ("c", 7)], "k string, v int")
    assert rows(relational.upsert(base, new.filter("v < 7"), ["k"])) == [("a", 1), ("b", 5), ("c", 6), (None, 3)]
    assert rows(relational.upsert(base, new.withColumn("o", F.col("v")), ["k"], "o")) == [("a", 1), ("b", 5), ("c", 7), (None, 3)]
    assert rows(relational.insert_ignore(base, new, ["k"])) == [("a", 1), ("b", 2), ("c", 6), (None, 3)]
    assert rows(relational.replace_rows(base, new, new, ["k"])) == rows(base)
    assert rows(relational.replace_rows(base, base.filter("k = 'a'"), new.filter("v = 6"), ["k"])) == [("b", 2), ("c", 6), (None, 3)]
    assert rows(relational.update_where(base, F.col("k") == "a", v=F.lit(9))) == [("a", 9), ("b", 2), (None, 3)]
    assert rows(relational.delete_where(base, F.col("k") == "a")) == [("b", 2), (None, 3)]
    lent = spark.createDataFrame([("src", "p", "", "api"), ("src", "q", "first", "fork")], "repo_id string, name string, blob_repo string, source string")
    assert [r for r in rows(relational.fork_packs(lent, "src", "to"), "repo_id", "name", "blob_repo") if r[0] == "to"] == [("to", "p", "src"), ("to", "q", "first")]


def test_revisions_and_pages(spark):
    refs = spark.createDataFrame([("r", "refs/heads/x", "b"), ("r", "refs/tags/x", "t"), ("r", "refs/tags/y", "u"), ("r", "x", None)], "repo_id string, name string, target string")
    asked = spark.createDataFrame([("r", v) for v in ("x", "y", "refs/tags/x", "abcd", "nope")], "repo_id string, rev string")
    assert dict(rows(relational.resolve_revision(refs, asked), "rev", "oid")) == {"x": "b", "y": "u", "refs/tags/x": "t", "abcd": "abcd", "nope": None}
    ids = spark.createDataFrame([(f"k{i}",) for i in range(5)], "id string")
    got, after = [], ""
    while after is not None:
        page, nxt = relational.keyset_page(ids, "id", after, 2)
        got += [r.id for r in page.collect()]
        after = nxt.collect()[0]["next"]
    assert got == [f"k{i}" for i in range(5)]


def test_running_sums_and_eviction(spark):
    rng = random.Random(4)
    data = [(i, rng.randrange(50) if i % 9 else None, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, at int, n int")
    got = {r.id: r.s for r in windows.ordered_sum(df, ["at", "id"], "n", "s", range_rows=40).collect()}
    total, want = 0, {}
    for i, _, n in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        total += n
        want[i] = total
    assert got == want
    disk = spark.createDataFrame([("a", 1, 30), ("b", 2, 30), ("c", 3, 40)], "r string, at int, n int")
    assert rows(windows.evict(disk, ["at"], "n", 90, 100), "r") == [("a",)]
    assert rows(windows.evict(disk, ["at"], "n", 80, 100), "r") == []


def test_stretches(spark):
    rng = random.Random(8)
    data = [(k, i, rng.randrange(40), rng.random() < 0.1) for k in "ab" for i in range(120) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "k string, i long, v long, o boolean").withColumn("obs", F.when(F.col("o"), F.col("v")))
    tokens, guesses = {}, {}
    for k in "ab":
        last, guess = None, None
        for _, i, v, o in sorted(r for r in data if r[0] == k):
            last = v if last is None else max(v, last + 1)
            guess = v if o else guess + (v % 2) if guess is not None else None
            tokens[k, i], guesses[k, i] = last, guess
    for width in (7, 10_000):
        got = windows.increasing(df, ["k"], "i", "v", "t", stretch=width)
        assert {(r.k, r.i): r.t for r in got.collect()} == tokens
        got = windows.estimate(df, ["k"], "i", "obs", F.col("v") % 2 == 1, stretch=width)
        assert {(r.k, r.i): r.estimate for r in got.collect()} == guesses


def test_folds(spark):
    txs = [("r", 1, "a", [("x", None, "1")]), ("r", 2, "b", [("x", None, "2")]), ("r", 3, "c", [("y", None, "1"), ("x", "1", None)]), ("r", 4, "d", [("x", None, "3"), ("y", "9", "2")]), ("s", 1, "e", [])]
    df = spark.createDataFrame(txs, "repo string, arrival long, tx_id string, updates array<struct<name:string,old:string,new:string>>")
    assert rows(folds.cas_commit(df), "tx_id", "ok") == [("a", True), ("b", False), ("c", True), ("d", False), ("e", True)]
    sizes = spark.createDataFrame([("r", i, b) for i, b in enumerate([4, 4, 4, 20, 1, None])], "repo string, arrival long, bytes long")
    assert [e for _, _, e in sorted(rows(folds.group_entries(sizes, 10)), key=lambda r: r[1])] == [1, 1, 2, 3, 4, 4]
    burst = spark.range(40).select(F.lit(1).cast("long").alias("subject"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"), "id")
    assert sum(r.ok for r in folds.token_bucket(burst, 2).collect()) == 9
    assert sum(r.ok for r in folds.token_bucket(burst, 0).collect()) == 40
    reads = spark.createDataFrame([(1, i, b, 5) for i, b in enumerate([1, 2, 1, 3, 2, 1])], "reader long, at long, block long, bytes long")
    assert [h for _, h in sorted((r.at, r.hit) for r in folds.lru_cache(reads, 10).collect())] == [False, False, True, False, False, False]
    assert folds.cas_commit(df.limit(0)).count() == 0


def test_closures(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    df = spark.createDataFrame(edges, "src long, dst long")

    def reach(*seeds):
        seen = {s: 0 for s in seeds}
        todo = list(seeds)
        for x in todo:
            for a, b in edges:
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    todo.append(b)
        return seen

    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert dict(rows(graph.closure(df, seeds))) == reach(1)
    assert dict(rows(graph.closure(df, seeds, within=2))) == {k: v for k, v in reach(1).items() if v <= 2}
    for core in (4, 1000):
        assert {n for (n,) in rows(graph.reachable(df, seeds, core=core))} == set(reach(1))
    lone = spark.createDataFrame([(777,)], "node long")
    assert rows(graph.reachable(df, lone)) == [(777,)] and graph.reachable(df, lone.limit(0)).count() == 0
    deep = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.closure(deep, spark.createDataFrame([(0,)], "node long")).agg(F.max("hops")).head()[0] == 60
    assert graph.reachable(deep, spark.createDataFrame([(0,)], "node long")).count() == 61
    other = spark.createDataFrame([(2,)], "node long")
    assert {n for (n,) in rows(graph.reachable_difference(df, seeds, other))} == set(reach(1)) - set(reach(2))
    with pytest.raises(ValueError):
        graph.closure(df, spark.createDataFrame([(i,) for i in range(10)], "node long"), cap=5)


def test_history_order(spark):
    rng = random.Random(3)
    commits = {}
    for i in range(120):
        ps = sorted({f"c{rng.randrange(max(0, i - 6), i)}" for _ in range(rng.choice([1, 1, 2]))}) if i else []
        commits[f"c{i}"] = (ps + (["absent"] if i % 17 == 0 else []), i, i * 10 + rng.randrange(-40, 40))
    df = spark.createDataFrame([(k, *v) for k, v in commits.items()], "sha string, parents array<string>, timestamp long, committer_ts long")
    heap, seen, out, n = [(-commits["c119"][2], 0, "c119")], {"c119"}, [], 0
    while heap and len(out) < 25:
        _, _, s = heapq.heappop(heap)
        out.append((s, commits[s][1]))
        for p in commits[s][0]:
            if p in commits and p not in seen:
                seen.add(p)
                n += 1
                heapq.heappush(heap, (-commits[p][2], n, p))
    tips = spark.createDataFrame([("c119",), ("c119",), ("c60",), ("nowhere",), (None,)], "tip string")
    got = graph.histories(df, tips, 25).collect()
    assert [(r.sha, r.ts) for r in sorted((r for r in got if r.tip == "c119"), key=lambda r: r.pos)] == out
    assert {r.tip for r in got} == {"c119", "c60"} and sum(r.tip == "c60" for r in got) == 25


def test_path_history(spark):
    trees = {"t1": "a", "t2": "a", "t3": "b", "t4": None}
    entries = spark.createDataFrame([(t, "src", f"d{t}", "tree") for t in trees] + [(f"d{t}", "f", o, "blob") for t, o in trees.items() if o], "tree string, name string, oid string, kind string")
    commits = [("c1", "t4", []), ("c2", "t1", ["c1"]), ("c3", "t2", ["c2"]), ("c4", "t3", ["c2"]), ("m", "t3", ["c3", "c4"]), ("c5", "t4", ["m"]), ("r", "t1", None), ("x", "t1", ["absent"]), ("n", None, ["c2"])]
    df = spark.createDataFrame(commits, "sha string, tree string, parents array<string>")
    assert rows(graph.path_history(df, entries, "src/f"), "sha", "oid") == [("c2", "a"), ("c4", "b"), ("c5", None), ("n", None), ("r", "a"), ("x", "a")]


def test_trees(spark):
    blob = {p: hashlib.sha1(p.encode()).hexdigest() for p in ("a.txt", "a/inner.txt", "a0.txt", "a/b/deep.txt", "run.sh")}
    mode = {"run.sh": "100755"}

    def build(files):
        entries, dirs = [], {}
        for p, o in files.items():
            top, _, rest = p.partition("/")
            if rest:
                dirs.setdefault(top, {})[rest] = o
            else:
                entries.append((top.encode(), f"{mode.get(top, '100644')} {top}".encode(), o))
        entries += [(f"{d}/".encode(), f"40000 {d}".encode(), build(f)) for d, f in dirs.items()]
        body = b"".join(e + b"\0" + bytes.fromhex(o) for _, e, o in sorted(entries))
        return codec.oid_of("tree", body)

    df = spark.createDataFrame([("r", p, o, mode.get(p, "100644")) for p, o in blob.items()] + [("r", None, None, None)], "repo string, path string, oid string, mode string")
    got = {r.path: r.oid for r in graph.build_trees(df, ["repo"]).collect()}
    assert got[""] == build(blob) and set(got) == {"", "a", "a/b"}
    t = lambda d: spark.createDataFrame(list(d.items()), "path string, oid string")
    base, ours, theirs = {"x": "1", "y": "1", "z": "1"}, {"x": "2", "y": "1", "n": "5"}, {"x": "3", "z": "2", "n": "5"}
    assert rows(graph.merge3(t(base), t(ours), t(theirs))) == [("n", "5", False), ("x", "2", True), ("z", None, True)]
    assert rows(graph.tree_diff(t(base), t(ours)), "path", "change") == [("n", "added"), ("x", "modified"), ("z", "removed")]


def test_peel_and_chains(spark):
    objs = spark.createDataFrame([("t1", "tag", "t2"), ("t2", "tag", "c"), ("c", "commit", None), ("l", "tag", "l"), ("g", "tag", "gone")], "oid string, kind string, target string")
    assert {r.oid: r.target for r in graph.peel(objs).collect()} == {"t1": "c", "t2": "c", "c": "c", "l": None, "g": None}
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert len(graph.chains(links, spark.createDataFrame([(1,)], "node long"), 5).collect()) == 6


def test_store_and_log(spark, tmp_path):
    store = blobs.LocalStore(str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.path("r", "../../x")
    assert store.put_if_absent("r", "a", b"1") and not store.put_if_absent("r", "a", b"2") and store.get("r", "a") == b"1"
    store.copy("r", "a", "b")
    store.delete("r", "a")
    store.delete("r", "a")
    assert store.get("r", "a") is None and store.get("r", "b") == b"1"
    w1, w2 = log.LogWriter(store, "r"), log.LogWriter(store, "r")
    z = "0" * 40
    up = lambda n, o, w: {"Name": n, "Old": o, "New": w}
    assert w1.commit([[up("m", z, "1")], [up("m", z, "2")]]) == [True, False]
    assert w2.commit([[up("m", "1", "3"), up("n", z, "1" * 400)]]) == [True]
    assert w1.commit([[up("m", "1", "4")]]) == [False]
    w1.snapshot()
    assert w1.commit([[up("n", "1" * 400, z)]]) == [True] and log.LogWriter(store, "r").refs == {"m": "3"}
    root = f"file://{tmp_path}/store"
    entries, snaps = log.read_entries(spark, root), log.read_snapshots(spark, root)
    assert rows(entries, "repo", "seq") == [("r", 1), ("r", 2), ("r", 3)]
    assert rows(log.current_refs(entries)) == rows(log.current_refs(entries, snaps)) == [("r", "m", "3")]
    after = spark.createDataFrame([("r", 1)], "repo string, seq long")
    assert rows(log.replay_events(entries, after), "seq", "pos", "complete") == [(2, 0, True), (2, 1, True), (3, 0, True)]
    assert rows(log.replay_events(entries.filter("seq <> 2"), after), "seq", "complete") == [(3, False)]
    assert rows(log.prunable(entries.withColumn("packs", F.lit(None).cast(entries.schema["packs"].dataType)), snaps, spark.createDataFrame([], "repo string, name string"))) == [("r", 1), ("r", 2)]
    assert rows(blobs.listing(spark, root, "refs/wal/"), "name") == [(log.entry_name(i),) for i in (1, 2, 3)]


def test_pack_source(spark, tmp_path):
    (tmp_path / "a.pack").write_bytes(codec.write_pack([("blob", b"hello\n"), ("blob", b"")]))
    packs.register(spark)
    got = spark.read.format("objectpack").load(str(tmp_path))
    assert rows(got, "oid", "size") == sorted([("ce013625030ba8dba906f756967f9e9ca394464a", 6), (codec.oid_of("blob", b""), 0)])
    bad = spark.createDataFrame([("x", b"junk"), ("y", None)], "path string, content binary")
    assert rows(packs.unpack(bad), "pack", "oid", "error") == [("x", None, "no pack, or damaged"), ("y", None, "no pack, or damaged")]
    with pytest.raises(Exception, match="damaged"):
        packs.unpack(bad, strict=True).count()


def test_packs_without_limits_on_their_sum(spark):
    # over 64 MiB in all, none of the objects over it
    objects = [("blob", bytes([i]) * (9 << 20)) for i in range(8)]
    got = codec.read_pack(codec.write_pack(objects))
    assert [(p.kind, p.data) for p in got] == objects
    rng = random.Random(1)
    noise = rng.randbytes(300_000)
    assert codec.read_pack(codec.write_pack([("blob", noise), ("blob", b"")]))[0].data == noise
    far = [codec.Packed(codec.oid_of("blob", bytes([i])), "blob", b"", at, i) for i, at in enumerate([12, 1 << 31, 5 << 31])]
    assert sorted(codec.read_index(codec.write_index(far, b"d" * 20))) == sorted((p.oid, p.crc, p.offset) for p in far)


def test_commits_of_a_busy_repo_are_spread(spark):
    rng = random.Random(7)
    txs, state, want = [], {}, {}
    for i in range(200):
        names = rng.sample([f"r{k}" for k in range(40)], rng.choice([1, 1, 1, 2]))
        ups = [(n, state.get(n) if rng.random() < 0.8 else "stale", rng.choice([None, f"v{i}"])) for n in names]
        ok = all(state.get(n) == o for n, o, _ in ups)
        if ok:
            state |= {n: v for n, _, v in ups}
        want[f"t{i}"] = ok
        txs.append(("hot", i, f"t{i}", ups))
    txs.append(("hot", 300, "none", []))
    df = spark.createDataFrame(txs, "repo string, arrival long, tx_id string, updates array<struct<name:string,old:string,new:string>>")
    assert {r.tx_id: r.ok for r in folds.cas_commit(df).collect()} == want | {"none": True}


def test_ranks_and_order_statistics_in_ranges(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None, 3, 7, 9]), i) for i in range(150)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    got = {r.id: r.pos for r in windows.ordered_sum(df.withColumn("one", F.lit(1)), ["v", "id"], "one", "pos", ["g"], range_rows=16).collect()}
    for g in ("a", "b", None):
        mine = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[x[2]] for x in mine] == list(range(1, len(mine) + 1))
    from ledgerspark.operators.relational import nearest_rank

    stat = {r.g: (r.n, r.p50, r.p100) for r in nearest_rank(df, ["g"], "v", [0.5, 1.0]).collect()}
    for g in ("a", "b", None):
        vs = sorted(x[1] for x in data if x[0] == g and x[1] is not None)
        assert stat[g] == (len(vs), vs[min(len(vs) - 1, int(len(vs) * 0.5))], vs[-1])
    assert windows.keep_last_fulls(spark.createDataFrame([("x", i, i in (2, 5, 7)) for i in range(9)], "k string, t int, f boolean"), ["k"], "t", F.col("f"), keep=2).count() == 4


def test_streams(spark, tmp_path):
    schema = "repo_id string, seq long, updates array<struct<Name:string,Old:string,New:string>>, ts long"
    df = spark.createDataFrame([("A ", 1, [("x", "", "1"), ("y", None, "2")], 5), ("a", 2, [], 6), ("b", 1, [("x", "0" * 40, "1")], 7)], schema)
    df.write.parquet(str(tmp_path / "log"))
    stream = events.read_log_stream(spark, str(tmp_path / "log"), df.schema)
    out = events.run_available(events.subscribe(events.ref_events(stream), "a", 0))
    assert rows(out, "repo", "seq", "pos", "ref", "old") == [("a", 1, 0, "x", None), ("a", 1, 1, "y", None)]
    seen = []
    events.run_batches(stream, lambda b, n: seen.append(b.count()))
    assert sum(seen) == 3
    frame = [r.frame for r in events.frames(events.ref_events(df)).collect()][0]
    assert frame.startswith("id: 1\nevent: ref\ndata: {") and frame.endswith("\n\n")


def test_views(spark):
    views, built = maintain.Views(), []
    views.register("n", lambda: built.append(1) or spark.range(len(built)))
    assert views.get("n", 1).count() == 1 and views.get("n", 1).count() == 1 and views.get("n", 2).count() == 2 and len(built) == 2
