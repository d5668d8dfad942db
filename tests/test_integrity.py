"""Orphans, hierarchies, differences and replay against brute force, with the awkward cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.keys import ZERO_OID, clean_key
from ledgerspark.operators import copies, hierarchy, orphans, replay
from ledgerspark.shared import skew_join


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_clean_key(spark):
    df = spark.createDataFrame([(" Ab ",), ("",), ("  ",), (ZERO_OID,), (None,), ("x",)], "k string")
    assert [r.k for r in df.select(clean_key("k").alias("k")).collect()] == ["ab", None, None, None, None, "x"]


def test_orphans_masks(spark):
    refs = spark.createDataFrame(
        [(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, None, None), (5, "z", "x"), (6, "z", None), (6, "z", None)], "id int, p string, q string"
    )
    targets = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", None), ("a", "x")], "p string, q string")
    get = lambda m: rows(orphans.find_orphans(refs, targets, ["p", "q"], match=m), "id", "kind")
    assert get("simple") == [(5, "missing")]
    assert get("partial") == [(5, "missing"), (6, "missing"), (6, "missing")]
    assert get("full") == [(2, "malformed"), (3, "malformed"), (5, "missing"), (6, "malformed"), (6, "malformed")]


def test_orphans_late_clashing_names_and_empty(spark):
    refs = spark.createDataFrame([("k", 5, "old"), ("k", 1, "old"), ("k", None, "old"), (None, 1, "old")], "key string, since int, kind string").withColumn("there", F.lit(1))
    targets = spark.createDataFrame([("k", 3), ("k", 2), ("k", None)], "key string, since int")
    out = orphans.find_orphans(refs, targets, ["key"], ref_time="since", target_time="since")
    assert out.columns == ["key", "since", "there", "kind"]
    assert rows(out, "key", "since", "kind") == [("k", 1, "late")]
    none = targets.limit(0)
    assert {r.kind for r in orphans.find_orphans(refs, none, ["key"]).collect()} == {"missing"}
    assert orphans.find_orphans(refs.limit(0), targets, ["key"]).count() == 0


def test_orphan_report(spark):
    o = spark.createDataFrame([("a", "r", "2024-01-05 00:00:00", "late"), ("a", "r", "2024-03-01 00:00:00", "late"), ("a", "s", None, "missing")], "src string, row string, at string, kind string")
    o = o.withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert rows(orphans.orphan_report(o, ["src"], ["row"], "at"), "src", "month", "kind", "n") == [("a", "2024-01", "late", 1), ("a", None, "missing", 1)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, how):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b", "c", None, None])], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, w int")
    want = rows(left.join(right, ["k"], how), *left.join(right, ["k"], how).columns)
    got = skew_join(left, right, ["k"], how, min_rows=10)
    assert rows(got, *left.join(right, ["k"], how).columns) == want


def brute_hierarchy(parent):
    out = {}
    for start in parent:
        way, at = [], start
        while at in parent and at not in way:
            way.append(at)
            at = parent[at]
        if at not in parent:
            out[start] = (way[-1], len(way) - 1, "tree")
        else:
            loop = way[way.index(at) :]
            out[start] = (min(loop), 0, "cycle") if start in loop else (min(loop), way.index(at), "below")
    return sorted((k, *v) for k, v in out.items())


def test_hierarchy_random(spark):
    rng = random.Random(5)
    for n in (1, 40, 300):
        parent = {f"{i:040x}" if i % 3 else f"odd id {i}": None for i in range(n)}
        ids = list(parent)
        for i, k in enumerate(ids):
            parent[k] = rng.choice([None, "absent", ids[rng.randrange(n)], ids[max(0, i - 1)], ids[max(0, i - 1)], ids[max(0, i - 1)]])
        df = spark.createDataFrame([*parent.items(), *list(parent.items())[:5], (None, ids[0])], "id string, parent string")
        assert rows(hierarchy.resolve(df), "id", "root", "depth", "state") == brute_hierarchy(parent)


def test_hierarchy_shapes(spark):
    chain = {f"n{i:03}": f"n{i - 1:03}" if i else None for i in range(130)}
    loops = {"a": "b", "b": "c", "c": "a", "d": "c", "e": "d", "s": "s", "t": "s"}
    star = {f"leaf{i}": "hub" for i in range(50)} | {"hub": "top", "top": None}
    for parent in (chain, loops, star, chain | loops | star):
        df = spark.createDataFrame(list(parent.items()), "id string, parent string")
        assert rows(hierarchy.resolve(df), "id", "root", "depth", "state") == brute_hierarchy(parent)
    assert hierarchy.resolve(spark.createDataFrame([], "id string, parent string")).count() == 0


@pytest.mark.parametrize("core", [0, 7])
def test_hierarchy_contracted(spark, core):
    rng = random.Random(core)
    deep = {f"n{i:03}": f"n{i - 1:03}" if i else None for i in range(60)}
    loops = {"a": "b", "b": "c", "c": "a", "d": "c", "e": "d", "s": "s", "t": "s", "u": "t", "p": "q", "q": "p"}
    wild = {f"w{i:03}": rng.choice([None, f"w{rng.randrange(80):03}", f"w{max(0, i - 1):03}", f"w{max(0, i - 1):03}"]) for i in range(80)}
    parent = deep | loops | wild
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    assert rows(hierarchy.resolve(df, core=core), "id", "root", "depth", "state") == brute_hierarchy(parent)


def test_lineage_contracted(spark):
    rng = random.Random(6)
    parent = {f"w{i:03}": rng.choice([None, f"w{rng.randrange(70):03}", f"w{max(0, i - 1):03}", f"w{max(0, i - 1):03}"]) for i in range(70)}
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    want = set()
    for start in parent:
        at, steps, seen = start, 0, set()
        while at in parent and at not in seen:
            seen.add(at)
            want.add((at, start, steps))
            at, steps = parent[at], steps + 1
    got = hierarchy.lineage(df, core=5).cache()
    assert {tuple(r) for r in hierarchy.chains(got, got).collect()} == want
    some = df.filter("id IN ('w003', 'w010', 'w069')")
    assert {tuple(r) for r in hierarchy.descendants(got, some).collect()} == {x for x in want if x[0] in ("w003", "w010", "w069")}


def test_paths_and_pairs(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("l", "m"), ("m", "l"), ("b", "a")], "id string, parent string")
    got = {r.id: (r.root, r.depth, r.path) for r in hierarchy.paths(df).collect()}
    assert got == {"a": ("a", 0, "a"), "b": ("a", 1, "a/b"), "c": ("a", 2, "a/b/c"), "x": ("x", 0, "x"), "l": (None, None, None), "m": (None, None, None)}
    tree = df.filter("id NOT IN ('l', 'm')")
    assert ("a", "c", 2) in rows(hierarchy.ancestor_pairs(tree), "ancestor", "id", "steps")
    with pytest.raises(ValueError):
        hierarchy.ancestor_pairs(df, max_depth=5)


def test_check_hash_is_sparks(spark):
    rng = np.random.default_rng(1)
    k, v = rng.integers(-(2**63), 2**63 - 1, 50), rng.integers(-(2**63), 2**63 - 1, 50)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(k, v, strict=True)], "k long, v long")
    assert [r.h for r in df.select(F.xxhash64("k", "v").alias("h")).collect()] == list(copies.check_hash(k.view(np.uint64), v.view(np.uint64)).view(np.int64))


def brute_diff(left, right):
    out = []
    for k in {r[0] for r in left} | {r[0] for r in right}:
        a, b = {r[1:] for r in left if r[0] == k}, {r[1:] for r in right if r[0] == k}
        if a and b and a != b:
            out.append((k, "values", tuple(n for i, n in enumerate(("x", "y")) if {r[i] for r in a} != {r[i] for r in b})))
        elif a != b:
            out.append((k, "only_left" if a else "only_right", ()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.9])
def test_diff_random(spark, share):
    rng = random.Random(3)
    left = [(f"k{i}" if i % 50 else None, rng.choice(["a", None]), i % 7) for i in range(600)]
    right = [r if rng.random() > share else (rng.choice([r[0], f"new{r[0]}"]), rng.choice(["a", "b", None]), 9) for r in left]
    l = spark.createDataFrame([(*r, 1) for r in left + left[:20]], "k string, x string, y int, side int")
    r = spark.createDataFrame([(*r, 2) for r in right + right[:9]], "k string, x string, y int, side int")
    got = copies.diff_copies(l, r, ["k"], ["x", "y"], rows_per_bucket=256, cells=12)
    assert sorted(((r.k, r["diff"], tuple(r.changed)) for r in got.collect()), key=repr) == brute_diff(left, right)


def test_tables_grow_until_they_come_out(spark):
    rng = np.random.default_rng(2)
    kf, vf = (rng.integers(0, 2**63, 4000, dtype=np.uint64) for _ in range(2))
    left, right = np.ones(4000, bool), np.arange(4000) % 3 > 0
    for cells in (3, 48, 3072):
        assert list(copies.differing(kf, vf, left, right, cells)) == sorted(kf[~right])
    keys, whole = copies.Table(kf, vf, 3072).minus(copies.Table(kf[right], vf[right], 3072)).peel()
    assert whole and len(keys) == (~right).sum()
    assert not copies.Table(kf, vf, 48).peel()[1]


def test_diff_of_a_hot_key_and_of_keys_alone(spark):
    l = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") % 1500).alias("v")).unionAll(spark.createDataFrame([("a", 1)], "k string, v long"))
    r = l.filter("v <> 77")
    assert [(x.k, x["diff"], x.changed) for x in copies.diff_copies(l, r, ["k"], ["v"]).collect()] == [("hot", "values", ["v"])]
    assert [(x.k, x.v, x["diff"], x.changed) for x in copies.diff_copies(l, r, ["k", "v"], []).collect()] == [("hot", 77, "only_left", [])]
    # more keys than are sent along
    copies.KEYS_SENT, old = 0, copies.KEYS_SENT
    try:
        assert copies.diff_copies(l, r, ["k", "v"], []).count() == 1
    finally:
        copies.KEYS_SENT = old


def test_diff_empty_sides(spark):
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    none = one.limit(0)
    assert rows(copies.diff_copies(one, none, ["k"], ["v"]), "k", "diff") == [("a", "only_left")]
    assert rows(copies.diff_copies(none, one, ["k"], ["v"]), "k", "diff") == [("a", "only_right")]
    assert copies.diff_copies(none, none, ["k"], ["v"]).count() == 0
    assert rows(copies.table_equal(one, one, ["k", "v"]), "equal") == [(True,)]
    assert rows(copies.table_equal(one, none, ["k", "v"]), "equal") == [(False,)]


LOG = "repo_id string, seq long, updates array<struct<Name:string,Old:string,New:string>>, received_at timestamp_ntz"


def brute_replay(entries):
    state = {}
    for (repo, _), ups in sorted(entries.items()):
        staged, ok = {}, True
        for n, o, w in ups:
            if n is None or (staged[n] if n in staged else state.get((repo, n))) != o:
                ok = False
                break
            staged[n] = w
        if ok:
            state |= {(repo, n): v for n, v in staged.items()}
    return sorted((*k, v) for k, v in state.items() if v is not None)


def test_replay_random(spark):
    rng = random.Random(11)
    for _ in range(3):
        entries, state = {}, {}
        for seq in range(1, 150):
            repo = rng.choice(["big", "big", "a", "b"])
            ups = []
            for _ in range(rng.choice([1, 1, 1, 2, 4])):
                n = f"r{rng.randrange(12)}"
                old = state.get((repo, n)) if rng.random() < 0.8 else rng.choice([None, "v1"])
                new = rng.choice([None, f"v{seq}"])
                ups.append((n, old, new))
                state[(repo, n)] = new
            entries[(repo, seq)] = ups
        entries[("a", 500)] = [(None, None, "v")]
        received = []
        for (repo, seq), ups in entries.items():
            dirty = [(n, rng.choice(["", ZERO_OID, None]) if o is None else f" {o.upper()} ", rng.choice(["", ZERO_OID]) if w is None else w) for n, o, w in ups]
            received.append((f" {repo.upper()}", seq, dirty, None))
            received.append((repo, seq, rng.choice([None, [], dirty]), None))
        rng.shuffle(received)
        got = replay.replay(spark.createDataFrame(received, LOG))
        assert rows(got, "repo_id", "name", "target") == brute_replay(entries)


def test_replay_gaps_and_empty(spark):
    up = lambda n, o, w: [(n, o, w)]
    log = [("a", 1, up("x", None, "1"), None), ("a", 2, None, None), ("a", 4, up("x", "1", "2"), None), ("b", 2, up("y", None, "1"), None), (None, 1, up("z", None, "1"), None)]
    df = spark.createDataFrame(log, LOG)
    assert rows(replay.replay(df), "repo_id", "name", "target") == [("a", "x", "2"), ("b", "y", "1")]
    assert rows(replay.replay(df, hold_gaps=True), "repo_id", "name", "target") == [("a", "x", "1")]
    marks = replay.watermarks(df.select(clean_key("repo_id").alias("repo"), "seq").filter("repo IS NOT NULL"))
    assert rows(marks, "repo", "watermark", "last", "held") == [("a", 2, 4, 1), ("b", 0, 2, 1)]
    assert replay.replay(df.limit(0)).count() == 0


def test_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in replay.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(up) if find(n) != n}
