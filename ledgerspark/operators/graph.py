"""Walks over object graphs: closures, differences, chains, history, trees and their merges.

Edges are rows (src, dst). A walk keeps one row per node reached and joins the frontier with the edges round by round;
the visited set and each frontier are cut to the shared folder, so that plans stay short and lost executors cost a re-read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerspark.functions.scalars import object_id
from ledgerspark.operators.hierarchy import CORE, above, intervals, lineage
from ledgerspark.operators.relational import COMMIT_MOST, tree_order
from ledgerspark.shared import cut, discard, union_all


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def closure(edges: DataFrame, seeds: DataFrame, *, stop: DataFrame | None = None, within: int | None = None, cap: int | None = None) -> DataFrame:
    """(node, hops) of everything that can be reached from seeds(node), in fewest hops; seeds themselves have 0. Nodes in
    stop(node) are reached, but not gone beyond. within: just what is so many hops away at most; without it the walk ends
    when nothing new comes, however deep. More than cap nodes raise ValueError. Loops in the graph are fine.

    A round is a hop, so this is for walks of few hops, or where their number is asked for; see reachable()."""
    links = cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    front, n = _counted(seeds.select(F.col("node")).filter("node IS NOT NULL").distinct().withColumn("hops", F.lit(0)))
    parts, total, hop = [front], n, 0
    while n and (within is None or hop < within):
        hop += 1
        go = front if stop is None else front.join(stop.select("node").distinct(), "node", "left_anti")
        new = go.join(links, go.node == links.src).select(F.col("dst").alias("node")).distinct()
        new = new.join(union_all([p.select("node") for p in parts]), "node", "left_anti").withColumn("hops", F.lit(hop))
        front, n = _counted(new)
        if not n:
            break
        parts.append(front)
        total += n
        if cap is not None and total > cap:
            raise ValueError(f"more than {cap} nodes")
        if len(parts) > 16:
            # few files to read again and again, however deep the walk
            old, parts = parts, [cut(union_all(parts))]
            discard(*old[:-1])
            parts, front = [parts[0]], parts[0].filter(F.col("hops") == hop)
            discard(old[-1])
    return union_all(parts)


def reachable(edges: DataFrame, seeds: DataFrame, core: int = CORE) -> DataFrame:
    """(node) for everything that can be reached from seeds(node), seeds included, by edges(src, dst). One edge of each node makes up a forest; all that it leads to from a set of nodes is found at once, by the intervals of lineage(), so that a
    round is a change to another edge (a merge) rather than a hop. Loops are fine; so are nodes without edges."""
    kind = seeds.schema["node"].dataType
    text = [F.col(c).cast("string").alias(c) for c in ("src", "dst")]
    links = cut(edges.select(*text).filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    first = links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
    ends = links.select(F.col("dst").alias("id")).distinct().join(first.select("id"), "id", "left_anti").withColumn("parent", F.lit(None).cast("string"))
    forest = cut(lineage(first.unionByName(ends), core=core))
    other = cut(links.join(first.select(F.col("id").alias("src"), F.col("parent").alias("dst")), ["src", "dst"], "left_anti"))
    spans = cut(intervals(forest))
    start = seeds.select(F.col("node").cast("string").alias("node")).filter("node IS NOT NULL").distinct()
    # seeds that no edge has are reached all the same
    new, n = _counted(start)
    parts = [new]
    while n:
        up = above(forest, spans, new.select(F.col("node").alias("id"))).select(F.col("id").alias("node"))
        met, _ = _counted(up.join(union_all(parts), "node", "left_anti"))
        new_parts = [*parts, met]
        step = new.unionByName(met).join(other, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new, n = _counted(step.join(union_all(new_parts), "node", "left_anti"))
        parts = [*new_parts, new] if n else new_parts
    discard(links, other, spans)
    return union_all(parts).select(F.col("node").cast(kind).alias("node"))


def reachable_difference(edges: DataFrame, of: DataFrame, without: DataFrame) -> DataFrame:
    """Nodes reachable from `of`, but not from `without`."""
    return reachable(edges, of).join(reachable(edges, without), "node", "left_anti")


def dangling(edges: DataFrame, objects: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that the closure of the seeds refers to, though objects(node) doesn't have them: none means that it is
    whole."""
    return reachable(edges, seeds).join(objects.select("node").distinct(), "node", "left_anti")


def chains(links: DataFrame, starts: DataFrame, max_hops: int = 16) -> DataFrame:
    """(start, node, hop) along links(src, dst) with one dst per src, at most max_hops steps from each of starts(node);
    the start itself has hop 0. A chain ends where there is no link."""
    one = links.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.min("dst").alias("dst"))
    front, n = _counted(starts.select(F.col("node").alias("start"), "node").filter("node IS NOT NULL").distinct().withColumn("hop", F.lit(0)))
    parts = [front]
    for hop in range(1, max_hops + 1):
        if not n:
            break
        front, n = _counted(front.join(one, front.node == one.src).select("start", F.col("dst").alias("node"), F.lit(hop).alias("hop")))
        parts.append(front)
    return union_all(parts)


def peel(objects: DataFrame, max_hops: int = 10) -> DataFrame:
    """(oid, target, kind) for objects(oid, kind, target): what each tag names once tags of tags are gone through, at most
    max_hops of them; null where it leads nowhere, to a tag still, or in a loop. Other kinds name themselves."""
    one = objects.groupBy("oid").agg(F.min(F.struct("kind", "target")).alias("o")).select("oid", "o.kind", "o.target")
    at = one.select("oid", F.col("oid").alias("target"), "kind", F.col("target").alias("next"))
    for _ in range(max_hops):
        go, done = at.filter("kind = 'tag'"), at.filter("kind <> 'tag' OR kind IS NULL")
        step = one.select(F.col("oid").alias("next"), F.col("kind").alias("k2"), F.col("target").alias("t2"))
        moved = go.join(step, "next", "left").select("oid", F.col("next").alias("target"), F.col("k2").alias("kind"), F.col("t2").alias("next"))
        at, n = _counted(done.unionByName(moved))
        if at.filter("kind = 'tag'").isEmpty():
            break
    ok = F.col("kind").isNotNull() & (F.col("kind") != "tag")
    return at.select("oid", F.when(ok, F.col("target")).alias("target"), F.when(ok, F.col("kind")).alias("kind"))


def histories(commits: DataFrame, tips: DataFrame, limit: int = 30) -> DataFrame:
    """(tip, pos, sha, ts): for each of tips(tip) the first `limit` (1 to 100) commits of the walk from it: always the one
    with the latest committer time of those whose child is out already, of equal times the one seen first; ts is the author
    time. commits(sha, parents, timestamp, committer_ts), one row per sha; tips that aren't among them have no rows.

    What is so many steps away at most is gathered for all tips at once, a hop a round, and each tip's walk is then done in
    one task over that neighbourhood, however wide it is."""
    limit = max(1, min(limit, COMMIT_MOST))
    one = commits.select("sha", "parents", F.coalesce("timestamp", F.lit(0)).alias("ts"), F.coalesce("committer_ts", F.lit(0)).alias("at"))
    links = cut(one.select(F.col("sha").alias("node"), F.explode("parents").alias("up")).filter("up IS NOT NULL").distinct())
    front, n = _counted(tips.select("tip").filter("tip IS NOT NULL").distinct().join(one.select(F.col("sha").alias("tip")), "tip", "left_semi").withColumn("node", F.col("tip")))
    parts = [front]
    for _ in range(limit - 1):
        if not n:
            break
        met = front.join(links, "node").select("tip", F.col("up").alias("node")).distinct()
        front, n = _counted(met.join(union_all(parts), ["tip", "node"], "left_anti"))
        parts.append(front)
    near = union_all(parts).join(one, F.col("node") == F.col("sha")).select("tip", "sha", "parents", "ts", "at")

    def walk(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        tip = pdf["tip"].iloc[0]
        known = {s: (list(p) if p is not None else [], t, a) for s, p, t, a in zip(pdf["sha"], pdf["parents"], pdf["ts"], pdf["at"], strict=True)}
        heap, seen, out, n = [(-known[tip][2], 0, tip)], {tip}, [], 0
        while heap and len(out) < limit:
            _, _, sha = heapq.heappop(heap)
            out.append((tip, len(out), sha, known[sha][1]))
            for p in known[sha][0]:
                if p in known and p not in seen:
                    seen.add(p)
                    n += 1
                    heapq.heappush(heap, (-known[p][2], n, p))
        return pd.DataFrame(out, columns=["tip", "pos", "sha", "ts"])

    return near.groupBy("tip").applyInPandas(walk, "tip string, pos long, sha string, ts long")


def path_history(commits: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """(sha, oid) of the commits that changed a path: what it names in their tree (null where there is nothing) is none of
    what it names in the trees of their parents; a commit without parents changed what it has. commits(sha, tree, parents),
    one row per sha, parents that aren't among them count as having nothing; entries(tree, name, oid, kind) as in
    resolve_paths(). All commits at once: the path is resolved once for each different tree."""
    roots = commits.select(F.col("tree").alias("root")).distinct().withColumn("path", F.lit(path))
    at = resolve_paths(entries, roots).select(F.col("root").alias("tree"), "oid")
    here = cut(commits.select("sha", "tree", "parents").join(at, "tree", "left").select("sha", "parents", "oid"))
    up = here.select(F.col("sha").alias("p"), F.col("oid").alias("was"))
    pairs = here.select("sha", "oid", F.explode_outer(F.filter("parents", lambda p: p.isNotNull())).alias("p")).join(up, "p", "left")
    return pairs.groupBy("sha", "oid").agg(F.bool_or(F.col("oid").eqNullSafe(F.col("was"))).alias("same")).filter("NOT same").select("sha", "oid")


def tree_diff(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, change, old, new) between trees (by, path, oid): added, removed or modified paths."""
    x = a.select(*by, "path", F.col("oid").alias("old"), F.lit(True).alias("_x"))
    y = b.select(*by, "path", F.col("oid").alias("new"), F.lit(True).alias("_y"))
    both = x.join(y, [*by, "path"], "full")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*by, "path", "change", "old", "new")


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, path, oid, conflict): per path the side that differs from base; a path that both sides changed, differently,
    is a conflict and keeps ours. Removed paths have a null oid and no row unless they conflict."""
    parts = [df.select(*by, "path", F.col("oid").alias(n), F.lit(n).alias("_s")) for df, n in ((base, "b"), (ours, "o"), (theirs, "t"))]
    rows = union_all([p.select(*by, "path", F.struct("_s", F.col(n).alias("oid")).alias("e")) for p, n in zip(parts, "bot", strict=True)])
    side = lambda n: F.max(F.when(F.col("e._s") == n, F.col("e.oid")))
    got = rows.groupBy(*by, "path").agg(side("b").alias("b"), side("o").alias("o"), side("t").alias("t"))
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    pick = F.when(o.eqNullSafe(b), t).otherwise(o)
    clash = ~o.eqNullSafe(b) & ~t.eqNullSafe(b) & ~o.eqNullSafe(t)
    return got.select(*by, "path", pick.alias("oid"), clash.alias("conflict")).filter("oid IS NOT NULL OR conflict")


def resolve_paths(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(root, path, oid, kind) for asked(root, path): descends through entries(tree, name, oid, kind) component by
    component; null where a component is missing or no tree. The empty path is the root. One join per component."""
    one = entries.groupBy("tree", "name").agg(F.min(F.struct("oid", "kind")).alias("e")).select("tree", "name", "e.oid", "e.kind")
    at = asked.select("root", "path").distinct().withColumns({"_at": F.col("root"), "_kind": F.lit("tree"), "_left": F.filter(F.split("path", "/"), lambda x: x != "")})
    parts = []
    at, n = _counted(at)
    while n:
        parts.append(at.filter("size(_left) = 0"))
        go = at.filter("size(_left) > 0").withColumns({"_name": F.col("_left")[0], "_rest": F.expr("slice(_left, 2, size(_left))"), "_tree": F.when(F.col("_kind") == "tree", F.col("_at"))})
        hit = go.join(one, (go["_tree"] == one["tree"]) & (go["_name"] == one["name"]), "left")
        at, n = _counted(hit.select("root", "path", F.col("oid").alias("_at"), F.col("kind").alias("_kind"), F.when(F.col("oid").isNull(), F.array().cast("array<string>")).otherwise(F.col("_rest")).alias("_left")))
    if not parts:
        return asked.select("root", "path", F.col("root").alias("oid"), F.lit("tree").alias("kind")).limit(0)
    return union_all(parts).select("root", "path", F.col("_at").alias("oid"), F.col("_kind").alias("kind"))


def build_trees(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, path, oid) of the folder objects of files(by, path, oid, mode): bottom up, a level of all groups at a time,
    each folder hashed from its entries in tree order; the root has the empty path. A path that is a file and a
    folder at once keeps the folder. Paths must be clean (clean_path); null paths are left out."""
    rows = files.select(*by, "path", "oid", "mode").filter("path IS NOT NULL AND path <> ''").dropDuplicates([*by, "path"])
    rows = cut(rows.withColumn("depth", F.size(F.split("path", "/"))))
    deepest = rows.agg(F.max("depth").alias("d")).collect()[0]["d"] or 0
    folders, made = None, []
    for depth in range(deepest, 0, -1):
        here = rows.filter(F.col("depth") == depth).select(*by, "path", "oid", "mode")
        if folders is not None:
            here = here.join(folders.select(*by, "path"), [*by, "path"], "left_anti").unionByName(folders.withColumn("mode", F.lit("40000")))
        parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        name = F.element_at(F.split("path", "/"), -1)
        kind = F.when(F.col("mode") == "40000", "tree").otherwise("blob")
        entry = F.concat(F.concat("mode", F.lit(" "), name).cast("binary"), F.unhex(F.lit("00")), F.unhex("oid"))
        grouped = here.select(*by, parent.alias("path"), F.struct(tree_order(kind, name).alias("k"), entry.alias("e")).alias("x")).groupBy(*by, "path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        body = F.aggregate("xs", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["e"]))
        folders = cut(grouped.select(*by, "path", object_id("tree", body).alias("oid")))
        made.append(folders)
    if not made:
        return rows.select(*by, "path", "oid").limit(0)
    return union_all(made)


def merge_decision(asked: DataFrame) -> DataFrame:
    """asked with an action for merging head into base, from booleans head_in_base, base_in_head (one is an ancestor of the
    other), may_forward, forward_only and conflict: nothing to do, move the base, refuse, conflict or a merge commit.
    Null booleans count as false."""
    c = lambda n: F.coalesce(F.col(n), F.lit(False))
    action = (
        F.when(c("head_in_base"), "up_to_date")
        .when(c("base_in_head") & c("may_forward"), "fast_forward")
        .when(~c("base_in_head") & c("forward_only"), "refused")
        .when(c("conflict"), "conflict")
        .otherwise("merge_commit")
    )
    return asked.withColumn("action", action)
