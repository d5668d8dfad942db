"""Queries of the graph operators, over the commits with all their parents where a graph with merges is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.scalars import object_id
from ledgerspark.keys import clean_key, clean_key_sql
from ledgerspark.operators import graph as G
from ledgerspark.operators import hierarchy
from ledgerspark.plans.metadata import refs_of
from ledgerspark.plans.registry import Registry, table

R = Registry()
K = clean_key_sql
#: Every parent of every commit, and the commits that refs name.
_EDGES = f"(select distinct src, dst from (select {K('sha')} src, unnest(list_transform(parents, lambda x: {K('x')})) dst from commits) where src is not null and dst is not null)"
_TIPS = f"(select distinct {K('target')} node from {{}} where {K('target')} is not null)"


def _reach(table_name: str) -> str:
    return f"(with recursive e as {_EDGES}, r(node) as (select node from {_TIPS.format(table_name)} union select e.dst from r join e on e.src = r.node) select node from r)"


def _hops(n: int) -> str:
    return f"with recursive e as {_EDGES}, r(node, hops) as (select node, 0 from {_TIPS.format('refs')} union select e.dst, hops + 1 from r join e on e.src = r.node where hops < {n}) select node, min(hops)::int as hops from r group by 1"


def commit_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select(clean_key("sha").alias("src"), F.explode(F.transform("parents", clean_key)).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def tips(spark: SparkSession, d: str, name: str = "refs") -> DataFrame:
    return table(spark, d, name).select(clean_key("target").alias("node")).filter("node IS NOT NULL").distinct()


def commits_of(spark: SparkSession, d: str) -> DataFrame:
    """One row per commit: cleaned sha and parents, of repeated rows the largest."""
    parents = F.filter(F.transform("parents", clean_key), lambda p: p.isNotNull())
    rows = table(spark, d, "commits").select(clean_key("sha").alias("sha"), F.struct(parents.alias("parents"), "timestamp", "committer_ts", "tree").alias("c")).filter("sha IS NOT NULL")
    return rows.groupBy("sha").agg(F.max("c").alias("c")).select("sha", "c.*")


@R.add("g1_history")
def g1(spark: SparkSession, d: str) -> DataFrame:
    """The 30 commits before the tip of every branch."""
    heads = table(spark, d, "refs").filter(F.col("name").startswith("refs/heads/")).select(clean_key("target").alias("tip"))
    return G.histories(commits_of(spark, d), heads, 30)


@R.add(
    "g2_path_history",
    f"""with c as (select {K('sha')} sha, max(substr(tree, 1, 1)) oid, max(list_filter(list_transform(parents, lambda x: {K('x')}), lambda x: x is not null)) ps from commits where {K('sha')} is not null group by 1),
    p as (select sha, unnest(ps) p from c), s as (select distinct p.sha from p join c using (sha) left join c u on u.sha = p.p where u.oid is not distinct from c.oid)
    select c.sha, c.oid from c where c.sha not in (select sha from s) and not (c.oid is null and coalesce(len(c.ps), 0) = 0)""",
)
def g2(spark: SparkSession, d: str) -> DataFrame:
    """Commits that changed src/main, which each tree is taken to have with the first digit of its id for content."""
    c = commits_of(spark, d)
    t = c.select("tree").filter("tree IS NOT NULL").distinct()
    top = t.select("tree", F.lit("src").alias("name"), F.concat(F.lit("d"), "tree").alias("oid"), F.lit("tree").alias("kind"))
    low = t.select(F.concat(F.lit("d"), "tree").alias("tree"), F.lit("main").alias("name"), F.substring("tree", 1, 1).alias("oid"), F.lit("blob").alias("kind"))
    return G.path_history(c, top.unionByName(low), "src/main")


@R.add("g3_closure", f"select node from {_reach('refs')}")
def g3(spark: SparkSession, d: str) -> DataFrame:
    """All that the refs reach, through all parents."""
    return G.reachable(commit_edges(spark, d), tips(spark, d))


@R.add("g4_reachable_difference", f"select node from {_reach('refs')} where node not in (select node from {_reach('refs_mirror')})")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return G.reachable_difference(commit_edges(spark, d), tips(spark, d), tips(spark, d, "refs_mirror"))


@R.add(
    "g5_chain",
    "with recursive r(start, node, hop) as (select p_partkey, p_partkey, 0 from part union all select r.start, r.node - 7, hop + 1 from r where hop < 16 and r.node - 7 >= 1) select start, node, hop from r",
)
def g5(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    links = p.filter("p_partkey > 7").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 7).alias("dst"))
    return G.chains(links, p.select(F.col("p_partkey").alias("node")), 16)


@R.add("g6_bounded_hops", _hops(4))
def g6(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(commit_edges(spark, d), tips(spark, d), within=4)


@R.add("g7_shallow", _hops(1))
def g7(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(commit_edges(spark, d), tips(spark, d), within=1)


_R = "(select lower(trim(repo_id)) repo_id, name path, max(nullif(nullif(lower(trim(target)), ''), repeat('0', 40))) oid from {t} group by 1, 2)"


@R.add(
    "g8_tree_diff",
    f"""select coalesce(a.repo_id, b.repo_id) repo_id, coalesce(a.path, b.path) path, case when a.path is null then 'added' when b.path is null then 'removed' else 'modified' end change, a.oid as old, b.oid as new
    from {_R.format(t='refs')} a full outer join {_R.format(t='refs_mirror')} b on a.repo_id = b.repo_id and a.path = b.path where a.path is null or b.path is null or a.oid is distinct from b.oid""",
)
def g8(spark: SparkSession, d: str) -> DataFrame:
    a, b = (refs_of(spark, d, t).withColumnsRenamed({"name": "path", "target": "oid"}) for t in ("refs", "refs_mirror"))
    return G.tree_diff(a, b, ["repo_id"])


_ENTRIES = """(select 'root' tree, r_name as name, 'r' || r_regionkey oid, 'tree' kind from region union all select 'r' || n_regionkey, n_name, 'n' || n_nationkey, 'tree' from nation
  union all select 'n' || c_nationkey, c_name, 'c' || c_custkey, 'blob' from customer)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = t("region").select(F.lit("root").alias("tree"), F.col("r_name").alias("name"), key("r", "r_regionkey").alias("oid"), F.lit("tree").alias("kind"))
    b = t("nation").select(key("r", "n_regionkey").alias("tree"), F.col("n_name").alias("name"), key("n", "n_nationkey").alias("oid"), F.lit("tree").alias("kind"))
    c = t("customer").select(key("n", "c_nationkey").alias("tree"), F.col("c_name").alias("name"), key("c", "c_custkey").alias("oid"), F.lit("blob").alias("kind"))
    return a.union(b).union(c)


_ASKED = """(select 'root' root, r_name || '/' || n_name || '/' || c_name as path from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
  union select 'root', n_name from nation union select 'root', r_name from region)"""


@R.add(
    "g9_path_resolution",
    f"""select a.root, a.path, coalesce(c.oid, r.oid) as oid, coalesce(c.kind, r.kind) as kind from {_ASKED} a
    left join {_ENTRIES} r on r.tree = 'root' and r.name = string_split(a.path, '/')[1] and len(string_split(a.path, '/')) = 1
    left join {_ENTRIES} x on x.tree = 'root' and x.name = string_split(a.path, '/')[1] left join {_ENTRIES} n on n.tree = x.oid and n.name = string_split(a.path, '/')[2]
    left join {_ENTRIES} c on c.tree = n.oid and c.name = string_split(a.path, '/')[3]""",
)
def g9(spark: SparkSession, d: str) -> DataFrame:
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    full = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))
    asked = full.union(n.select("n_name")).union(r.select("r_name")).distinct().select(F.lit("root").alias("root"), "path")
    return G.resolve_paths(_entries(spark, d), asked)


_NODES = """(select 'root' id, null::varchar p union all select 'r' || r_regionkey, 'root' from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'o' || o_orderkey, 'c' || o_custkey from orders)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    top = spark.createDataFrame([("root", None)], "id string, parent string")
    r = table(spark, d, "region").select(key("r", "r_regionkey"), F.lit("root"))
    n = table(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))
    c = table(spark, d, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"))
    o = table(spark, d, "orders").select(key("o", "o_orderkey"), key("c", "o_custkey"))
    return top.union(r).union(n).union(c).union(o)


@R.add(
    "g10_tree_listing",
    f"with recursive t(id, depth, path) as (select id, 0::bigint, id from {_NODES} where p is null union all select c.id, depth + 1, path || '/' || c.id from t join {_NODES} c on c.p = t.id) select id, 'root' as root, depth, path from t",
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_nodes(spark, d))


@R.add(
    "g10_descendants",
    f"with recursive t(ancestor, id) as (select id, id from {_NODES} union all select c.p, t.id from t join {_NODES} c on c.id = t.ancestor where c.p is not null) select ancestor, count(*) - 1 as n from t group by 1",
)
def g10_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestor_pairs(_nodes(spark, d)).groupBy("ancestor").agg((F.count(F.lit(1)) - 1).alias("n"))


@R.add(
    "g11_peel",
    """with recursive t(oid, cur, hops) as (select p_partkey, p_partkey, 0 from part union all select oid, cur - 1, hops + 1 from t where cur % 12 <> 0 and hops < 10 and cur > 0)
    select oid, case when m % 12 = 0 then m end as target, case when m % 12 = 0 then 'commit' end as kind from (select oid, min(cur) m from t group by 1)""",
)
def g11(spark: SparkSession, d: str) -> DataFrame:
    """Tags of tags: every twelfth part is a commit, the others are tags of the part before them."""
    p = table(spark, d, "part")
    commit = F.col("p_partkey") % 12 == 0
    return G.peel(p.select(F.col("p_partkey").alias("oid"), F.when(commit, "commit").otherwise("tag").alias("kind"), F.when(~commit, F.col("p_partkey") - 1).alias("target")))


@R.add("g13_is_ancestor", f"select distinct {K('sha')} sha, {K('sha')} in (select node from {_reach('refs')}) as ok from commits where {K('sha')} is not null")
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Which commits are some ref's target or lie before one."""
    up = G.reachable(commit_edges(spark, d), tips(spark, d)).select(F.col("node").alias("sha"), F.lit(True).alias("hit"))
    return table(spark, d, "commits").select(clean_key("sha").alias("sha")).filter("sha IS NOT NULL").distinct().join(up, "sha", "left").select("sha", F.coalesce("hit", F.lit(False)).alias("ok"))


_P3 = {"b": "p_size", "o": "case when p_partkey % 5 = 0 then p_size + 1 else p_size end", "t": "case when p_partkey % 7 = 0 then p_size + 2 when p_partkey % 10 = 0 then p_size + 1 else p_size end"}


@R.add(
    "g15_merge3",
    f"""with x as (select p_partkey, case when p_partkey % 13 <> 0 then {_P3['b']} end b, case when p_partkey % 11 <> 0 then {_P3['o']} end o, case when p_partkey % 17 <> 0 then {_P3['t']} end t from part)
    select p_partkey::varchar as path, case when o is not distinct from b then t else o end as oid, o is distinct from b and t is distinct from b and o is distinct from t as conflict from x
    where (case when o is not distinct from b then t else o end) is not null or (o is distinct from b and t is distinct from b and o is distinct from t)""",
)
def g15(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    path = k.cast("string").alias("path")
    base = p.filter(k % 13 != 0).select(path, s.alias("oid"))
    ours = p.filter(k % 11 != 0).select(path, F.when(k % 5 == 0, s + 1).otherwise(s).alias("oid"))
    theirs = p.filter(k % 17 != 0).select(path, F.when(k % 7 == 0, s + 2).when(k % 10 == 0, s + 1).otherwise(s).alias("oid"))
    return G.merge3(base, ours, theirs)


def _tree_sql(levels: int) -> str:
    """Folder ids from the deepest level up: t<k> are the folders at depth k."""
    out = [f"f as (select repo_id, name path, target oid, len(string_split(name, '/')) depth from (select {K('repo_id')} repo_id, name, max({K('target')}) target from refs group by 1, 2) where regexp_full_match(target, '[0-9a-f]{{40}}') and name <> '')"]
    for k in range(levels, 0, -1):
        files = f"select repo_id, path, oid, '100644' as mode from f where depth = {k}"
        if k < levels:
            here = f"select * from ({files}) x where not exists (select 1 from t{k} where t{k}.repo_id is not distinct from x.repo_id and t{k}.path = x.path) union all select repo_id, path, oid, '40000' from t{k}"
        else:
            here = files
        out.append(f"""t{k - 1} as (select repo_id, path, sha1(encode('tree ' || octet_length(body)) || '\\x00'::blob || body) oid from (select repo_id, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end path,
          unhex(string_agg(hex(encode(mode || ' ' || string_split(path, '/')[-1])) || '00' || oid, '' order by encode(string_split(path, '/')[-1] || case when mode = '40000' then '/' else '' end))) body from ({here}) group by all))""")
    return "with " + ", ".join(out) + " " + " union all ".join(f"select repo_id, path, oid from t{k}" for k in range(levels))


@R.add("g16_tree_build", _tree_sql(12))
def g16(spark: SparkSession, d: str) -> DataFrame:
    """The refs of every repo as a tree of folders, each ref a file of its target's id."""
    refs = refs_of(spark, d).filter("target RLIKE '^[0-9a-f]{40}$'")
    return G.build_trees(refs.select("repo_id", F.col("name").alias("path"), F.col("target").alias("oid"), F.lit("100644").alias("mode")), ["repo_id"])


_BODY = "'tree ' || tree || chr(10) || 'author ' || author || ' <' || email || '> ' || \"timestamp\" || ' +0000' || chr(10) || chr(10) || replace(message, chr(0), '') || chr(10)"


@R.add("g17_commit_id", f"select sha, sha1(('commit ' || octet_length(encode(b)))::blob || '\\x00'::blob || encode(b)) as oid from (select sha, {_BODY} b from commits)")
def g17(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits")
    body = F.concat(F.lit("tree "), "tree", F.lit("\nauthor "), "author", F.lit(" <"), "email", F.lit("> "), F.col("timestamp").cast("string"), F.lit(" +0000\n\n"), F.replace("message", F.lit("\x00"), F.lit("")), F.lit("\n"))
    return c.select("sha", object_id("commit", body).alias("oid"))


@R.add("g19_swap_coverage", f"select node from {_reach('refs')} where node not in (select {K('sha')} from commits where {K('sha')} is not null)")
def g19(spark: SparkSession, d: str) -> DataFrame:
    """What the refs need that a pack of all commits of the table would lack."""
    kept = table(spark, d, "commits").select(clean_key("sha").alias("node")).filter("node IS NOT NULL")
    return G.dangling(commit_edges(spark, d), kept, tips(spark, d))
