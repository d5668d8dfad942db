"""Parent-child links to whole hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerspark.shared import cut, discard, union_all

#: Links that one task resolves by itself, some 20 MB of it.
CORE = 131_072


def pack_id(c: Column) -> Column:
    """An id as bytes, without loss: 40 lower-case hex digits become 20 bytes, any other text its UTF-8 after 21 zero
    bytes (so that the two cannot meet)."""
    return F.when(c.rlike("^[0-9a-f]{40}$"), F.unhex(c)).otherwise(F.concat(F.unhex(F.lit("00" * 21)), c.cast("binary")))


def unpack_id(c: Column) -> Column:
    return F.when(F.length(c) == 20, F.lower(F.hex(c))).otherwise(F.decode(F.substring(c, 22, 2**31 - 1), "UTF-8"))


def _observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """df cut, and the counts taken in the same pass."""
    seen = Observation()
    done = cut(df.observe(seen, *[v.alias(k) for k, v in counts.items()]))
    return done, seen.get


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def _coin(k: int, c: str) -> Column:
    """A fair coin for each id and round; whoever knows the id knows the coin, without a look-up."""
    return F.xxhash64(F.lit(k), F.col(c)).bitwiseAND(F.lit(1)) == 1


def _goes(k: int) -> Column:
    """Whether a row of live(key, par, ..) is taken out in round k: its coin shows heads and its parent's tails. So no
    parent of what goes goes along, nor do its children, which are handed to its parent."""
    return _coin(k, "key") & ~_coin(k, "par")


class _Forest:
    """Contraction of live(key, par, *sums), the nodes with a parent in the table, to at most `core` of them, and back.

    Each round takes out about a quarter of what is left: an independent set of nodes, whose children are handed to the
    parent, with the sums along both links added. A loop shrinks to a node that is its own parent, which ends it. What is
    left is resolved level by level from the tops (parents that aren't live, and loops' last nodes), and so are, round by
    round, the nodes taken out: a frontier join from what is known to what hangs on it. The rounds grow with the logarithm
    of the nodes, whatever the depth; all of them together move a few times as many rows as there are nodes."""

    def __init__(self, live: DataFrame, n: int, sums: list[str], core: int, weight: str | None = None) -> None:
        self.sums, self.weight = sums, weight
        self.rounds: list[DataFrame] = []
        self.made: list[DataFrame] = []
        self.ends: list[DataFrame] = []
        self.n_ends = 0
        k = 0
        while n > core:
            stay = live.filter(~_goes(k))
            up = live.filter(_goes(k)).select(F.col("key").alias("par"), F.col("par").alias("_par"), *[F.col(c).alias(f"_{c}") for c in sums])
            moved = stay.filter(_coin(k, "par")).join(up, "par", "left")
            moved = moved.select("key", F.coalesce("_par", "par").alias("par"), *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums], *([weight] if weight else []))
            new = stay.filter(~_coin(k, "par")).unionByName(moved)
            if weight:
                taken = live.filter(_goes(k)).groupBy(F.col("par").alias("key")).agg(F.sum(weight).alias("_more"))
                new = new.join(taken, "key", "left").withColumn(weight, F.col(weight) + F.coalesce("_more", F.lit(0))).drop("_more")
            new, seen = _observed(new, n=_n(F.col("key") != F.col("par")), ends=_n(F.col("key") == F.col("par")))
            self.rounds.append(live)
            self.made.append(new)
            if seen["ends"]:
                self.n_ends += seen["ends"]
                self.ends.append(new.filter("key = par").select("key"))
            live, n, k = new.filter("key <> par"), seen["n"], k + 1
        self.live, self.n = live, n

    def settle(self) -> tuple[list[DataFrame], int]:
        """(key, top, *sums, looped) of all live nodes, in parts, and how many of them are looped: those in and below loops,
        which no level from the roots reaches."""
        out, n_looped = [], 0
        known = self._core()
        if self.ends:
            # the tables that they are few rows of needn't be read again
            self.ends = [cut(union_all(self.ends))]
            known = known.join(self.ends[0].select(F.col("key").alias("top"), F.lit(True).alias("_end")), "top", "left").withColumn("looped", F.col("looped") | F.col("_end").isNotNull()).select(*known.columns)
        known, seen = _observed(known, n=_n(F.col("looped")))
        out.append(known)
        n_looped += seen["n"]
        if self.ends:
            out.append(self.ends[0].select("key", F.col("key").alias("top"), *[F.lit(0).cast("long").alias(c) for c in self.sums], F.lit(True).alias("looped")))
            n_looped += self.n_ends
        for k in reversed(range(len(self.rounds))):
            over = union_all(out).select(F.col("key").alias("par"), "top", "looped", *[F.col(c).alias(f"_{c}") for c in self.sums])
            gone = self.rounds[k].filter(_goes(k)).join(over, "par", "left")
            new, seen = _observed(gone.select("key", F.coalesce("top", "par").alias("top"), *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in self.sums], F.coalesce("looped", F.lit(False)).alias("looped")), n=_n(F.col("looped")))
            out.append(new)
            n_looped += seen["n"]
        return out, n_looped

    def weights(self) -> DataFrame:
        """(key, size): the weight of every live node and of all below it. There must be no loops."""
        w = self.weight
        out = [cut(self._core_weights())]
        for k in reversed(range(len(self.rounds))):
            live = self.rounds[k]
            below = live.filter(~_goes(k) & _coin(k, "par")).select("key", "par").join(union_all(out), "key").groupBy(F.col("par").alias("key")).agg(F.sum("size").alias("_more"))
            out.append(cut(live.filter(_goes(k)).select("key", w).join(below, "key", "left").select("key", (F.col(w) + F.coalesce("_more", F.lit(0))).alias("size"))))
        return union_all(out)

    def _core(self) -> DataFrame:
        sums = self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = _table(batches, "key", "par", *sums)
            key, par = t.column("key").to_pylist(), t.column("par").to_pylist()
            own = [t.column(c).to_pylist() for c in sums]
            below, level = _children(key, par)
            top: list[bytes | None] = [None] * len(key)
            for i in level:
                top[i] = par[i]
            while level:
                ahead = [j for i in level for j in below.get(i, ())]
                for i in level:
                    for j in below.get(i, ()):
                        top[j] = top[i]
                        for c in own:
                            c[j] += c[i]
                level = ahead
            looped = [x is None for x in top]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array([x or k for x, k in zip(top, key, strict=True)], pa.binary()), *[pa.array(c, pa.int64()) for c in own], pa.array(looped, pa.bool_())], ["key", "top", *sums, "looped"])

        return self.live.select("key", "par", *sums).coalesce(1).mapInArrow(run, f"key binary, top binary, {', '.join(f'{c} long' for c in sums)}, looped boolean")

    def _core_weights(self) -> DataFrame:
        w = self.weight

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = _table(batches, "key", "par", w)
            key, size = t.column("key").to_pylist(), t.column(w).to_pylist()
            below, level = _children(key, t.column("par").to_pylist())
            levels = []
            while level:
                levels.append(level)
                level = [j for i in level for j in below.get(i, ())]
            for level in reversed(levels):
                for i in level:
                    size[i] += sum(size[j] for j in below.get(i, ()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(size, pa.int64())], ["key", "size"])

        return self.live.select("key", "par", w).coalesce(1).mapInArrow(run, "key binary, size long")

    def drop(self) -> None:
        """Delete the tables of the rounds; what settle() and weights() gave stays."""
        discard(*self.made)


def _table(batches: Iterator[pa.RecordBatch], *columns: str) -> pa.Table:
    found = list(batches)
    return pa.Table.from_batches(found) if found else pa.table({c: [] for c in columns})


def _children(key: list[bytes], par: list[bytes]) -> tuple[dict[int, list[int]], list[int]]:
    """Places of the children of each place, and the places whose parent isn't there."""
    at = {k: i for i, k in enumerate(key)}
    below: dict[int, list[int]] = {}
    first = []
    for i, p in enumerate(par):
        j = at.get(p)
        if j is None:
            first.append(i)
        else:
            below.setdefault(j, []).append(i)
    return below, first


def _linked(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(key, anc) of nodes, packed, one row per id."""
    links = nodes.select(F.col(id_col).alias("i"), F.col(parent_col).alias("p")).filter("i IS NOT NULL")
    return links.groupBy("i").agg(F.min("p").alias("p")).select(pack_id(F.col("i")).alias("key"), pack_id(F.col("p")).alias("anc"))


def resolve(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", core: int = CORE) -> DataFrame:
    """Root, depth and state of every node of a table of parent links: columns id, root, depth, state.

    * `tree`: the chain of parents ends in a node without a parent in the table; that is the root, depth the steps.
    * `cycle`: the node lies on a loop; root is the smallest id of the loop, depth 0.
    * `below`: the chain runs into a loop; root is the loop's smallest id, depth the steps to its first node.

    Repeated ids count once, with the smallest non-null parent; null ids are left out; a node that is its own parent
    is a loop of one. An empty table gives an empty result.

    Frontier joins from the roots, level by level, over a forest that is first contracted, as histories are far deeper than
    jobs are cheap (see _Forest); nodes that no level reaches reveal the loops. The last `core` links at most are a matter
    of one task. Every round is an equi-join with one row per key on the looked-up side; AQE splits a frontier that meets
    one hot parent. Nothing is collected but counts.
    """
    links = cut(_linked(nodes, id_col, parent_col))
    there = links.select(F.col("key").alias("anc"), F.lit(True).alias("hit"))
    start, seen = _observed(links.join(there, "anc", "left").select("key", F.when(F.col("hit"), F.col("anc")).alias("par"), F.lit(1).cast("long").alias("dist")), n=_n(F.col("par").isNotNull() & (F.col("par") != F.col("key"))), own=_n(F.col("par") == F.col("key")))
    forest = _Forest(start.filter("par <> key"), seen["n"], ["dist"], core)
    if seen["own"]:
        forest.ends.append(start.filter("par = key").select("key"))
        forest.n_ends += seen["own"]
    settled, n_looped = forest.settle()
    roots = start.filter("par IS NULL").select("key", F.col("key").alias("root"), F.lit(0).cast("long").alias("dist"), F.lit("tree").alias("state"))
    trees = union_all(settled).filter("NOT looped").select("key", F.col("top").alias("root"), "dist", F.lit("tree").alias("state"))
    out = roots.unionByName(trees)
    if n_looped:
        looped = union_all(settled).filter("looped").select("key")
        # core links at most are small enough for every task, too
        mine = start.join(F.broadcast(looped) if n_looped <= core else looped, "key", "left_semi")
        mine = cut(mine.select("key", F.col("par").alias("anc")))
        out = out.unionByName(_looped(mine) if n_looped <= core else _looped_far(mine))
    forest.drop()
    discard(links)
    return _named(out, id_col)


def _looped(links: DataFrame) -> DataFrame:
    """(key, root, dist, state) of links(key, anc) that never leave the table, in one task: walks from each node meet what is
    known or close a loop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches, "key", "anc")
        up = dict(zip(t.column("key").to_pylist(), t.column("anc").to_pylist(), strict=True))
        known: dict[bytes, tuple[bytes, int, str]] = {}
        for k in up:
            way, seen = [], {}
            while k not in known and k not in seen:
                seen[k] = len(way)
                way.append(k)
                k = up[k]
            if k not in known:
                loop = way[seen[k] :]
                known.update((x, (min(loop), 0, "cycle")) for x in loop)
                way = way[: seen[k]]
            root, dist, _ = known[k]
            for x in reversed(way):
                dist += 1
                known[x] = (root, dist, "below")
        cols = [list(known), *map(list, zip(*known.values(), strict=True))] if known else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "root", "dist", "state"])

    return links.coalesce(1).mapInArrow(run, "key binary, root binary, dist long, state string")


def _looped_far(mine: DataFrame) -> DataFrame:
    """The same by joins, for more links than one task should hold: the loops by doubling, then frontier joins onto them."""
    loops, made = _loops(mine)
    off, seen = _observed(mine.join(loops.select("key"), "key", "left_anti").select("key", F.col("anc").alias("par"), F.lit(1).cast("long").alias("dist")), n=F.count(F.lit(1)))
    forest = _Forest(off, seen["n"], ["dist"], CORE)
    settled, _ = forest.settle()
    of = loops.select(F.col("key").alias("top"), "root")
    low = union_all(settled).join(of, "top").select("key", "root", "dist", F.lit("below").alias("state"))
    discard(*made)
    forest.drop()
    return loops.select("key", "root", F.lit(0).cast("long").alias("dist"), F.lit("cycle").alias("state")).unionByName(low)


def _loops(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes on loops with the smallest id of their loop (key, root), of links(key, anc) that never leave the
    table. After 2^k steps every node has come to one of a shrinking set of nodes; once that set stops shrinking it is
    the loops, and once the smallest id seen on the way stops changing it has been all the way round."""
    at = links.select("key", "anc", F.col("key").alias("low"))
    images, made = -1, []
    while True:
        step = at.select(F.col("key").alias("anc"), F.col("anc").alias("up"), F.col("low").alias("ahead"))
        new, seen = _observed(
            at.join(step, "anc").select("key", F.col("up").alias("anc"), F.least("low", "ahead").alias("low"), (F.col("ahead") < F.col("low")).alias("moved")),
            n=_n(F.col("moved")),
        )
        now = new.select("anc").distinct().count()
        made.append(new)
        at = new.drop("moved")
        if now == images and not seen["n"]:
            break
        images = now
    loops = cut(at.join(at.select(F.col("anc").alias("key")).distinct(), "key", "left_semi").select("key", F.col("low").alias("root")))
    return loops, made


def _named(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(unpack_id(F.col("key")).alias(id_col), unpack_id(F.col("root")).alias("root"), F.col("dist").alias("depth"), "state")


def ancestor_pairs(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", max_depth: int = 64) -> DataFrame:
    """Every (ancestor, id, steps) of a forest, steps from 0 (the node itself): the descendants of a node are the rows
    that have it as ancestor. The rows are as many as all path lengths together, so this is for shallow hierarchies;
    deeper than max_depth raises ValueError (loops do too, see resolve()). Level by level: the frontier of each level
    is the pairs found last, joined with the parents of their ancestors."""
    links = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("p")).filter("id IS NOT NULL").groupBy("id").agg(F.min("p").alias("p"))
    ups = links.join(links.select(F.col("id").alias("p")), "p", "left_semi").select(F.col("id").alias("ancestor"), F.col("p").alias("up"))
    level = cut(links.select(F.col("id").alias("ancestor"), "id", F.lit(0).cast("long").alias("steps")))
    parts = [level]
    for k in range(1, max_depth + 2):
        level, seen = _observed(level.join(ups, "ancestor").select(F.col("up").alias("ancestor"), "id", F.lit(k).cast("long").alias("steps")), n=F.count(F.lit(1)))
        if not seen["n"]:
            return union_all(parts)
        parts.append(level)
    raise ValueError(f"deeper than {max_depth}, or a loop")


def paths(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", sep: str = "/", max_depth: int = 64) -> DataFrame:
    """Full path from the root, depth and root of every node of a shallow forest: id, root, depth, path. Level-wise
    from the roots down; nodes that no level reaches (loops and what hangs below) have a null path, root and depth."""
    links = nodes.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("p")).filter("id IS NOT NULL").groupBy("id").agg(F.min("p").alias("p"))
    links = cut(links)
    here = links.select(F.col("id").alias("p"))
    level = cut(links.join(here, "p", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.col("id").alias("path")))
    parts = [level]
    for _ in range(max_depth + 1):
        up = level.select(F.col("id").alias("p"), "root", "depth", "path")
        level, seen = _observed(links.join(up, "p").select("id", "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit(sep), "id").alias("path")), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        parts.append(level)
    else:
        raise ValueError(f"deeper than {max_depth}")
    return links.select("id").join(union_all(parts), "id", "left")


def lineage(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", buckets: int = 4096, core: int = CORE) -> DataFrame:
    """The chains of parents and the descendants of all nodes, of any depth, in one row per node: id, parent, root,
    state, steps, pos, size, loop; chains() and descendants() read them.

    root and state are resolve()'s. Every loop is cut above its root, which leaves trees; steps is the way to the root,
    pos the place in a walk of the tree in which each node is followed by its size - 1 descendants. On a loop, loop is
    its length, elsewhere 0. So `a` is on the chain of `v` if they share the root and a.loop > 0 or
    a.pos <= v.pos < a.pos + a.size.

    Sizes and places come from contracting the trees and going back (see _Forest). Children of one node are added up in
    buckets, so that a node with very many is many tasks."""
    links = nodes.select(F.col(id_col).alias("i"), F.col(parent_col).alias("p")).filter("i IS NOT NULL").groupBy("i").agg(F.min("p").alias("p"))
    links = cut(links)
    of = resolve(links, "i", "p", core)
    mine = links.join(of, "i").select(pack_id(F.col("i")).alias("key"), pack_id(F.col("p")).alias("parent"), pack_id(F.col("root")).alias("root"), "state", "depth")
    mine = cut(mine.withColumn("up", F.when((F.col("key") != F.col("root")), F.col("parent"))))
    sized = _sizes(mine.select("key", "up"), core)
    placed = mine.select("key", "up").join(sized.select("key", "size"), "key")
    placed = cut(placed.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(buckets))))
    under = placed.filter("up IS NOT NULL")
    before = (Window.unboundedPreceding, -1)
    carry = under.groupBy("up", "_b").agg(F.sum("size").alias("_s"))
    carry = carry.select("up", "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("up").orderBy("_b").rowsBetween(*before)), F.lit(0)).alias("_c"))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("up", "_b").orderBy("key").rowsBetween(*before)), F.lit(0))
    start = under.withColumn("_o", own).join(carry, ["up", "_b"]).select("key", F.col("up").alias("par"), (F.col("_o") + F.col("_c") + 1).alias("pos"), F.lit(1).cast("long").alias("steps"))
    tops = placed.filter("up IS NULL").select("key", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("steps"))
    at = _places(start, tops, core)
    loops = mine.filter("state = 'cycle'")
    n = loops.join(loops.groupBy("root").agg(F.count(F.lit(1)).alias("loop")), "root").select("key", "loop")
    # every node is placed, with its size, once
    out = mine.join(at.join(placed.select("key", "size"), "key"), "key").join(n, "key", "left")
    return out.select(unpack_id(F.col("key")).alias(id_col), unpack_id(F.col("parent")).alias(parent_col), unpack_id(F.col("root")).alias("root"), "state", "steps", "pos", "size", F.coalesce("loop", F.lit(0)).alias("loop"))


def _sizes(at: DataFrame, core: int) -> DataFrame:
    """(key, size), the nodes of each node's tree, of a forest at(key, up)."""
    live, seen = _observed(at.filter("up IS NOT NULL").select("key", F.col("up").alias("par"), F.lit(1).cast("long").alias("w")), n=F.count(F.lit(1)))
    forest = _Forest(live, seen["n"], [], core, weight="w")
    below = forest.weights()
    forest.drop()
    tops = at.filter("up IS NULL").select("key")
    under = at.select("key", F.col("up").alias("top")).join(tops.withColumnRenamed("key", "top"), "top", "left_semi").join(below, "key").groupBy(F.col("top").alias("key")).agg(F.sum("size").alias("_more"))
    return below.unionByName(tops.join(under, "key", "left").select("key", (F.lit(1) + F.coalesce("_more", F.lit(0))).alias("size")))


def _places(start: DataFrame, tops: DataFrame, core: int) -> DataFrame:
    """(key, pos, steps) from the root, of start(key, par, pos, steps), where they count from the parent's, and tops."""
    live, seen = _observed(start, n=F.count(F.lit(1)))
    forest = _Forest(live, seen["n"], ["pos", "steps"], core)
    settled, _ = forest.settle()
    forest.drop()
    return union_all(settled).select("key", "pos", "steps").unionByName(tops)


def _blocks(lo: Column, hi: Column, levels: Column) -> Column:
    """The aligned blocks (level, number) of 2^level places that make up [lo, hi)."""

    def at(k: Column) -> Column:
        # ceiling and floor of the ends in blocks of this level
        width = F.pow(F.lit(2), k).cast("long")
        a, b = F.floor((lo + width - 1) / width).cast("long"), F.floor(hi / width).cast("long")
        some = a < b
        return F.array(F.when(some & (a % 2 == 1), F.struct(k.alias("level"), a.alias("block"))), F.when(some & (b % 2 == 1), F.struct(k.alias("level"), (b - 1).alias("block"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), levels), at)))


def intervals(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(ancestor, root, steps, level, block): the interval of each node of lineage()'s rows, in aligned blocks."""
    at = F.explode(_blocks(F.col("pos"), F.col("pos") + F.col("size"), F.ceil(F.log2(F.col("size"))) + 1))
    return rows.select(F.col(id_col).alias("ancestor"), "root", "steps", at.alias("_b")).select("ancestor", "root", "steps", F.col("_b.level").alias("level"), F.col("_b.block").alias("block"))


def _bits(rows: DataFrame) -> int:
    return int(rows.agg(F.coalesce(F.max("size"), F.lit(1)).alias("n")).collect()[0]["n"]).bit_length()


def _in_blocks(rows: DataFrame, bits: int) -> DataFrame:
    """rows(.., pos) with a row for each block that the place lies in."""
    level = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bits).cast("long")))
    return rows.withColumn("level", level).withColumn("block", F.floor(F.col("pos") / F.pow(F.lit(2), F.col("level"))).cast("long"))


def above(rows: DataFrame, spans: DataFrame, of: DataFrame, id_col: str = "id") -> DataFrame:
    """The nodes in of(id) and all on their chains, each once; spans are intervals() of the same rows."""
    asked = rows.join(of.select(id_col).distinct(), id_col, "left_semi")
    blocks = _in_blocks(asked.select("root", "pos"), _bits(rows)).select("root", "level", "block").distinct()
    round_ = rows.filter("loop > 0").join(asked.select("root").distinct(), "root", "left_semi").select(id_col)
    return spans.join(blocks, ["root", "level", "block"], "left_semi").select(F.col("ancestor").alias(id_col)).unionByName(round_).distinct()


def _related(rows: DataFrame, of: DataFrame, id_col: str, up: bool) -> DataFrame:
    """Ancestors' intervals meet descendants' places by equi-joins on aligned blocks: an interval is at most two blocks of
    each size, a place lies in one block of each, and no pair meets twice or in vain."""
    asked = rows.join(of.select(id_col).distinct(), id_col, "left_semi")
    a, v = (rows, asked) if up else (asked, rows)
    v = v.select(id_col, "root", "pos", F.col("steps").alias("_v"))
    spans = intervals(a, id_col)
    within = spans.join(_in_blocks(v, _bits(rows)), ["root", "level", "block"]).select("ancestor", id_col, (F.col("_v") - F.col("steps")).alias("steps"))
    # a node of a loop is above all of its component: what is beyond its interval comes round to it
    loops = a.filter("loop > 0").select(F.col(id_col).alias("ancestor"), "root", F.col("pos").alias("_p"), "size", F.col("steps").alias("_s"), "loop")
    inside = (F.col("pos") >= F.col("_p")) & (F.col("pos") < F.col("_p") + F.col("size"))
    round_ = loops.join(v, "root").filter(~inside).select("ancestor", id_col, (F.col("_v") + F.col("loop") - F.col("_s")).alias("steps"))
    return within.unionByName(round_)


def chains(rows: DataFrame, of: DataFrame, id_col: str = "id") -> DataFrame:
    """(ancestor, id, steps), from 0 (the node itself), of the nodes in of(id), whose full paths these are by steps; rows
    is lineage()'s. A chain that runs into a loop goes round it once."""
    return _related(rows, of, id_col, True)


def descendants(rows: DataFrame, of: DataFrame, id_col: str = "id") -> DataFrame:
    """(ancestor, id, steps) of all nodes below those in of(id), and of these themselves at 0 steps; rows is lineage()'s."""
    return _related(rows, of, id_col, False)
