"""Evaluation texts that leaked into a corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.markup import plain, raw_words, segments, spell, words
from ledgerspark.shared import union_all

#: Characters of items that one automaton takes; more items are taken in blocks, and a document meets just those blocks
#: of which it has a seed.
BLOCK_CHARS = 2_000_000
#: Characters of items that one pass over the corpus takes (they and their seeds, 10 bytes a word, are broadcast).
PASS_CHARS = 64_000_000
#: Tasks that the documents of one block are spread over.
SPREAD = 32
_OPENING = r"^\s*[^.!?。]*[.!?。]+"


class Automaton:
    """Generalised suffix automaton over sequences of word ids: every run of words of any item is a way from the
    start. Items are set apart by a word of their own, so no run spans two of them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Place in `self.words` that each state stands for, or -1 (clones).
        self.end = [-1]
        self.words: list[int] = []
        self.last = 0

    def add(self, w: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        self.end.append(len(self.words))
        self.words.append(w)
        p = self.last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                c = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.end.append(-1)
                link[q] = link[cur] = c
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = c
                    p = link[p]
        self.last = cur

    def close(self) -> None:
        """After the last add: the states below each one in the tree of links."""
        self.below: list[list[int]] = [[] for _ in self.next]
        for s in range(1, len(self.next)):
            self.below[self.link[s]].append(s)

    def ends(self, s: int) -> Iterator[int]:
        """All places where the runs of state s end."""
        todo = [s]
        while todo:
            s = todo.pop()
            if self.end[s] >= 0:
                yield self.end[s]
            todo += self.below[s]

    def stream(self, ids: Iterable[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(place in the text, state, length) of the longest run of items that ends at each place, if least long."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for j, w in enumerate(ids):
            if w < 0:
                s = n = 0
                continue
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(w)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            if n >= least:
                yield j, s, n


class WordIds(dict):
    """Raw words to ids: -1 for words that no item has, -2 for what is no word. Memoised; when full it starts anew."""

    def __init__(self, vocab: dict[str, int], most: int = 1 << 18) -> None:
        super().__init__()
        self.vocab, self.most = vocab, most

    def __missing__(self, raw: str) -> int:
        w = spell(raw)
        i = self.vocab.get(w, -1) if w else -2
        if len(self) >= self.most:
            self.clear()
        self[raw] = i
        return i


class Items:
    """Items as word ids, with their automaton. texts: (item id, text) pairs, without shared openings."""

    def __init__(self, texts: list[tuple[object, str | None]]) -> None:
        self.vocab: dict[str, int] = {}
        self.sam = Automaton()
        self.item: list[int] = []
        self.start: list[int] = []
        self.keys: list[object] = []
        self.size: list[int] = []
        self.words_of: list[set[int]] = []
        for i, (key, text) in enumerate(texts):
            ws = [self.vocab.setdefault(w, len(self.vocab)) for w, _, _ in words(plain(text or ""))]
            self.keys.append(key)
            self.start.append(len(self.item))
            self.size.append(len(ws))
            self.words_of.append(set(ws))
            for w in ws:
                self.sam.add(w)
            self.sam.add(-2 - i)
            self.item += [i] * (len(ws) + 1)
        self.sam.close()
        self.ids_of = WordIds(self.vocab)


def _reach(a: list[int], b: list[int], most: int) -> list[tuple[int, int]]:
    """reach[e]: how many words of a can be gone through, up to a match, along some beginning of b with at most e
    words changed, added or lost, and the length of that beginning (the furthest points of the diagonals, edit by
    edit). (0, 0) if no match is reached."""
    na, nb = len(a), len(b)
    at = {0: 0}
    out, best = [], (0, 0)
    for e in range(most + 1):
        if e:
            new: dict[int, int] = {}
            for d, i in at.items():  # d: place in b less place in a
                for nd, ni in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                    if ni <= na and 0 <= ni + nd <= nb and new.get(nd, -1) < ni:
                        new[nd] = ni
            at = new
        for d, i in at.items():
            k = i
            while k < na and k + d < nb and a[k] == b[k + d]:
                k += 1
            if k > i:
                at[d] = k
                if k > best[0]:
                    best = (k, k + d)
        out.append(best)
    return out


def _may_hold(ids: list[int], start: int, end: int, mine: set[int], least: int, one_in: int) -> bool:
    """Whether words around the seed ids[start:end] can be a stretch at all: of e edits in n words, e <= n / one_in, at
    most e words of the text are none of the item's, and at least n - e are; so weighing the former one_in - 1 times
    the sum isn't negative, and least less its edits are in. An upper bound for each side, not for both at once."""
    worse, need, span = one_in - 1, least - least // one_in, 2 * least + 2 * least // one_in

    def side(seq: list[int]) -> list[tuple[int, int]]:
        points, s, c = [(0, 0)], 0, 0
        for w in seq:
            if w in mine:
                s, c = s + 1, c + 1
                points.append((s, c))
            else:
                s -= worse
                if s < -2 * span:
                    break
        return points

    left, right = side(ids[max(0, start - span) : start][::-1]), side(ids[end : end + span])
    seed = end - start
    most = [max(s for s, _ in x) for x in (left, right)]
    most_in = [max(c for s, c in x if s >= -(seed + other)) for x, other in ((left, most[1]), (right, most[0]))]
    return seed + sum(most_in) >= need


def seed_words(least: int, one_in: int) -> int:
    """Of least words or more with every one_in-th changed, some run of so many stays whole."""
    return -(-(least - least // one_in) // (least // one_in + 1))


class Seeds:
    """Which blocks have an item with any run of n words of a text: sorted hashes of the runs, with their blocks. Equal hashes
    of unequal runs cost a needless look, nothing else."""

    def __init__(self, blocks: list[list[tuple[object, str | None]]], n: int) -> None:
        self.n = n
        self.memo: dict[str, int] = {}
        got = [(b, self._runs(plain(t or ""))) for b, items in enumerate(blocks) for _, t in items]
        runs = np.concatenate([r for _, r in got] or [np.zeros(0, np.uint64)])
        of = np.repeat(np.array([b for b, _ in got], np.int32), [len(r) for _, r in got])
        order = np.lexsort((of, runs))
        runs, of = runs[order], of[order]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
        self.runs, self.of = runs[new], of[new]

    def _word(self, raw: str) -> int:
        w = spell(raw)
        h = xxhash.xxh64_intdigest(w) | 1 if w else 0
        if len(self.memo) >= 1 << 18:
            self.memo.clear()
        self.memo[raw] = h
        return h

    def _runs(self, text: str) -> np.ndarray:
        memo, word = self.memo, self._word
        h = np.array([h for w in raw_words(text) if (h := memo[w] if w in memo else word(w))], np.uint64)
        if len(h) < self.n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(31)
        return out

    def blocks(self, text: str) -> list[int]:
        hit: set[int] = set()
        for _, seg in segments(text):
            r = self._runs(seg)
            if len(r):
                lo, hi = np.searchsorted(self.runs, r, "left"), np.searchsorted(self.runs, r, "right")
                for a, b in zip(lo[lo < hi], hi[lo < hi], strict=True):
                    hit.update(self.of[a:b].tolist())
        return sorted(hit)


def find_spans(items: Items, text: str, least: int, one_in: int) -> list[tuple[object, int, int, int, int]]:
    """(item, start, end, words, edits) of stretches of items in a text, places in characters. The running text and what is
    aside of it (see markup) are gone through one by one."""
    # so many words of the text at least are in a stretch, each of a character, with one between
    shortest = 2 * (least - least // one_in) - 1
    out = []
    for base, seg in segments(text):
        if len(seg) >= shortest:
            out += [(key, base + a, base + b, n, e) for key, a, b, n, e in _spans(items, seg, least, one_in)]
    return out


def _spans(items: Items, text: str, least: int, one_in: int) -> list[tuple[object, int, int, int, int]]:
    """find_spans() of one text without markup."""
    ids_of = items.ids_of
    ids = [ids_of[w] for w in raw_words(text)]
    if -2 in ids:
        ids = [i for i in ids if i != -2]
    # stretches of twice the length have a half that is one as well, so that many edits need be tried
    seed = seed_words(least, one_in)
    most = (2 * least - 1) // one_in
    sam, out = items.sam, []
    # runs of words on one diagonal: place in the text and the items of the first seed, and the last place in the text
    seeds: dict[int, list[list[int]]] = {}
    last: dict[tuple[int, int], list[int]] = {}
    for j, s, n in sam.stream(ids, seed):
        while s and sam.length[s] >= seed or n >= seed and s:
            for end in sam.ends(s):
                diagonal = (items.item[end], end - j)
                run = last.get(diagonal)
                if run is None or run[2] < j - 1:
                    run = last[diagonal] = [j, end, j]
                    seeds.setdefault(items.item[end], []).append(run)
                run[2] = j
            s = sam.link[s]
            n = sam.length[s] if s >= 0 else 0
            if n < seed:
                break
    found = words(text) if seeds else []
    span = 2 * least + most
    for i, places in seeds.items():
        lo, hi = items.start[i], items.start[i] + items.size[i]
        done: list[tuple[int, int]] = []
        for j, end, until in places:
            if any(a <= j and until <= b for a, b in done) or not _may_hold(ids, j + 1 - seed, j + 1, items.words_of[i], least, one_in):
                continue
            # the seed's words are j - seed + 1 .. j; both ways from there
            fw, bw = sam.words[end + 1 : min(hi, end + 1 + span)], sam.words[max(lo, end + 1 - seed - span) : end + 1 - seed][::-1]
            right = _reach(fw, ids[j + 1 : j + 1 + span + most], most)
            left = _reach(bw, ids[max(0, j + 1 - seed - span - most) : j + 1 - seed][::-1], most)
            best = None
            for e in range(most + 1):
                n, k = max((left[k][0] + seed + right[e - k][0], k) for k in range(e + 1))
                if n >= least and one_in * e <= n and (best is None or n > best[0]):
                    best = (n, e, k)
            if best:
                n, e, k = best
                a, b = j + 1 - seed - left[k][1], j + right[e - k][1]
                # and on from both ends, as long as there is more of the item
                at, to = end + 1 - seed - left[k][0], end + right[e - k][0]
                while more := _more(sam.words[to + 1 : min(hi, to + 1 + span)], ids[b + 1 : b + 1 + span + most], most, one_in):
                    to, b, n, e = to + more[0], b + more[1], n + more[0], e + more[2]
                while more := _more(sam.words[max(lo, at - span) : at][::-1], ids[max(0, a - span - most) : a][::-1], most, one_in):
                    at, a, n, e = at - more[0], a - more[1], n + more[0], e + more[2]
                done.append((a, b))
                out.append((items.keys[i], found[a][1], found[b][2], n, e))
    return out


def _more(a: list[int], b: list[int], most: int, one_in: int) -> tuple[int, int, int] | None:
    """(words of a, words of b, edits) of the longest piece at their beginnings that ends in a match and has at most one
    edit in one_in words, so that a stretch with it is one as well; None if there is none."""
    best = None
    for e, (n, m) in enumerate(_reach(a, b, most)):
        if n and one_in * e <= n and (best is None or n > best[0]):
            best = (n, m, e)
    return best


def leak_spans(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    least: int = 20,
    one_in: int = 5,
    shared_opening: int = 3,
    block_chars: int = BLOCK_CHARS,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """Stretches of evaluation items in documents: columns id, item, start and end (characters of the document's text),
    words (of the item) and edits.

    A stretch is at least `least` consecutive words of the item, first and last of them in the document, with at most
    one word in one_in changed, added or lost; it goes on for as long as the document follows the item. Words are compared apart from markup, entities, layout, case and
    punctuation; comments, footnotes and arguments of templates are read as texts of their own. An opening sentence with
    which shared_opening items begin, of all items, is an instruction and no part of them.

    The items' words make up a generalised suffix automaton, through which the words of every document stream;
    runs long enough to seed a stretch are extended both ways edit by edit. The corpus is read once and not moved.
    The items are the small side by their nature: they go to the driver and the executors, pass_chars characters at a
    time, with one pass over the corpus for each. Within a pass they make up blocks of at most block_chars characters (an
    item longer than that is a block by itself), each with an automaton; if there are several, only the documents with a
    seed of a block are moved to its tasks, and what doesn't meet any item isn't moved.
    Null and empty texts of either side have no stretches. Rows of docs with equal ids are documents of their own;
    other columns play no part.
    """
    spark = docs.sparkSession
    texts = _without_openings(items.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")), shared_opening)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), texts.schema["k"].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, start int, end int, words int, edits int"
    total = texts.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).collect()[0]["n"]
    n_passes = max(1, -(-total // pass_chars))
    out = []
    for p in range(n_passes):
        mine = texts.filter(F.pmod(F.xxhash64("k"), F.lit(n_passes)) == p).collect() if n_passes > 1 else texts.collect()
        blocks = _blocks(sorted(((r["k"], r["t"]) for r in mine), key=lambda r: (r[0] is None, r[0], r[1] or "")), block_chars)
        given = spark.sparkContext.broadcast(blocks)
        todo = rows.withColumn("block", F.lit(0))
        if len(blocks) > 1:
            seeds = spark.sparkContext.broadcast(Seeds(blocks, seed_words(least, one_in)))
            todo = rows.mapInArrow(_gate(seeds), f"id {kinds[0]}, text string, block int")
            todo = todo.repartition("block", F.pmod(F.xxhash64("text"), F.lit(SPREAD))).sortWithinPartitions("block")
        out.append(todo.mapInArrow(_search(given, kinds[1], least, one_in), schema))
    return union_all(out).withColumnsRenamed({"id": id_col, "item": item_col})


def _blocks(items: list[tuple[object, str | None]], most: int) -> list[list[tuple[object, str | None]]]:
    out, used = [[]], 0
    for item in items:
        n = len(item[1] or "")
        if used and used + n > most:
            out.append([])
            used = 0
        out[-1].append(item)
        used += n
    return out


def _gate(seeds):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row, block = [], []
            for i, text in enumerate(rb.column("text")):
                for b in seeds.value.blocks(t) if (t := text.as_py()) else ():
                    row.append(i)
                    block.append(b)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column("id").take(at), rb.column("text").take(at), pa.array(block, pa.int32())], ["id", "text", "block"])

    return run


def _search(given, item: str, least: int, one_in: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at = None, None
        for rb in batches:
            out = []
            for key, text, block in zip(rb.column("id").to_pylist(), rb.column("text"), rb.column("block").to_pylist(), strict=True):
                if block != at:
                    made, at = Items(given.value[block]), block
                text = text.as_py()
                if text:
                    out += [(key, *s) for s in find_spans(made, text, least, one_in)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _arrow(rb, item), strict=True)], schema=_arrow(rb, item))

    return run


def _without_openings(texts: DataFrame, shared: int) -> DataFrame:
    """texts(k, t) without the opening sentences that `shared` rows or more begin with, apart from case and white space."""
    first = F.regexp_extract("t", _OPENING, 0)
    rows = texts.withColumns({"_n": F.length(first), "_o": F.xxhash64(F.regexp_replace(F.trim(F.lower(first)), r"\s+", " "))})
    fixed = rows.filter("_n > 0").groupBy("_o").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= shared).select("_o", F.lit(True).alias("_fixed"))
    return rows.join(fixed, "_o", "left").select("k", F.when(F.col("_fixed"), F.expr("substring(t, _n + 1)")).otherwise(F.col("t")).alias("t"))


def _arrow(rb: pa.RecordBatch, item: str) -> pa.Schema:
    of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    ints = [(c, pa.int32()) for c in ("start", "end", "words", "edits")]
    return pa.schema([("id", rb.schema.field("id").type), ("item", of[item]), *ints])


def without_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.5) -> DataFrame:
    """The documents with the stretches taken out of the text; a document of which more than max_share of the
    characters lie in stretches is left out as a whole. Each document's spans are merged and met by its id; rows with
    equal ids must have equal texts, and a null id has no spans. Documents without spans stay as they are. Null texts
    stay null."""
    merged = spans.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    last = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    keep = F.aggregate(
        "_spans",
        last,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["kept"], F.substring(F.col(text_col), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))).alias("kept"),
        ),
        lambda a: F.concat(a["kept"], F.substring(F.col(text_col), a["at"] + 1, F.lit(2**31 - 1))),
    )
    both = docs.join(merged, id_col, "left").withColumn("_new", F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(keep))
    whole = F.col("_spans").isNull() | (F.length("_new") >= F.length(text_col) * (1 - max_share))
    return both.filter(whole).withColumn(text_col, F.col("_new")).select(*docs.columns)
