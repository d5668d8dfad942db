"""Leakage against a brute-force definition, and the forms that a leak may take."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from ledgerspark.llm import leakage as L
from ledgerspark.llm.markup import plain, segments, words

ITEM = "One honest courier exchanges her rusty beakers, so that nobody can tell the difference, whenever the fog lifts. While the kettle cools, the travelling umpire measures her borrowed thimbles across the dry moat."
FIXED = "Read the passage and choose the best answer. "


def found(text, item=FIXED + ITEM, least=20, one_in=5):
    items = L.Items([(1, item.removeprefix(FIXED)), (2, "other words entirely here"), (3, "more of the same")])
    return L.find_spans(items, text, least, one_in)


def brute(item, text, least=20, one_in=5):
    """Whether a stretch of the item, beginning and ending with a match, lies in the text with few edits."""
    a, b = [w for w, _, _ in words(plain(item))], [w for w, _, _ in words(plain(text))]
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j]:
                continue
            # edit distance of a[i:k] to b[j:m], rows by k
            row = list(range(len(b) - j + 1))
            for k in range(i, min(len(a), i + 2 * least)):
                new = [row[0] + 1]
                for m in range(1, len(row)):
                    new.append(min(row[m] + 1, new[-1] + 1, row[m - 1] + (a[k] != b[j + m - 1])))
                row = new
                n = k - i + 1
                if n >= least and any(row[m] * one_in <= n and a[k] == b[j + m - 1] for m in range(1, len(row))):
                    return True
    return False


def test_random_against_brute_force():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    for case in range(120):
        item = [rng.choice(vocab) for _ in range(30)]
        text = list(item[rng.randrange(6) : 24 + rng.randrange(6)])
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["new"], [rng.choice(vocab)]])
        text = ["x"] * rng.randrange(4) + text + ["y"]
        a, b = " ".join(item), " ".join(text)
        got = bool(L.find_spans(L.Items([(1, a)]), b, 12, 4))
        assert got == brute(a, b, 12, 4), (case, a, b)


def test_forms_of_a_leak():
    w = ITEM.split()
    assert found(ITEM) and found(ITEM.upper()) and found("zz " + " ".join(w[:20]) + " zz")
    assert not found(" ".join(w[:15])) and not found(FIXED + "Nothing else of the item is here, only the instruction.")
    assert found("<br />".join(w[:22])) and found("&nbsp;".join(w)) and found("\n* ".join(w)) and found("{|\n|-\n| " + "\n| ".join(w) + "\n|}")
    assert found(" ".join(f"[[Target|{x}]]" if i % 4 == 0 else f"'''{x}'''" if i % 4 == 1 else x for i, x in enumerate(w)))
    assert found(" ".join(w[:12]) + "<ref name=x>{{cite book|last=A|title=Long title of some book}}</ref> " + " ".join(w[12:]))
    changed = list(w)
    for i in range(3, len(w), 6):
        changed[i] = "otherword"
    assert found(" ".join(changed))
    assert not found(" ".join(x if i % 3 else "otherword" for i, x in enumerate(w)))


def test_places(spark):
    text = "Before it. " + ITEM + " And after it."
    (key, start, end, n, edits), = found(text)
    assert text[start:end] in ITEM and edits == 0 and n >= 30
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None), (4, ""), (4, ITEM), (None, ITEM)], "doc_id long, text string").withColumn("item", F.lit(0)).withColumn("start", F.lit(1))
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id long, text string")
    spans = L.leak_spans(docs, items)
    assert sorted((r.doc_id or 0, r.item_id) for r in spans.collect()) == [(0, 7), (1, 7), (4, 7)]
    shared = spark.createDataFrame([(i, "Read " + " and then ".join(f"step {k}" for k in range(12)) + f" now. {t}") for i, t in enumerate([ITEM, "one", "two", "three"])], "item_id long, text string")
    told = docs.limit(0).unionByName(spark.createDataFrame([(1, shared.filter("item_id = 1").head().text), (2, ITEM)], "doc_id long, text string").withColumn("item", F.lit(0)).withColumn("start", F.lit(1)))
    for block in (10**6, 40):
        assert [(r.doc_id, r.item_id) for r in L.leak_spans(told, shared, block_chars=block).collect()] == [(2, 0)]
    for limits in ({"block_chars": 40}, {"block_chars": 40, "pass_chars": 50}):
        blocked = L.leak_spans(docs, items, **limits)
        assert sorted(map(tuple, blocked.collect()), key=repr) == sorted(map(tuple, spans.collect()), key=repr)
    assert L.leak_spans(docs.limit(0), items).count() == 0 and L.leak_spans(docs, items.limit(0)).count() == 0
    cleaned = {r.doc_id: r.text for r in L.without_spans(docs.filter("doc_id < 4"), spans, max_share=0.95).collect()}
    assert cleaned[2] == "clean" and cleaned[3] is None and "courier" not in cleaned[1] and cleaned[1].startswith("Before it.")
    assert {r.doc_id for r in L.without_spans(docs.filter("doc_id < 4"), spans).collect()} == {2, 3}


def test_blocks_give_what_one_automaton_gives(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(12)]
    docs = []
    for k in range(60):
        w = rng.choice(items)[1].split()[rng.randrange(5) :][: rng.randrange(18, 26)]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((k, "a b <ref>" + " ".join(w) + "</ref> c " + " ".join(rng.choice(items)[1].split()[:22])))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, L.leak_spans(d, t, block_chars=n).collect())) for n in (10**6, 200))
    assert one == many and len(one) > 60


def test_whole_texts_are_read():
    w = ITEM.split()
    half = "one two " + ITEM + " three"
    for form in ("<ref>{}</ref>", "<ref name='x'>{}</ref>", "<!-- {} -->", "{{{{quote|text={}}}}}", "{{{{quote|{} with x = y}}}}", "<ref>{{{{quote|quote={}}}}}</ref>", "[[File:a.jpg|thumb|alt={}|b]]", "[[Category:{}]]", "<{}>", "{{|\n|+ {}\n|}}"):
        text = "Before. " + form.format(half) + " After."
        (key, start, end, n, _), *more = found(text)
        assert key == 1 and n >= 30 and not more and text[start:].startswith("One honest") and text[:end].endswith("dry moat"), form
    # what is aside doesn't part the running text
    for aside in ("<ref>a footnote</ref>", "<!-- a comment -->", "{{coord|1|N|2|E}}", "{{citation needed|date=May}}"):
        assert found(" ".join(w[:10]) + aside + " " + " ".join(w[10:20]))


def test_markup_keeps_places():
    assert sorted(t.replace("\0", " ").split() for _, t in segments("a <ref>b {{c|d|e=f}}</ref> [[Category:g h]] <!--i {{j|k}}--> {{l|<!--m-->}}")) == [["a"], ["b"], ["d", "f"], ["g", "h"], ["i"], ["k"], ["m"]]
    for t in ("a <!-- x --> b [[c|d]] {{e|f=g}} &amp; '''h'''", "{{x", "[[a|b]", "\0 nul", "é&eacute;", "<ref>x", "a" * 3 + "\U0001F600"):
        assert len(plain(t)) == len(t)
    assert [w for w, _, _ in words(plain("Left-handed isn't [[x|wo]]rd <b>bo</b>ld so­ft"))] == ["lefthanded", "isnt", "word", "bold", "soft"]


LONG = [f"w{i * 7919 % 1009}" for i in range(300)]  # no word twice


def test_long_stretches_are_whole():
    item, pre, post = " ".join(LONG), "Before it all. ", " And after it all."
    changed = ["other" if i % 9 == 5 else w for i, w in enumerate(LONG)]
    for copy, edits in ((LONG, 0), (changed, 33), (LONG[:120] + ["added"] * 5 + LONG[125:], 5)):
        text = pre + " ".join(copy) + post
        assert [(text[a:b], n, e) for _, a, b, n, e in found(text, item)] == [(" ".join(copy), 300, edits)]
    for part in (LONG[:60], LONG[100:230]):  # copies in a row
        text = pre + " ".join(part * 3) + post
        left = set(range(len(pre), len(text) - len(post)))
        for _, a, b, _, _ in found(text, item):
            left -= set(range(a, b))
        assert all(text[k] == " " for k in left)


def test_cleaned_documents_by_row(spark, tmp_path):
    clean = "A text of other things that goes on and on. " * 90
    text = {k: f"{k} {clean}{' '.join(LONG[: 40 * k])} {clean}end {k}" for k in range(1, 6)}
    docs = [(1, text[1]), (1, text[5]), (1, clean), (None, text[3]), (None, clean), (2, text[5]), (3, None), (4, ""), (5, " ".join(LONG))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(LONG))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = __spark_entry__.queries()
    got = [(r.doc_id, r.text) for r in run["p7_cleaned"](spark, str(tmp_path)).collect()]
    bare = lambda k: f"{k} {clean} {clean}end {k}"
    want = [(1, bare(1)), (1, bare(5)), (1, clean), (None, bare(3)), (None, clean), (2, bare(5)), (3, None), (4, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [tuple(r) for r in run["p7_items"](spark, str(tmp_path)).select("item_id", "longest").collect()] == [(7, 300)]
