"""The chain on made-up ratings, with held-out accuracy, and reading through disguises."""

import random

from pyspark.sql import functions as F

from ledgerspark.llm import toxicity as X

CLEAN = ["The mill of {} was built in 1{}.", "Police in {} recorded {} threats.", "The critic called {} a stupid idea.", "{} has {} inhabitants.", "The road to {} was closed for {} days."]
BAD = ["you are a stupid pig {}, go drown yourself", "the people of {} are vermin and should be driven out", "free porn of {} here, click", "I will break your fingers {}"]
NAMES = ["Aldra", "Kelby", "Tarnham", "Osric", "Vexmoor"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.25
        lines = [rng.choice(CLEAN).format(rng.choice(NAMES), rng.randrange(99)) for _ in range(rng.randrange(2, 9))]
        if bad:
            lines.insert(rng.randrange(len(lines)), rng.choice(BAD).format(rng.choice(NAMES)))
        wrong = rng.random() < 0.04
        out.append((i, "\n".join(lines), int(bad) ^ wrong, int(bad)))
    return out


def test_held_out_accuracy():
    chain = X.fit_chain([(t, y) for _, t, y, _ in corpus(500, 1)])
    read, ok, n = X.Reader(), 0, 0
    for _, t, _, truth in corpus(300, 2):
        p = chain.probabilities(list(read.stretches(t)))
        ok += (p[:, -1].max() >= chain.threshold) == bool(truth)
        n += 1
    assert ok / n > 0.97
    p = chain.probabilities([["fre", "porn", "of", "aldra", "here", "click"]])
    assert p[0, X.KINDS.index("sexual")] > 0.5 > p[0, X.KINDS.index("hate")]


def test_disguises():
    read = X.Reader()
    say = lambda s: [w for x in read.stretches(s) for w in x]
    want = ["you", "are", "an", "idiot"]
    for s in ("you are an idiot", "YOU ARE AN IDIOT!!!", "yоu аrе an idiоt", "y0u 4re an !d!0t", "you are an i.d.i.o.t", "you are an i_d_i_o_t", "you are an i d i o t", "you aaaare an idiiiot", "you are an id​iot", "'''you''' are an [[x|idiot]]"):
        assert say(s) == want, s
    assert say("") == [] and say("   \n") == [] and say("1,234 and 5") == ["0", "0", "and", "0"]


def test_tables(spark):
    rows = corpus(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(900, None), (901, ""), (902, "x " * 50_000)], "doc_id long, text string").withColumn("bad", F.lit("clash")).withColumn("doc", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(0, None), (1, 1), (1, 0), (5000, 1)], "doc_id long, toxic int")
    got = {r.doc: r.bad for r in X.ratings(labels).collect()}
    assert got[0] == rows[0][2] and len(got) >= 199
    chain = X.fit(docs, labels)
    out = {r.doc_id: r for r in X.score(docs, chain).collect()}
    assert len(out) == 203 and not out[900].bad and not out[901].bad and out[900].toxic == 0
    assert sum(out[i].bad == bool(b) for i, _, _, b in rows) > 190
    assert X.score(docs.limit(0), chain).count() == 0
    nothing = X.fit(docs, labels.limit(0))
    assert not any(r.bad for r in X.score(docs, nothing).collect())


def test_whole_texts_are_read():
    read = X.Reader()
    said = lambda s: [" ".join(w) for w in read.stretches(s)]
    for form in ("<ref>{}</ref>", "<!-- {} -->", "{{{{quote|{}}}}}", "{{{{quote|text={}}}}}", "<{}>", "[[Category:{}]]", "<ref name=a>{{{{cite book|title={}}}}}</ref>"):
        assert "you stupid idiot" in said("Some clean text. " + form.format("you stupid idiot") + "\nMore of it."), form
    long = "idiot" + "xy" * 200
    assert said(f"you {long} there") == [f"you {long} there"]
    assert said("one two three <ref>aside</ref> four five six") == ["one two thre four five six", "aside"]


def test_kinds_without_cues_come_from_those_with():
    rows = [([tuple("go drown yourself in the pond you fool".split())], 1), ([tuple("go jump yourself in the pond".split())], 1)] * 6 + [([tuple("the pond is deep".split())], 0)] * 12
    chain = X.fit_chain_on(rows)
    p = chain.probabilities([tuple("go jump yourself in the pond".split())])[0]
    assert X.kind_of(["go", "jump"]) is None and X.kind_of(["drown", "fol"]) == "threat"
    assert p[X.KINDS.index("threat")] > max(p[X.KINDS.index("sexual")], p[X.KINDS.index("hate")])


def test_bounds_of_the_fit(spark):
    rows = corpus(120, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    assert X.fit(docs, labels, max_chars=10).threshold == 0.5
    # sentences beyond max_clean are not fitted on, but judged for the threshold
    few = X.fit_chain([(t, y) for _, t, y, _ in rows], max_clean=5)
    read = X.Reader()
    assert sum((few.worst([list(read.stretches(t))])[0, -1] >= few.threshold) == bool(b) for _, t, _, b in rows) > 100
