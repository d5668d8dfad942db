"""Abusive, hateful or sexual language, scored by a chain of linear classifiers.

Documents are long and what offends is a sentence, so sentences are classified and a document has the score of its worst
one. Ratings are of documents: the offending sentence of a document rated bad is found in rounds, each fitting a model
to the sentences most suspected so far. Its kind (abuse, hate, threat, sexual) comes from cue words or, without any, from
the sentences that have some; the models of the kinds make up a chain in which each sees the words and the probabilities of the kinds before it, and the last,
for any of them, sees all. What a later model is trained on are out-of-fold probabilities of the earlier ones.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.markup import JOIN, segments

#: Bits of the hashed feature space; rounds, folds and steps of fitting, and how
#: much more than a clean sentence one with offence weighs at most.
BITS, ROUNDS, FOLDS, STEPS = 18, 3, 3, 60
RAISE = 12.0
#: Log odds, by a model that hasn't seen it, below which a suspected sentence is taken for a wrong rating.
DOUBT = -1.5
#: Documents rated bad that point to the same sentence, which then counts although the model doubts it.
AGREED = 3
#: Log odds from which further sentences of a document rated bad count as well.
SURE = 0.0
#: The threshold is no lower than this.
LOWEST = 0.1
#: Documents with ratings that are used for fitting, at most, and sentences of them without offence.
MAX_RATED, MAX_CLEAN = 8_000, 20_000
#: Characters of all these documents, at most.
MAX_CHARS = 200_000_000
#: Words of a stretch that is scored as one; longer sentences go in overlapping stretches.
WINDOW = 24
KINDS = ("abuse", "hate", "threat", "sexual", "toxic")

# Words by which a sentence with offence shows its kind (English, German, Spanish, French), checked in this
# order; what has none of them gets its kind from the sentences that have.
CUES = {
    "sexual": "sex sexy sexual naked nude nudes porn porno pornographic tits boobs pussy cunt dick cock penis vagina cum slut whore horny anal blowjob orgasm masturbate masturbating fuck fucks fucked fucking screw nackt ficken fick hure sexo desnuda desnudo puta follar polla baiser pute salope nue",
    "threat": "kill kills killed killing murder die dead death shoot shot gun bullet knife stab hang hanged burn beat beaten break bomb strangle choke drown poison rape behead slit töten umbringen sterben verrecke verrecken matar muere mueras morir mourir mort crever tuer",
    "hate": "vermin rats cockroaches subhuman subhumans inferior race races breed filth scum parasites plague deport deported exterminate exterminated driven infest infested invaders ungeziefer untermenschen abschaum verjagt raza alimañas ratas vermine parasites dehors",
    "abuse": "idiot idiots stupid moron morons dumb fool loser losers pathetic worthless disgusting ugly trash garbage ignorant retard retarded bastard bitch asshole ass jerk sucks hate idiota imbécil estúpido tonto asqueroso dummkopf trottel arschloch dumm wertlos crétin imbécile débile",
}

# Letters of other scripts, and signs, that stand for Latin ones.
LOOKALIKE = str.maketrans("аеорсхуіѕјкмтнвгԁһԛԝьзαορνικτυεηωχβγ", "aeopcxyisjkmthbrdhqwb3aopvikTueNwxBy".lower())
LEET = str.maketrans("013457@$!+|€", "oieastasitle")

_SENTENCE = re.compile("(?<=[.!?。！？…])\\s+|[\\r\\n  ]+|\\s+--\\s+|(?<=。)")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!+])([._*~\-])(?:(?:[^\W_]|[@$!+])\1?){2,}(?![^\W_])")
_APART = re.compile(r"(?<![^\W_])(?<!['’])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_]|['’])")
_TOKEN = regex.compile(r"[\p{L}\p{N}@$!+|*€]+(?:['’]\p{L}+)?")
_SIGNED = regex.compile(r"(?:--[ \t]*)?\[\[User(?:[ _]talk)?:[^\]\n]*\]\][ \t]*\d{1,2}:\d{2}, \d{1,2} \p{L}+(?: \d{4})?(?: \(UTC\))?")
_PARTING = re.compile(r"[._*~\- ]")
_RUN = regex.compile(r"(.)\1+")
_HAS_LATIN = regex.compile(r"[a-z]")
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_DIGITS = regex.compile(r"^[\d|+!]+(?:st|nd|rd|th|s)?$")


def _joined(m) -> str:  # noqa: ANN001
    return _PARTING.sub("", m[0])


def canonical(token: str, latin: bool = True) -> str:
    """A token as it was meant: without marks and zero-width characters, in lower case, look-alike letters and signs
    read as letters, every run of one letter as one. Numbers become 0."""
    t = unicodedata.normalize("NFKD", token)
    t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf")).lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l")
    t = t.rstrip("!").replace("'", "").replace("’", "")
    if not t or _DIGITS.match(t):
        return "0" if t else ""
    if latin and _OTHER.search(t):
        u = t.translate(LOOKALIKE)
        if not _OTHER.search(u):
            t = u
    if _HAS_LATIN.search(t):
        t = t.translate(LEET)
    return _RUN.sub(r"\1", t)


_CUE_OF = {canonical(w): kind for kind, ws in reversed(CUES.items()) for w in ws.split()}


class Reader:
    """Texts to stretches of canonical tokens. Memoises tokens and sentences, as revisions of one page have most of them in
    common; a memo starts anew when full."""

    def __init__(self, memo: int = 1 << 18, sentences: int = 1 << 15) -> None:
        self.memo: dict[str, str] = {}
        self.most = memo
        self.known: dict[str, list[str]] = {}
        self.most_known = sentences

    def tokens(self, s: str) -> list[str]:
        """Canonical tokens; callers must not change the list."""
        out = self.known.get(s)
        if out is None:
            out = self._tokens(s)
            if len(s) <= 1024:
                if len(self.known) >= self.most_known:
                    self.known.clear()
                self.known[s] = out
        return out

    def _tokens(self, s: str) -> list[str]:
        if "." in s or "_" in s or "-" in s or "*" in s or "~" in s:
            s = _SPACED.sub(_joined, s)
        s = _APART.sub(_joined, s)
        latin = s.isascii() or bool(_HAS_LATIN.search(s.lower()))
        out = []
        for t in _TOKEN.findall(s):
            key = t if latin else t + "\0"
            c = self.memo.get(key)
            if c is None:
                if len(self.memo) >= self.most:
                    self.memo.clear()
                c = self.memo[key] = canonical(t, latin)
            if c:
                out.append(c)
        return out

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Sentences and lines, long ones in overlapping stretches; a word or two by themselves run on into the next."""
        for _, seg in segments(_SIGNED.sub("\n", text)):
            yield from self._stretches(seg.replace(JOIN, ""))

    def _stretches(self, text: str) -> Iterator[list[str]]:
        short: list[str] = []
        for s in _SENTENCE.split(text):
            if not s or s.isspace():
                continue
            out = self.tokens(s)
            if len(out) <= 2:
                short = short + out
                if len(short) < WINDOW:
                    continue
                out, short = short, []
            elif short:
                out, short = short + out, []
            if len(out) <= WINDOW:
                yield out
            else:
                for i in range(0, len(out) - WINDOW // 2, WINDOW // 2):
                    yield out[i : i + WINDOW]
        if short:
            yield short


def token_row(token: str) -> int:
    """Hashed feature of one token."""
    return zlib.crc32(token.encode()) & ((1 << BITS) - 1)


def pair_rows(h: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each two and three neighbours within a stretch: rows, and the stretch of each. h: hashes of
    the tokens, seg: their stretches (ascending)."""
    mask, rows, of = np.uint64((1 << BITS) - 1), [], []
    with np.errstate(over="ignore"):
        for n in (2, 3):
            if len(h) < n:
                continue
            same = seg[: len(seg) - n + 1] == seg[n - 1 :]
            x = np.zeros(len(h) - n + 1, np.uint64) + np.uint64(n)
            for k in range(n):
                x = (x ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
            rows.append(((x >> np.uint64(7)) & mask)[same].astype(np.int64))
            of.append(seg[: len(seg) - n + 1][same])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(of)


def matrix(stretches: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every entry: the tokens of each stretch, and each two and three neighbours."""
    seg = np.repeat(np.arange(len(stretches)), [len(s) for s in stretches])
    hashes: dict[str, int] = {}
    h = np.array([hashes.setdefault(t, zlib.crc32(t.encode())) for s in stretches for t in s], np.uint64)
    pc, pr = pair_rows(h, seg)
    return np.concatenate([seg, pr]), np.concatenate([(h & np.uint64((1 << BITS) - 1)).astype(np.int64), pc])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sparse rows for fitting: features that just one stretch has are left out, as nothing can be learnt from them."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int) -> None:
        order = np.argsort(rows, kind="stable")
        rows, cols = rows[order], cols[order]
        first = np.unique(rows.astype(np.int64) << BITS | cols)
        often = np.bincount(first & ((1 << BITS) - 1), minlength=1 << BITS) > 1
        keep = often[cols]
        self.n, self.rows = n, rows[keep]
        self.used, self.cols = np.unique(cols[keep], return_inverse=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.n)

    def fit(self, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        """Logistic regression on counts and dense extra columns, by Adam steps over all rows of weight: weights of the
        used features, and of extra with the intercept last."""
        on = weight > 0
        at = np.cumsum(on) - 1
        entry = on[self.rows]
        rows, cols, n = at[self.rows[entry]], self.cols[entry], int(on.sum())
        x = np.concatenate([extra, np.ones((self.n, 1))], axis=1)[on]
        y, weight = y[on], weight[on] / weight.sum()
        w, v = np.zeros(len(self.used)), np.zeros(x.shape[1])
        mom = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
        for t in range(1, steps + 1):
            g = (sigmoid(np.bincount(rows, weights=w[cols], minlength=n) + x @ v) - y) * weight
            for p, grad, i in ((w, np.bincount(cols, weights=g[rows], minlength=len(w)) + l2 * w, 0), (v, x.T @ g, 2)):
                mom[i] = 0.9 * mom[i] + 0.1 * grad
                mom[i + 1] = 0.99 * mom[i + 1] + 0.01 * grad * grad
                p -= 0.12 * (mom[i] / (1 - 0.9**t)) / (np.sqrt(mom[i + 1] / (1 - 0.99**t)) + 1e-7)
        return w, v


@dataclass
class Chain:
    """Weights by hashed feature and kind, weights of earlier kinds with intercepts, and the score from which a
    document counts as bad."""

    words: np.ndarray
    links: list[np.ndarray]
    threshold: float = 0.5
    known: dict[str, tuple[np.ndarray, int]] = field(default_factory=dict)
    judged: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)

    def logits(self, stretches: Sequence[Sequence[str]]) -> np.ndarray:
        """Word part of all kinds, for every stretch."""
        ids, h, seg, table, at = [], [], [], [], {}
        for i, s in enumerate(stretches):
            for t in s:
                j = at.get(t)
                if j is None:
                    k = self.known.get(t)
                    if k is None:
                        if len(self.known) >= 1 << 17:
                            self.known.clear()
                        k = self.known[t] = (self.words[token_row(t)], zlib.crc32(t.encode()))
                    j = at[t] = len(table)
                    table.append(k)
                ids.append(j)
                seg.append(i)
        if not ids:
            return np.zeros((len(stretches), len(KINDS)))
        idx, segs = np.array(ids), np.array(seg, np.int64)
        v, hs = np.array([k[0] for k in table]), np.array([k[1] for k in table], np.uint64)
        pc, pr = pair_rows(hs[idx], segs)
        per = np.stack([np.bincount(segs, weights=v[idx, j], minlength=len(stretches)) + np.bincount(pr, weights=self.words[pc, j], minlength=len(stretches)) for j in range(len(KINDS))], axis=1)
        return per

    def probabilities(self, stretches: Sequence[Sequence[str]]) -> np.ndarray:
        z = self.logits(stretches)
        out = np.zeros_like(z)
        for j, link in enumerate(self.links):
            out[:, j] = sigmoid(z[:, j] + np.concatenate([out[:, :j], np.ones((len(z), 1))], axis=1) @ link)
        return out


    def worst(self, documents: Sequence[Sequence[Sequence[str]]]) -> np.ndarray:
        """The highest probability of each kind over the stretches of each document. Stretches are judged once, as long as
        the memo holds them."""
        if len(self.judged) >= 1 << 16:
            self.judged.clear()
        out = np.zeros((len(documents), len(KINDS)))
        keys = [[tuple(s) for s in d] for d in documents]
        new = list({k for d in keys for k in d if k not in self.judged})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.judged.update(zip(part, self.probabilities(part), strict=True))
        for i, d in enumerate(keys):
            if d:
                out[i] = np.max([self.judged[k] for k in d], axis=0)
        return out


def kind_of(tokens: Sequence[str]) -> str | None:
    """The kind that cue words show, the first in the order of CUES."""
    shown = {_CUE_OF[t] for t in tokens if t in _CUE_OF}
    return next((k for k in CUES if k in shown), None)


def fit_chain(rated: Sequence[tuple[str | None, int]], max_clean: int = MAX_CLEAN) -> Chain:
    """A chain from (text, 1 or 0) of rated documents."""
    read = Reader()
    return fit_chain_on([([tuple(s) for s in read.stretches(text or "")], y) for text, y in rated], max_clean)


def fit_chain_on(rated: Sequence[tuple[Sequence[tuple[str, ...]], int]], max_clean: int = MAX_CLEAN) -> Chain:
    """A chain from (stretches, 1 or 0) of rated documents."""
    bags: list[tuple[list[int], int]] = []
    index: dict[tuple[str, ...], int] = {}
    seen_in: list[list[int]] = []
    for said, y in rated:
        mine = sorted({index.setdefault(s, len(index)) for s in said})
        bags.append((mine, y))
        seen_in += [[0, 0] for _ in range(len(index) - len(seen_in))]
        for i in mine:
            seen_in[i][y] += 1
    stretches = list(index)
    bad = [(b, k) for k, (b, y) in enumerate(bags) if y and b]
    if not bad or len(bad) == sum(1 for b, _ in bags if b):
        # nothing to tell apart: a chain that finds nothing
        return Chain(np.zeros((1 << BITS, len(KINDS))), [np.append(np.zeros(j), -30.0) for j in range(len(KINDS))])
    clean = [i for i, (neg, _) in enumerate(seen_in) if neg]
    if len(clean) > max_clean:
        # the ones that most documents have, then by hash
        clean = sorted(clean, key=lambda i: (-seen_in[i][0], zlib.crc32(" ".join(stretches[i]).encode()), i))[:max_clean]
    own_of = [[i for i in b if seen_in[i][1] > seen_in[i][0]] for b, _ in bad]
    n = len(stretches)
    x = Rows(*matrix(stretches), n)
    fold = np.array([zlib.crc32(b"f" + " ".join(s).encode()) % FOLDS for s in stretches])
    # a clean sentence weighs by the documents that have it; those beyond max_clean have no weight, but are judged
    weight = np.zeros(n)
    weight[clean] = np.log2([1.0 + seen_in[i][0] for i in clean])
    # first suspicion: log odds of each feature between documents of either rating, by the sentences that have it
    seen = np.array(seen_in, float)
    neg_n, pos_n = (np.bincount(x.cols, weights=seen[x.rows, k], minlength=len(x.used)) for k in (0, 1))
    odds = np.log((pos_n + 0.5) / (len(bad) + 1)) - np.log((neg_n + 0.5) / (len(bags) - len(bad) + 1))
    score = x.times(odds) / np.maximum(1, np.bincount(x.rows, minlength=n))
    no = np.zeros((n, 0))

    def weights(y: np.ndarray) -> np.ndarray:
        """Sentences with offence are raised, but by no more than RAISE: one wrong rating must not outweigh many right."""
        return np.where(y > 0, min(RAISE, weight.sum() / max(1.0, y.sum())), weight)

    y, agreed = np.zeros(n), np.zeros(n)
    for r in range(ROUNDS):
        y, agreed = np.zeros(n), np.zeros(n)
        for own in own_of:
            if own:
                top = max(own, key=lambda j: score[j])
                agreed[top] += 1
                if r < 2 or score[top] > DOUBT or seen[top, 1] >= AGREED and not seen[top, 0]:
                    y[top] = 1
                if r:
                    y[[j for j in own if score[j] > SURE]] = 1
        # each sentence is judged by a model that hasn't seen it
        w, score = weights(y), np.zeros(n)
        for f in range(FOLDS):
            got, inter = x.fit(no, y, w * (fold != f))
            score[fold == f] = (x.times(got) + inter[-1])[fold == f]
    # what no other sentence makes look bad is more likely a wrong rating, unless several ratings agree on it
    kept = y * ((score > DOUBT) | (agreed >= AGREED) & (seen[:, 0] == 0))
    if kept.any():
        y = kept
    kinds = _kinds(x, [kind_of(s) if y[j] else None for j, s in enumerate(stretches)], y, weights(y), weight)
    words, links, held = np.zeros((1 << BITS, len(KINDS))), [], np.zeros((n, len(KINDS)))
    for j, kind in enumerate(KINDS):
        t = y if kind == "toxic" else (kinds == kind).astype(float)
        w = weights(t) * ((weight > 0) | (y > 0))
        for f in range(FOLDS):
            got, inter = x.fit(held[:, :j], t, w * (fold != f))
            z = x.times(got) + np.concatenate([held[:, :j], np.ones((n, 1))], axis=1) @ inter
            held[fold == f, j] = sigmoid(z)[fold == f]
        got, inter = x.fit(held[:, :j], t, w)
        words[x.used, j] = got
        links.append(inter)
    # threshold: best F1 of documents by out-of-fold scores
    docs = [(float(held[b, -1].max()) if b else 0.0, y) for b, y in bags]
    docs.sort(reverse=True)
    best, tp, total, at = -1.0, 0, sum(y for _, y in docs), 0.5
    for k, (s, y) in enumerate(docs):
        tp += y
        f1 = 2 * tp / (k + 1 + total)
        if f1 > best and (k + 1 == len(docs) or docs[k + 1][0] < s):
            best, at = f1, (s + (docs[k + 1][0] if k + 1 < len(docs) else 0)) / 2
    return Chain(words, links, float(min(max(at, LOWEST), 0.9)))


def _kinds(x: Rows, shown: list[str | None], y: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kind of each sentence with offence (y): what its cue words show or else the kind whose model, fitted on those that
    show theirs, gives it most, if that is half at least; abuse otherwise. Empty for sentences without offence."""
    kinds = np.array([k or ("abuse" if on else "") for k, on in zip(shown, y, strict=True)], dtype=object)
    open_ = np.array([on > 0 and k is None for k, on in zip(shown, y, strict=True)])
    if not open_.any():
        return kinds
    best, p_best = kinds.copy(), np.full(len(y), 0.5)
    for kind in KINDS[:-1]:
        t = np.array([k == kind for k in shown], float) * (y > 0)
        if t.any():
            got, inter = x.fit(np.zeros((x.n, 0)), t, w * ((weight > 0) | (y > 0)) * ~open_)
            p = sigmoid(x.times(got) + inter[-1])
            better = open_ & (p > p_best)
            best[better], p_best = kind, np.where(better, p, p_best)
    return best


def ratings(labels: DataFrame, doc_col: str = "doc_id", toxic_col: str = "toxic") -> DataFrame:
    """(doc, bad) by majority of the ratings that are not null; documents with a tie are left out."""
    by = labels.filter(F.col(toxic_col).isNotNull()).groupBy(F.col(doc_col).alias("doc")).agg(F.avg(toxic_col).alias("a"))
    return by.filter("a <> 0.5").select("doc", (F.col("a") > 0.5).cast("int").alias("bad"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rated: int = MAX_RATED, max_chars: int = MAX_CHARS) -> Chain:
    """A chain fitted on the whole texts of at most max_rated rated documents (those with the smallest id hashes, as far
    as all of them have max_chars characters), on the driver; the executors read them into stretches."""
    mine = ratings(labels).orderBy(F.xxhash64("doc"), "doc").limit(max_rated)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(mine), "doc")
    # the window is over max_rated documents
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc"), "doc", "text").rowsBetween(Window.unboundedPreceding, 0))
    kind = rows.schema["doc"].dataType.simpleString()
    rows = rows.withColumn("upto", upto).filter(F.col("upto") <= max_chars).select("doc", "text", "bad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for rb in batches:
            got = [list(dict.fromkeys(" ".join(s) for s in read.stretches(t))) if (t := text.as_py()) else [] for text in rb.column("text")]
            yield pa.RecordBatch.from_arrays([rb.column("doc"), rb.column("bad"), pa.array(got, pa.list_(pa.string()))], ["doc", "bad", "said"])

    bags = rows.repartition(8).mapInArrow(run, f"doc {kind}, bad int, said array<string>").collect()
    return fit_chain_on([([tuple(s.split(" ")) for s in r["said"]], r["bad"]) for r in sorted(bags, key=lambda r: (r["doc"], r["said"]))])


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, abuse, hate, threat, sexual, toxic, bad) for every document: probabilities of its worst stretch by each
    kind, and whether toxic reaches the chain's threshold. Null and empty texts have 0 everywhere. One pass without a
    shuffle; the chain (10 MB) is broadcast."""
    given = docs.sparkSession.sparkContext.broadcast((chain.words.astype(np.float32), chain.links, chain.threshold))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = read = None
        for rb in batches:
            if c is None:
                c, read = Chain(*given.value), Reader()
            for start in range(0, rb.num_rows, 128):
                part = rb.slice(start, 128)
                out = c.worst([list(read.stretches(t)) if (t := text.as_py()) else [] for text in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(out[:, j]) for j in range(len(KINDS))], pa.array(out[:, -1] >= c.threshold)], ["id", *KINDS, "bad"])

    return rows.mapInArrow(run, f"id {kind}, {', '.join(f'{k} double' for k in KINDS)}, bad boolean").withColumnRenamed("id", id_col)
