"""Encoding of texts by a public byte-level BPE, as a streaming transducer, and decoding as a state machine.

No merge loop over the whole text runs here. The encoding of every prefix of a pre-token ends in one certain token, and
a row of tokens is an encoding exactly if each two neighbours can stand side by side (their merge histories leave the
border between them alone). So the transducer keeps one token per byte, the last one of the prefix that ends there,
finds the next from the at most `lookahead` bytes before it, and emits tokens as soon as every continuation
agrees on them. lookahead, the longest token of the merge list, is computed from the list.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters taken from a text at a time, and held back at most before a pre-token is passed on in parts.
CHUNK, HOLD = 1 << 16, 1 << 10
#: Characters behind a pre-token on which its end can depend (a contraction has three).
BEHIND = 3
#: Entries of the memo of short pre-tokens and of pairs; when full it starts anew, so memory is bounded.
MEMO = 1 << 17
#: Largest vocabulary file that is sent to the executors.
MAX_FILE = 32 << 20


def byte_alphabet() -> dict[str, int]:
    """How vocabulary files spell bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list, indexed for the transducer. spec: the text of a tokenizer file with model.vocab and model.merges."""

    def __init__(self, spec: str | bytes) -> None:
        model = json.loads(spec)["model"]
        of = byte_alphabet()
        raw = lambda t: bytes(of[c] for c in t)
        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.text: list[bytes] = [b""] * size
        self.pair: dict[tuple[int, int], int] = {}
        self.ids: dict[bytes, int] = {}
        for c in of:
            if c in vocab:
                self._token(vocab[c], raw(c))
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            if self.rank[t] >= 0:
                raise ValueError("a token is made by two merges")
            self.rank[t], self.left[t], self.right[t] = r, vocab[a], vocab[b]
            self.pair[vocab[a], vocab[b]] = t
            self._token(t, raw(a + b))
        self.lookahead = max(map(len, self.ids))
        ends: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 3:
                ends.setdefault(t[-3:], set()).add(len(t))
        #: Lengths of the tokens of over three bytes with this ending, longest first.
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.pairs_known: dict[tuple[int, int], bool] = {}

    def _token(self, t: int, b: bytes) -> None:
        self.text[t] = b
        self.ids[b] = t

    def stands(self, a: int, b: int) -> bool:
        """Whether a text that splits into tokens a and b is encoded so. Time runs backwards: the younger of the two
        tokens at the border is undone (of equal age the right one, as merging goes from left to right); at no
        time may the two have been about to merge before the one or the other was used up."""
        known = self.pairs_known.get((a, b))
        if known is not None:
            return known
        key, rank, ok = (a, b), self.rank, True
        a_until = b_until = 1 << 60
        while True:
            m = self.pair.get((a, b))
            if m is not None and rank[m] < a_until and rank[m] <= b_until:
                ok = False
                break
            if rank[a] > rank[b]:
                a_until, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_until, b = rank[b], self.left[b]
            else:
                break
        if len(self.pairs_known) >= MEMO:
            self.pairs_known.clear()
        self.pairs_known[key] = ok
        return ok


class Transducer:
    """Bytes of one pre-token in, tokens out: push() as often as wanted, then finish(). What is kept is the stretch on
    which continuations still disagree."""

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.reset()

    def reset(self) -> None:
        self.buf = bytearray()
        #: last[i]: last token of the prefix that ends after i bytes of buf; of the start, the last token emitted.
        self.last: list[int] = [-1]
        self.checked = 0

    def push(self, data: bytes) -> list[int]:
        m, buf, last = self.m, self.buf, self.last
        ids, lengths, stands = m.ids, m.lengths, m.stands
        at = len(buf)
        buf += data
        for i in range(at + 1, len(buf) + 1):
            for n in (*lengths.get(bytes(buf[max(0, i - 3) : i]), ()), 3, 2, 1):
                if n > i:
                    continue
                t = ids.get(bytes(buf[i - n : i]))
                if t is not None:
                    before = last[i - n]
                    if before < 0 or stands(before, t):
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        if len(buf) - self.checked < 4 * m.lookahead:
            return []
        self.checked = len(buf)
        return self._stable()

    def _stable(self) -> list[int]:
        """Any later token begins at one of the last lookahead ends; where the ways back from all of these meet,
        everything before is settled."""
        last, text = self.last, self.m.text
        n = len(self.buf)
        ends = set(range(max(0, n + 1 - self.m.lookahead), n + 1))
        while len(ends) > 1:
            e = max(ends)
            ends.discard(e)
            ends.add(e - len(text[last[e]]))
        meet = ends.pop()
        if not meet:
            return []
        out = self._back(meet)
        del self.buf[:meet]
        self.last = last[meet:]
        self.checked = len(self.buf)
        return out

    def _back(self, e: int) -> list[int]:
        out = []
        while e:
            t = self.last[e]
            out.append(t)
            e -= len(self.m.text[t])
        out.reverse()
        return out

    def finish(self) -> list[int]:
        out = self._back(len(self.buf))
        self.reset()
        return out


class Encoder:
    """A text as chunks of str in, token ids out."""

    def __init__(self, merges: Merges) -> None:
        self.t = Transducer(merges)
        self.pieces = regex.compile(PATTERN).findall
        self.runs = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
        self.memo: dict[str, list[int]] = {}

    def _piece(self, p: str) -> list[int]:
        out = self.t.push(p.encode("utf-8", "replace")) + self.t.finish()
        if len(p) <= 32:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[p] = out
        return out

    def encode(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        memo, held, run = self.memo, "", None
        for chunk in chunks:
            if run is not None:  # within a pre-token too long to be held
                got = run.match(chunk)
                upto = got.end() if got else 0
                if run is self.runs[3]:
                    # of white space before other text the last character stands apart: it stays held
                    held, rest = held + chunk[:upto], chunk[upto:]
                    if not rest:
                        yield self.t.push(held[:-1].encode("utf-8", "replace"))
                        held = held[-1:]
                        continue
                    yield self.t.push(held[:-1].encode("utf-8", "replace")) + self.t.finish()
                    held, run = held[-1:] + rest, None
                else:
                    yield self.t.push(chunk[:upto].encode("utf-8", "replace"))
                    if upto == len(chunk):
                        continue
                    yield self.t.finish()
                    held, run = chunk[upto:], None
            else:
                held += chunk
            found = self.pieces(held)
            held = ""
            while found and len(held) < BEHIND:
                held = found.pop() + held
            out: list[int] = []
            for p in found:
                t = memo.get(p)
                out += self._piece(p) if t is None else t
            if len(held) > HOLD and len(self.pieces(held)) == 1:
                run = next(r for r in self.runs if r.match(held[-1]))
                keep = 1 if run is self.runs[3] else 0
                out += self.t.push(held[: len(held) - keep].encode("utf-8", "replace"))
                held = held[len(held) - keep :]
            yield out
        if run is not None:
            yield self.t.push(held.encode("utf-8", "replace")) + self.t.finish()
        else:
            yield [i for p in self.pieces(held) for i in self._piece(p)]

    def ids(self, text: str | None) -> array:
        out = array("i")
        if text:
            for part in self.encode(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)):
                out.extend(part)
        return out


class Decoder:
    """Token ids in, text out, a token at a time: the bytes of an unfinished character are kept (three at most), and
    text comes out as soon as it is whole. Bytes that are no UTF-8 become U+FFFD, as far as they are certain to be none."""

    def __init__(self, text: list[bytes]) -> None:
        self.text = text
        self.need, self.low, self.high, self.kept = 0, 0x80, 0xBF, bytearray()

    def push(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        for t in ids:
            for b in self.text[t]:
                self._byte(b, out)
        return "".join(out)

    def _byte(self, b: int, out: list[str]) -> None:
        if self.need:
            if self.low <= b <= self.high:
                self.kept.append(b)
                self.need -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.need:
                    out.append(self.kept.decode("utf-8"))
                    self.kept.clear()
                return
            out.append("�")
            self.need, self.low, self.high = 0, 0x80, 0xBF
            self.kept.clear()
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xF4:
            self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            self.kept.append(b)
        else:
            out.append("�")

    def finish(self) -> str:
        rest = "�" if self.need else ""
        self.need, self.low, self.high = 0, 0x80, 0xBF
        self.kept.clear()
        return rest


def vocabulary_file(name: str = "byte_bpe_50k.json", path: str | None = None) -> bytes:
    """The vocabulary file: path if given, else of the installed package of public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        spec = f.read(MAX_FILE + 1)
    if len(spec) > MAX_FILE:
        raise ValueError("the vocabulary file is too large to be sent to executors")
    return spec


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens; strings that look like such are ordinary text. Null
    and empty texts give an empty list; white space is text. One pass without a shuffle; the vocabulary file (at most
    MAX_FILE bytes) is broadcast. Repeated rows stay repeated; other columns play no part."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_file(path=path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for rb in batches:
            enc = enc or Encoder(Merges(spec.value))
            for at in range(0, rb.num_rows, 256):
                part = rb.slice(at, 256)
                flat, ends = array("i"), [0]
                for text in part.column("text"):
                    flat.extend(enc.ids(text.as_py()))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids], ["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, path: str | None = None) -> DataFrame:
    """(id, text) of every row of ids. A null list gives an empty text; a null or unknown id raises."""
    spec = rows.sparkSession.sparkContext.broadcast(vocabulary_file(path=path))
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = None
        for rb in batches:
            text = text or Merges(spec.value).text
            out = []
            for ids in rb.column("ids").to_pylist():
                d = Decoder(text)
                out.append(d.push(ids or []) + d.finish())
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
