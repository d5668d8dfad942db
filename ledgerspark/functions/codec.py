"""Byte formats that SQL can't read: packed objects with deltas, their index, bundles, frames, signed and compressed
texts. Plain functions over bytes, and Arrow-batched pandas UDFs over columns of them.

A function raises ValueError on malformed input; a UDF gives null there. The size of one object is capped so that a hostile
file cannot fill a worker; the number of objects and their sum are not.
"""

from __future__ import annotations

import bisect
import difflib
import gzip
import hashlib
import hmac as _hmac
import re
import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

# Object kinds, magic numbers, caps.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFS_DELTA, REF_DELTA = 6, 7
PACK_MAGIC, INDEX_MAGIC, BUNDLE_MAGIC, GZIP_MAGIC = b"PACK", b"\xfftOc", b"# v2 git bundle\n", b"\x1f\x8b"
MAX_INFLATED = 64 << 20


@dataclass(frozen=True)
class Packed:
    """An object of a pack: content id, kind, bytes, and the place and checksum of its packed form."""

    oid: str
    kind: str
    data: bytes
    offset: int
    crc: int


def oid_of(kind: str, data: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(data)) + data).hexdigest()


def inflate(data: bytes, cap: int = MAX_INFLATED) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, cap + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(out) > cap:
        raise ValueError("too large")
    return out


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """Little-endian base 128: value and the place after it."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad number")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at


def read_head(data: bytes, at: int) -> tuple[int, int, int]:
    """Kind, size and the place after the head of a packed object."""
    if at >= len(data):
        raise ValueError("truncated")
    first = data[at]
    size, at = first & 15, at + 1
    if first & 0x80:
        more, at = read_varint(data, at)
        size |= more << 4
    return first >> 4 & 7, size, at


def head(kind: int, size: int) -> bytes:
    out = bytearray()
    b, size = kind << 4 | size & 15, size >> 4
    while size:
        out.append(b | 0x80)
        b, size = size & 0x7F, size >> 7
    out.append(b)
    return bytes(out)


def read_back_offset(data: bytes, at: int) -> tuple[int, int]:
    """Distance back to a delta's base: big-endian base 128 in which every further byte adds one."""
    value = -1
    while True:
        if at >= len(data) or value > 1 << 40:
            raise ValueError("bad offset")
        b = data[at]
        at += 1
        value = value + 1 << 7 | b & 0x7F
        if b < 0x80:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The bytes that a delta makes of its base: runs copied from the base and runs of its own."""
    n_base, at = read_varint(delta, 0)
    n_out, at = read_varint(delta, at)
    if n_base != len(base) or n_out > MAX_INFLATED:
        raise ValueError("delta of another base, or too large")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            given = [i for i in range(7) if op >> i & 1]
            if at + len(given) > len(delta):
                raise ValueError("truncated delta")
            value = sum(delta[at + k] << 8 * i for k, i in enumerate(given))
            at += len(given)
            start, n = value & 0xFFFFFFFF, value >> 32 or 0x10000
            if start + n > len(base):
                raise ValueError("copy beyond the base")
            out += base[start : start + n]
        elif op:
            if at + op > len(delta):
                raise ValueError("truncated delta")
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("bad delta")
        if len(out) > n_out:
            raise ValueError("delta gives too much")
    if len(out) != n_out:
        raise ValueError("delta gives too little")
    return bytes(out)


def read_pack(wire: bytes, base_of: Callable[[str], tuple[str, bytes] | None] | None = None) -> list[Packed]:
    """All objects of a pack, checked: version, counts, sizes and the trailing digest. Deltas are resolved pass by pass,
    against objects of the pack and, once these don't help any more, against base_of(oid)."""
    if len(wire) < 32 or wire[:4] != PACK_MAGIC or wire[-20:] != hashlib.sha1(wire[:-20]).digest():
        raise ValueError("no pack, or damaged")
    version, count = struct.unpack(">II", wire[4:12])
    if version not in (2, 3):
        raise ValueError("unknown version")
    at, end = 12, len(wire) - 20
    done: dict[int, Packed] = {}
    by_oid: dict[str, Packed] = {}
    waiting: list[tuple[int, int, object, bytes]] = []

    def put(offset: int, crc: int, kind: str, data: bytes) -> None:
        p = done[offset] = Packed(oid_of(kind, data), kind, data, offset, crc)
        by_oid.setdefault(p.oid, p)

    for _ in range(count):
        start = at
        kind, size, at = read_head(wire, at)
        base: object = None
        if kind == OFS_DELTA:
            back, at = read_back_offset(wire, at)
            base = start - back
        elif kind == REF_DELTA:
            base, at = wire[at : at + 20].hex(), at + 20
        elif kind not in KINDS:
            raise ValueError("unknown kind")
        if size > MAX_INFLATED:
            raise ValueError("object too large")
        d = zlib.decompressobj()
        try:
            # what an object of this size is packed into as a rule, so that the rest of a pack is not copied for each of them
            stop = min(end, at + size + (size >> 6) + 1024)
            data = d.decompress(wire[at:stop], size + 1)
            if not d.eof and len(data) <= size:
                data += d.decompress(d.unconsumed_tail + wire[stop:end], size + 1 - len(data))
                stop = end
        except zlib.error as e:
            raise ValueError(str(e)) from e
        if len(data) != size or not d.eof:
            raise ValueError("size differs")
        at = stop - len(d.unused_data)
        crc = zlib.crc32(wire[start:at])
        if base is None:
            put(start, crc, KINDS[kind], data)
        else:
            waiting.append((start, crc, base, data))
    if at != end:
        raise ValueError("bytes left over")
    outer: dict[str, tuple[str, bytes]] = {}
    while waiting:
        left = []
        for start, crc, base, delta in waiting:
            b = done.get(base) if isinstance(base, int) else by_oid.get(base)  # type: ignore[arg-type]
            if b is not None:
                put(start, crc, b.kind, apply_delta(b.data, delta))
            elif isinstance(base, str) and base in outer:
                put(start, crc, outer[base][0], apply_delta(outer[base][1], delta))
            else:
                left.append((start, crc, base, delta))
        if len(left) == len(waiting):
            lacking = {b for _, _, b, _ in left if isinstance(b, str) and b not in outer}
            found = {b: got for b in lacking if base_of and (got := base_of(b))}
            if not found:
                raise ValueError("a delta's base is missing")
            outer |= found
        waiting = left
    return [done[o] for o in sorted(done)]


def write_pack(objects: Iterable[tuple[str, bytes]]) -> bytes:
    """A pack of whole objects (kind, data)."""
    code = {v: k for k, v in KINDS.items()}
    body = [head(code[k], len(d)) + zlib.compress(d) for k, d in objects]
    out = PACK_MAGIC + struct.pack(">II", 2, len(body)) + b"".join(body)
    return out + hashlib.sha1(out).digest()


def complete_pack(wire: bytes, base_of: Callable[[str], tuple[str, bytes] | None]) -> bytes:
    """A pack that needs nothing outside: its objects, whole."""
    return write_pack((p.kind, p.data) for p in read_pack(wire, base_of))


def write_index(objects: Iterable[Packed], pack_digest: bytes) -> bytes:
    """Index of a pack: running counts by first byte, then ids, checksums and places in order of ids."""
    rows = sorted({p.oid: p for p in objects}.values(), key=lambda p: p.oid)
    ids = [bytes.fromhex(p.oid) for p in rows]
    # places from 2 GiB on stand in a list of their own
    large = [p.offset for p in rows if p.offset >> 31]
    at = {o: i for i, o in enumerate(large)}
    short = [1 << 31 | at[p.offset] if p.offset >> 31 else p.offset for p in rows]
    fan = [bisect.bisect_right(ids, bytes([b]) + b"\xff" * 19) for b in range(256)]
    out = INDEX_MAGIC + struct.pack(">I", 2) + struct.pack(">256I", *fan) + b"".join(ids)
    out += struct.pack(f">{len(rows)}I", *[p.crc for p in rows]) + struct.pack(f">{len(rows)}I", *short) + struct.pack(f">{len(large)}Q", *large) + pack_digest
    return out + hashlib.sha1(out).digest()


def read_index(data: bytes) -> list[tuple[str, int, int]]:
    """(oid, checksum, place) of every entry of an index."""
    if data[:8] != INDEX_MAGIC + b"\0\0\0\2" or len(data) < 1072:
        raise ValueError("no index")
    n = struct.unpack(">I", data[1028:1032])[0]
    if len(data) < 1032 + 28 * n + 40:
        raise ValueError("truncated")
    ids = [data[1032 + 20 * i : 1052 + 20 * i].hex() for i in range(n)]
    crc = struct.unpack(f">{n}I", data[1032 + 20 * n : 1032 + 24 * n])
    at = struct.unpack(f">{n}I", data[1032 + 24 * n : 1032 + 28 * n])
    large = data[1032 + 28 * n : -40]
    place = [struct.unpack(">Q", large[8 * (o & 0x7FFFFFFF) :][:8])[0] if o >> 31 else o for o in at]
    return list(zip(ids, crc, place, strict=True))


def find_place(index: bytes, oid: str) -> int | None:
    """Place of an object's packed form, from an index: the running counts of first bytes bound a binary search."""
    if index[:8] != INDEX_MAGIC + b"\0\0\0\2" or len(index) < 1072:
        raise ValueError("no index")
    key = bytes.fromhex(oid)
    fan = struct.unpack(">256I", index[8:1032])
    lo, hi, n = fan[key[0] - 1] if key[0] else 0, fan[key[0]], fan[255]
    i = bisect.bisect_left(range(hi), key, lo, hi, key=lambda j: index[1032 + 20 * j : 1052 + 20 * j])
    if i >= hi or index[1032 + 20 * i : 1052 + 20 * i] != key:
        return None
    at = struct.unpack(">I", index[1032 + 24 * n + 4 * i :][:4])[0]
    return struct.unpack(">Q", index[1032 + 28 * n + 8 * (at & 0x7FFFFFFF) :][:8])[0] if at >> 31 else at


def read_object(wire: bytes, index: bytes, oid: str) -> tuple[str, bytes] | None:
    """(kind, bytes) of one object of a pack, None if the index doesn't have it. Only the object is inflated, and what its
    deltas rest on, each once."""
    at = find_place(index, oid)
    if at is None:
        return None
    deltas: list[bytes] = []
    seen = set()
    while True:
        if at in seen or not 12 <= at < len(wire) - 20:
            raise ValueError("bad place, or deltas in a loop")
        seen.add(at)
        kind, size, body = read_head(wire, at)
        base: int | None = None
        if kind == OFS_DELTA:
            back, body = read_back_offset(wire, body)
            base = at - back
        elif kind == REF_DELTA:
            base, body = find_place(index, wire[body : body + 20].hex()), body + 20
            if base is None:
                raise ValueError("a delta's base is missing")
        elif kind not in KINDS:
            raise ValueError("unknown kind")
        data = inflate(wire[body : body + size + (size >> 6) + 1024], max(size, 1))
        if len(data) < size:
            data = inflate(wire[body:], max(size, 1))
        if len(data) != size:
            raise ValueError("size differs")
        if base is None:
            for d in reversed(deltas):
                data = apply_delta(data, d)
            return KINDS[kind], data
        deltas.append(data)
        at = base


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def apply_patch(text: str, diff: str) -> str:
    """A text after a unified diff of it. Every kept or removed line must be there as the diff has it, at its place;
    otherwise ValueError. "No newline at end of file" is understood; file headers are passed over."""
    old = re.findall(r"[^\n]*\n|[^\n]+", text)
    out: list[str] = []
    at = 0
    lines = diff.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    inside = False
    for i, line in enumerate(lines):
        if m := _HUNK.match(line):
            start = int(m[1]) - (m[2] != "0")
            if not at <= start <= len(old):
                raise ValueError("hunk out of place")
            out += old[at:start]
            at, inside = start, True
        elif not inside or line.startswith("\\"):
            continue
        else:
            sign, body = line[:1], line[1:]
            if not (i + 1 < len(lines) and lines[i + 1].startswith("\\")):
                body += "\n"
            if sign in (" ", "-"):
                if at >= len(old) or old[at] != body:
                    raise ValueError("the text differs from the diff")
                at += 1
            if sign in (" ", "+"):
                out.append(body)
            elif sign != "-":
                raise ValueError("bad line")
    return "".join(out + old[at:])


def read_bundle(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Refs (name, oid) and the pack of a bundle; one that needs objects from elsewhere is refused."""
    if not data.startswith(BUNDLE_MAGIC):
        raise ValueError("no bundle")
    top, sep, pack = data[len(BUNDLE_MAGIC) :].partition(b"\n\n")
    if not sep:
        raise ValueError("no end of the refs")
    refs = []
    for line in top.decode("utf-8", "replace").split("\n"):
        if line.startswith("-"):
            raise ValueError("needs other objects")
        oid, _, name = line.partition(" ")
        if len(oid) == 40 and name:
            refs.append((name, oid))
    return refs, pack


def write_bundle(refs: Iterable[tuple[str, str]], pack: bytes, without: Iterable[str] = ()) -> bytes:
    """Refs (name, oid) and a pack; `without` are the tips whose objects the reader must have already."""
    top = "".join(f"-{o}\n" for o in sorted(without)) + "".join(f"{o} {n}\n" for n, o in sorted(refs))
    return BUNDLE_MAGIC + top.encode() + b"\n" + pack


def parse_tree(data: bytes, lenient: bool = False) -> list[tuple[str, str, str, str]]:
    """(mode, type, sha, name) of a tree's entries; lenient drops a truncated rest instead of refusing it."""
    out, at = [], 0
    while at < len(data):
        nul = data.find(b"\0", at)
        space = data.find(b" ", at, nul)
        if nul < 0 or space < 0 or nul + 21 > len(data):
            if lenient:
                break
            raise ValueError("malformed tree")
        mode = data[at:space].decode("ascii", "replace").rjust(6, "0")
        kind = {"040000": "tree", "160000": "commit"}.get(mode, "blob")
        out.append((mode, kind, data[nul + 1 : nul + 21].hex(), data[space + 1 : nul].decode("utf-8", "replace")))
        at = nul + 21
    return out


def parse_commit(data: bytes) -> dict:
    """tree, parents, author, email, ts, committer_ts and message of a commit."""
    top, sep, message = data.decode("utf-8", "replace").partition("\n\n")
    out: dict = {"tree": None, "parents": [], "author": None, "email": None, "ts": 0, "committer_ts": 0, "message": message.strip()}
    for line in top.split("\n"):
        key, _, value = line.partition(" ")
        if key == "tree":
            out["tree"] = value
        elif key == "parent":
            out["parents"].append(value)
        elif key in ("author", "committer"):
            name, lt, rest = value.partition("<")
            email, gt, when = rest.partition(">")
            words = when.split()
            ts = int(words[0]) if lt and gt and words and words[0].lstrip("-").isdigit() else 0
            if key == "author":
                out |= {"author": name.strip() if lt and gt else value.strip(), "email": email if lt and gt else "", "ts": ts}
            else:
                out["committer_ts"] = ts
    if not sep or not out["tree"]:
        raise ValueError("malformed commit")
    return out


def edges(kind: str, data: bytes) -> list[tuple[str, str]]:
    """(kind of edge, oid) of everything an object names; submodules are none of the store's."""
    if kind == "commit":
        c = parse_commit(data)
        return [("tree", c["tree"]), *(("parent", p) for p in c["parents"])]
    if kind == "tree":
        return [("entry", sha) for _, k, sha, _ in parse_tree(data) if k != "commit"]
    if kind == "tag":
        for line in data.decode("utf-8", "replace").split("\n\n")[0].split("\n"):
            if line.startswith("object "):
                return [("object", line[7:].strip())]
    return []


def frames(data: bytes) -> list[bytes]:
    """Payloads of length-prefixed frames; flush and delimiter frames have none."""
    out, at = [], 0
    while at + 4 <= len(data):
        try:
            n = int(data[at : at + 4], 16)
        except ValueError as e:
            raise ValueError("bad frame") from e
        if n in (0, 1):
            at += 4
            continue
        if n < 4 or at + n > len(data):
            raise ValueError("bad frame")
        out.append(data[at + 4 : at + n])
        at += n
    return out


def parse_push(data: bytes) -> tuple[list[tuple[str, str, str]], list[str], int]:
    """Commands (old, new, ref), capabilities, and where the pack begins, of a push request."""
    cmds: list[tuple[str, str, str]] = []
    caps: list[str] | None = None
    at = 0
    while True:
        try:
            n = int(data[at : at + 4], 16)
        except ValueError as e:
            raise ValueError("bad frame") from e
        if n == 0:
            return cmds, caps or [], at + 4
        if n < 4 or at + n > len(data):
            raise ValueError("bad frame")
        line = data[at + 4 : at + n].decode("utf-8", "replace")
        at += n
        if line.startswith("shallow ") and caps is None:
            if len(line.rstrip("\n")) != 48:
                raise ValueError("bad boundary")
            continue
        if caps is None:
            line, _, extra = line.partition("\0")
            caps = extra.split()
        words = line.rstrip("\n").split()
        if len(words) != 3:
            raise ValueError("bad command")
        cmds.append((words[0], words[1], words[2]))


def parse_fetch(lines: Iterable[str]) -> dict | None:
    """wants, haves, done and depth of a fetch request; None if it asks for anything else than these and harmless
    options."""
    out: dict = {"wants": [], "haves": [], "done": False, "include_tag": False, "depth": 0}
    options = True
    for line in (x.removesuffix("\n") for x in lines):
        if options and (line in ("command=fetch", "object-format=sha1") or line.startswith("agent=")):
            continue
        options = False
        word, _, value = line.partition(" ")
        if word in ("want", "have") and len(value) == 40:
            out[word + "s"].append(value)
        elif line == "done":
            out["done"] = True
        elif line == "include-tag":
            out["include_tag"] = True
        elif word == "deepen" and value.isdigit() and int(value) > 0:
            out["depth"] = int(value)
        elif line not in ("thin-pack", "ofs-delta", "no-progress"):
            return None
    return out if out["wants"] else None


def sign(secret: bytes, body: bytes) -> str:
    return "sha256=" + _hmac.new(secret, body, hashlib.sha256).hexdigest()


def capability(secret: bytes, repo: str, name: str, expires: int) -> str:
    """Signature of a link to one file that holds until `expires`."""
    return _hmac.new(secret, f"{repo}:{name}:{expires}".encode(), hashlib.sha256).hexdigest()


def capability_ok(secret: bytes, repo: str, name: str, expires: int, signature: str, now: int) -> bool:
    return expires >= now and _hmac.compare_digest(capability(secret, repo, name, expires), signature)


def fnv1a64(data: bytes) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def maybe_gunzip(data: bytes, cap: int = MAX_INFLATED) -> bytes:
    """The bytes themselves, or unpacked if they begin like gzip, whatever the file is called."""
    if not data.startswith(GZIP_MAGIC):
        return data
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data, cap + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(out) > cap or not d.eof:
        raise ValueError("truncated or too large")
    return out


def gzip_if_smaller(data: bytes) -> bytes:
    packed = gzip.compress(data, mtime=0)
    return packed if len(packed) < len(data) else data


def _udf(f: Callable, kind: str) -> Callable:
    """A pandas UDF of one or two columns of bytes or texts; null in, or malformed, gives null."""

    def one(*args: object) -> object:
        if any(a is None for a in args):
            return None
        try:
            return f(*args)
        except ValueError:
            return None

    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in a], dtype=object)

    @F.pandas_udf(kind)
    def run2(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return lambda *cols: (run if len(cols) == 1 else run2)(*cols)


def gunzip_col(c):  # noqa: ANN001, ANN201
    return _udf(lambda b: maybe_gunzip(bytes(b)), "binary")(c)


def gzip_col(c):  # noqa: ANN001, ANN201
    return _udf(lambda b: gzip_if_smaller(bytes(b)), "binary")(c)


def inflate_col(c):  # noqa: ANN001, ANN201
    return _udf(lambda b: inflate(bytes(b)), "binary")(c)


def delta_col(base, delta):  # noqa: ANN001, ANN201
    return _udf(lambda b, d: apply_delta(bytes(b), bytes(d)), "binary")(base, delta)


def sign_col(secret, body):  # noqa: ANN001, ANN201
    return _udf(lambda s, b: sign(s.encode(), b.encode() if isinstance(b, str) else bytes(b)), "string")(secret, body)


def make_diff(old: str, new: str, context: int = 3) -> str:
    """A unified diff, as apply_patch() reads it."""
    cut = lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)
    out = []
    for line in difflib.unified_diff(cut(old), cut(new), "a", "b", n=context):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def diff_col(old, new):  # noqa: ANN001, ANN201
    return _udf(make_diff, "string")(old, new)


def patch_col(text, diff):  # noqa: ANN001, ANN201
    """apply_patch() of columns, null where the diff doesn't fit."""
    return _udf(lambda t, d: apply_patch(t, d), "string")(text, diff)


def index_col(idx):  # noqa: ANN001, ANN201
    """The ids that an index lists."""
    return _udf(lambda b: [o for o, _, _ in read_index(bytes(b))], "array<string>")(idx)


def bundle_refs_col(c):  # noqa: ANN001, ANN201
    """The refs of a bundle that needs nothing else, as {name, oid}."""
    return _udf(lambda b: [{"name": n, "oid": o} for n, o in read_bundle(bytes(b))[0]], "array<struct<name:string,oid:string>>")(c)


def fnv_col(c):  # noqa: ANN001, ANN201
    return _udf(lambda s: f"{fnv1a64(s.encode()):016x}", "string")(c)


def tree_col(c):  # noqa: ANN001, ANN201
    kind = "array<struct<mode:string,type:string,sha:string,name:string>>"
    return _udf(lambda b: [dict(zip(("mode", "type", "sha", "name"), e, strict=True)) for e in parse_tree(bytes(b))], kind)(c)


def edges_col(kind, data):  # noqa: ANN001, ANN201
    return _udf(lambda k, b: [{"kind": e, "oid": o} for e, o in edges(k, bytes(b))], "array<struct<kind:string,oid:string>>")(kind, data)


def frames_col(c):  # noqa: ANN001, ANN201
    return _udf(lambda b: [f.decode("utf-8", "replace") for f in frames(bytes(b))], "array<string>")(c)


def commit_col(c):  # noqa: ANN001, ANN201
    kind = "struct<tree:string,parents:array<string>,author:string,email:string,ts:bigint,committer_ts:bigint,message:string>"

    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.DataFrame:
        names = ["tree", "parents", "author", "email", "ts", "committer_ts", "message"]
        rows = []
        for x in a:
            try:
                rows.append(parse_commit(bytes(x)) if x is not None else dict.fromkeys(names))
            except ValueError:
                rows.append(dict.fromkeys(names))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"ts": "Int64", "committer_ts": "Int64"})

    return run(c)


def push_col(c):  # noqa: ANN001, ANN201
    def cmds(b: bytes) -> list[dict]:
        return [{"old": o, "new": n, "ref": r} for o, n, r in parse_push(bytes(b))[0]]

    return _udf(cmds, "array<struct<old:string,new:string,ref:string>>")(c)


def capability_col(secret: str, repo, name, expires):  # noqa: ANN001, ANN201
    """Link signatures; expires is a constant number of seconds."""
    return _udf(lambda r, n: capability(secret.encode(), r, n, expires), "string")(repo, name)
