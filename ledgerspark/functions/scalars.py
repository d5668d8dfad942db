"""Scalar column expressions: ids and digests, encodings, names, times, JSON. Built-in expressions throughout; the few
functions that Spark lacks are in ledgerspark.functions.codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.keys import ZERO_OID

# Waits between attempts, in seconds.
BACKOFF = [30, 120, 600, 3600]
EPHEMERAL = "refs/namespaces/eph/"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def object_id(kind: str, data: Column | str) -> Column:
    """Content id of an object: SHA-1 of its kind, size and bytes."""
    d = _c(data).cast("binary")
    head = F.concat(F.lit(f"{kind} "), F.octet_length(d).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), d))


def sha256_hex(data: Column | str) -> Column:
    return F.sha2(_c(data).cast("binary"), 256)


def crc32(data: Column | str) -> Column:
    return F.crc32(_c(data).cast("binary"))


def b64(data: Column | str) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(_c(data).cast("binary")), r"\s", "")


def unb64(text: Column | str) -> Column:
    """Bytes of a base64 text, null if it is none."""
    return F.try_to_binary(_c(text), F.lit("base64"))


def hex_lower(data: Column | str) -> Column:
    return F.lower(F.hex(_c(data).cast("binary")))


def trailer(data: Column | str, n: int = 20) -> Column:
    """The last n bytes, as hex."""
    return F.lower(F.right(F.hex(_c(data).cast("binary")), F.lit(2 * n)))


def is_hex(text: Column | str, n: int = 40) -> Column:
    return _c(text).rlike(f"^[0-9a-f]{{{n}}}$")


def short_name(ref: Column | str) -> Column:
    """A ref without its ephemeral namespace and kind (heads or tags)."""
    r = _c(ref)
    r = F.when(r.startswith(EPHEMERAL), F.concat(F.lit("refs/"), F.substring(r, len(EPHEMERAL) + 1, 10_000))).otherwise(r)
    return F.regexp_replace(r, "^refs/(heads|tags)/", "")


def is_ephemeral(ref: Column | str) -> Column:
    return _c(ref).startswith(EPHEMERAL)


def branch_ref(name: Column | str, ephemeral: Column | bool = False) -> Column:
    e = F.lit(ephemeral) if isinstance(ephemeral, bool) else ephemeral
    return F.concat(F.when(e, EPHEMERAL).otherwise("refs/"), F.lit("heads/"), _c(name))


def tag_ref(name: Column | str) -> Column:
    return F.concat(F.lit("refs/tags/"), _c(name))


def without_suffix(name: Column | str, suffixes: list[str]) -> Column:
    """The name without the first of the suffixes that it has."""
    n = _c(name)
    out = F.when(F.lit(False), n)
    for s in suffixes:
        out = out.when(n.endswith(s), F.substring(n, F.lit(1), F.length(n) - len(s)))
    return out.otherwise(n)


def clean_path(path: Column | str) -> Column:
    """A path without empty and dot segments, .. resolved; the empty text for the root and for paths that climb out."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(a: Column, x: Column) -> Column:
        up = x == ".."
        at = F.when(up & (F.size(a["at"]) > 0), F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0)))).when(up | x.isin("", "."), a["at"]).otherwise(F.concat(a["at"], F.array(x)))
        return F.struct(at.alias("at"), (a["out"] | (up & (F.size(a["at"]) == 0))).alias("out"))

    return F.aggregate(F.split(_c(path), "/"), start, step, lambda a: F.when(a["out"], "").otherwise(F.array_join(a["at"], "/")))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def clean_ident(text: Column | str) -> Column:
    """A name or address that may stand in an author line: no angle brackets, line ends and zero bytes, and no dots,
    commas, quotes or blanks at its ends."""
    t = F.regexp_replace(_c(text), r"[\x00\n\r<>]", "")
    return F.regexp_replace(F.regexp_replace(t, r"""^[\x00-\x20.,:;'"]+""", ""), r"""[\x00-\x20.,:;'"]+$""", "")


def parse_ident(text: Column | str) -> Column:
    """struct(name, email, ts) of "Name <email> seconds zone"; without brackets the whole text is the name."""
    t = _c(text)
    pattern = r"(?s)^([^<]*)<(.*?)>(.*)$"
    there = t.rlike(pattern)
    ts = F.regexp_extract(F.regexp_extract(t, pattern, 3), r"^\s*(-?\d+)(\s|$)", 1)
    return F.struct(
        F.when(there, F.trim(F.regexp_extract(t, pattern, 1))).otherwise(F.trim(t)).alias("name"),
        F.when(there, F.regexp_extract(t, pattern, 2)).otherwise("").alias("email"),
        F.coalesce(F.when(there & (ts != ""), ts.try_cast("long")), F.lit(0)).cast("long").alias("ts"),
    )


def format_ident(name: Column | str, email: Column | str, ts: Column | str) -> Column:
    return F.concat(clean_ident(name), F.lit(" <"), clean_ident(email), F.lit("> "), _c(ts).cast("string"), F.lit(" +0000"))


def tag_target(text: Column | str) -> Column:
    """The object that an annotated tag names, null without one before the first empty line."""
    head = F.element_at(F.split(_c(text), "\n\n"), 1)
    got = F.regexp_extract(head, r"(?m)^object (\S+)", 1)
    return F.when(got != "", got)


def log_record(text: Column | str) -> Column:
    """array<struct> of records parted by 0x1e with seven fields parted by 0x00; other records are skipped."""
    fields = F.filter(F.transform(F.split(_c(text), "\x1e"), lambda r: F.split(F.regexp_replace(r, r"^[\r\n]+", ""), "\x00")), lambda f: F.size(f) == 7)
    names = ["sha", "tree", "parents", "author", "email", "ts", "message"]
    return F.transform(fields, lambda f: F.struct(*[f[i].alias(n) for i, n in enumerate(names)]))


def tree_record(text: Column | str) -> Column:
    """array<struct(mode, type, sha, size, path)> of listing records "mode type sha size TAB path" parted by 0x00; a
    size of - is 0."""
    pattern = r"(?s)^(\d+) (\w+) ([0-9a-f]+) +(-|\d+)\t(.*)$"
    rows = F.filter(F.split(_c(text), "\x00"), lambda r: r.rlike(pattern))
    part = lambda r, i: F.regexp_extract(r, pattern, i)
    return F.transform(
        rows,
        lambda r: F.struct(part(r, 1).alias("mode"), part(r, 2).alias("type"), part(r, 3).alias("sha"), F.when(part(r, 4) == "-", "0").otherwise(part(r, 4)).cast("long").alias("size"), part(r, 5).alias("path")),
    )


def pkt_line(text: Column | str) -> Column:
    """A text as a frame: four hex digits of its length with them, then the text."""
    t = _c(text)
    return F.concat(F.lpad(F.lower(F.hex(F.octet_length(t) + 4)), 4, "0"), t)


def split_words(text: Column | str) -> Column:
    """A space-joined list as an array; the empty text is the empty list."""
    return F.filter(F.split(_c(text), " "), lambda x: x != "")


def join_words(items: Column | str) -> Column:
    return F.array_join(_c(items), " ")


def from_epoch(seconds: Column | str) -> Column:
    """Seconds since 1970 as a timestamp without zone; 0 is none."""
    return F.timestamp_seconds(F.nullif(_c(seconds), F.lit(0))).cast("timestamp_ntz")


def to_epoch(at: Column | str) -> Column:
    return F.unix_timestamp(_c(at).cast("timestamp"))


def before_cutoff(at: Column | str, now: str, days: int) -> Column:
    return _c(at) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def next_wait(attempts: Column | str) -> Column:
    """Seconds to wait after so many attempts; null when there is no further one."""
    a = _c(attempts)
    waits = F.array(*[F.lit(b) for b in BACKOFF])
    return F.when((a >= 1) & (a <= len(BACKOFF)), F.element_at(waits, F.least(F.greatest(a, F.lit(1)), F.lit(len(BACKOFF)))))


def paced(now_s: Column | str, ran_s: Column | str, least_s: int, duty: int = 4) -> Column:
    """Earliest next start: the least interval, or duty times the run's duration if that is longer."""
    return _c(now_s) + F.greatest(F.lit(least_s), _c(ran_s) * duty)


def percent_used(free: Column | str, total: Column | str) -> Column:
    return F.when(_c(total) > 0, F.floor((_c(total) - _c(free)) * 100 / _c(total)).cast("int"))


def push_payload(repo: Column | str, ref: Column | str, old: Column | str, new: Column | str) -> Column:
    """JSON of one ref change."""
    o, n = F.coalesce(_c(old), F.lit(ZERO_OID)), F.coalesce(_c(new), F.lit(ZERO_OID))
    return F.to_json(
        F.struct(_c(repo).alias("repo"), short_name(ref).alias("ref"), is_ephemeral(ref).alias("ephemeral"), o.alias("before"), n.alias("after"), (o == ZERO_OID).alias("created"), (n == ZERO_OID).alias("deleted"))
    )


def stable_id(*parts: Column | str) -> Column:
    """Sixteen bytes of hex that only depend on the parts."""
    return F.substring(F.sha1(F.concat_ws("\x00", *[_c(p) for p in parts])), 1, 32)


def default_to(c: Column | str, value: object) -> Column:
    """The value for null and for the empty text."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(value))


def change_message(verb: str, n: Column | str, path: Column | str) -> Column:
    """Default message of a change: one path by name, several by number."""
    return F.when(_c(n) == 1, F.concat(F.lit(f"{verb} "), _c(path))).otherwise(F.format_string(f"{verb} %d file(s)", _c(n)))
