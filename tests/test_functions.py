"""Predicates, scalars and codecs against plain Python."""

import gzip
import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerspark.functions import codec as C
from ledgerspark.functions import predicates as P
from ledgerspark.functions import scalars as X


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_ref_names(spark):
    good = ["refs/heads/main", "refs/tags/v1.0", "refs/heads/a/b-c_d", "refs/heads/ü"]
    bad = ["refs/heads/../../x", "refs/heads/.hidden", "HEAD", "refs/", "refs/heads/a..b", "refs/heads/a@{b", "refs/heads/a.lock", "refs/heads/a.lock/b", "refs/heads/a b", "refs/heads/a.", "refs/heads//a", "refs/heads/a/", "refs/heads/a\x01", "refs/heads/a^", "refs/heads/a\\b", "", "refs/heads/a[", "refs/heads/a\x7f"]
    assert col(spark, good + bad, P.valid_ref_name("v")) == [True] * len(good) + [False] * len(bad)


def test_other_names(spark):
    assert col(spark, ["a", "a.b-c", "..", "api", "-a", "", "a" * 100, "a" * 101, "a/b"], P.valid_repo_id("v")) == [True, True, False, False, False, False, True, False, False]
    assert col(spark, ["pack-1.pack", "refs/wal/1.json", "/a", "a//b", "a/./b", "a/../b", "a\\b", "", "x" * 513, "a/", "a\x1f"], P.valid_blob_name("v")) == [True, True] + [False] * 9
    assert col(spark, ["", "refs/", "refs/w", "../x", "a/..", "/a", "a\\"], P.valid_prefix("v")) == [True, True, True, False, False, False, False]
    bad = [".git/hooks/x", "a/.git/x", ".GIT/x", ".git./x", "a\x00", "", "a//b", "a/../b", "git~1", ".git::$INDEX/x", ".g​it".replace("​", "‌")]
    assert col(spark, ["a.txt", "a/b", ".github/x", "git/x", *bad], P.valid_tree_path("v")) == [True] * 4 + [False] * len(bad)
    assert col(spark, ["1.bundle", ".bundle", "a.bundle", "12.bundle.x"], P.valid_bundle_name("v")) == [True, False, False, False]
    assert col(spark, ["example.org", "localhost", "a.localhost.", "x.internal", "METADATA", "notlocalhost"], P.host_allowed("v")) == [True, False, False, False, False, False]
    assert col(spark, ["/api/repos/x/commits", "/api/repos/x/imports"], P.cacheable_path("v")) == [True, False]


def test_grants(spark):
    rows = [(["git:write"], None, "git:read", "r", True), (["git:read"], None, "git:write", "r", False), (["git:read"], "r", "git:read", "q", False), (["git:read"], "r", "git:read", None, False), ([], None, "git:read", "r", False), (None, None, "git:read", "r", False), (["git:read"], "", "git:read", "", True)]
    df = spark.createDataFrame(rows, "s array<string>, o string, w string, r string, want boolean")
    assert all(x.want == x.got for x in df.select("want", P.scope_allows("s", "o", "w", "r").alias("got")).collect())
    hooks = spark.createDataFrame([(True, ["push"], True), (True, ["*"], True), (False, ["push"], False), (True, [], False), (None, ["push"], False), (True, None, False)], "a boolean, e array<string>, want boolean")
    assert all(x.want == x.got for x in hooks.select("want", P.hook_matches("a", "e", F.lit("push")).alias("got")).collect())


def test_ids_and_encodings(spark):
    assert col(spark, ["hello\n"], X.object_id("blob", "v")) == ["ce013625030ba8dba906f756967f9e9ca394464a"]
    assert col(spark, [""], X.object_id("tree", "v")) == ["4b825dc642cb6eb9a060e54bf8d69288fbee4904"]
    long = "ü" * 300
    assert col(spark, [long, "", None], X.unb64(X.b64("v")).cast("string")) == [long, "", None]
    assert col(spark, ["!!", "YQ=="], X.unb64("v").cast("string")) == [None, "a"]
    assert col(spark, [long], X.crc32("v")) == [zlib.crc32(long.encode())]
    assert col(spark, [long], X.trailer("v")) == [long.encode()[-20:].hex()]
    assert col(spark, ["ab", ""], X.pkt_line("v")) == ["0006ab", "0004"]


def test_paths_and_idents(spark):
    assert col(spark, ["a/b", "/a//b/", "a/./b", "a/x/../b", "..", "a/../..", "", "."], X.clean_path("v")) == ["a/b", "a/b", "a/b", "a/b", "", "", "", ""]
    assert col(spark, ["refs/heads/a/b", "refs/namespaces/eph/heads/j", "refs/tags/v", "HEAD"], X.short_name("v")) == ["a/b", "j", "v", "HEAD"]
    assert col(spark, ["  A <b>\n.", "x", "'\"q\"'"], X.clean_ident("v")) == ["A b", "x", "q"]
    got = col(spark, ["A B <a@b> 12 +0000", "no brackets", "N <e>", "N <e> x y"], X.parse_ident("v"))
    assert [tuple(g) for g in got] == [("A B", "a@b", 12), ("no brackets", "", 0), ("N", "e", 0), ("N", "e", 0)]
    assert col(spark, ["object abc\ntype commit\n\nobject no", "type x\n\nobject no"], X.tag_target("v")) == ["abc", None]
    recs = col(spark, ["\x1e".join(["", "\x00".join("abcdefg"), "a\x00b"])], X.log_record("v"))[0]
    assert [tuple(r) for r in recs] == [tuple("abcdefg")]
    entries = col(spark, ["100644 blob ab12 12\tx y\x00040000 tree cd34 -\tdir\x00junk"], X.tree_record("v"))[0]
    assert [tuple(e) for e in entries] == [("100644", "blob", "ab12", 12, "x y"), ("040000", "tree", "cd34", 0, "dir")]


def test_times_and_defaults(spark):
    assert col(spark, [1, 2, 3, 4, 5, 0, None], X.next_wait("v"), "int") == [30, 120, 600, 3600, None, None, None]
    assert col(spark, ["", None, "x"], X.default_to("v", "main")) == ["main", "main", "x"]
    assert col(spark, ["a b", "", None], F.size(X.split_words("v")))[:2] == [2, 0]
    assert col(spark, [0, 5, None], X.from_epoch("v").cast("string"), "long") == [None, "1970-01-01 00:00:05", None]
    assert col(spark, [50, 0], X.percent_used("v", F.lit(200)), "long") == [75, 100]


def vint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def pack_of(*bodies):
    raw = b"PACK" + struct.pack(">II", 2, len(bodies)) + b"".join(bodies)
    return raw + hashlib.sha1(raw).digest()


def test_pack_round_trip_and_index():
    objects = [("blob", b"hello\n"), ("blob", bytes(range(256)) * 900), ("blob", b""), ("tag", b"object x\n\n")]
    wire = C.write_pack(objects)
    got = C.read_pack(wire)
    assert [(p.kind, p.data) for p in got] == objects and got[0].oid == "ce013625030ba8dba906f756967f9e9ca394464a"
    index = C.write_index(got, wire[-20:])
    assert sorted(C.read_index(index)) == sorted((p.oid, p.crc, p.offset) for p in got)
    assert struct.unpack(">256I", index[8:1032])[-1] == len(objects)


def test_deltas():
    base = b"abcdefgh" * 100
    want = base[:500] + b"XYZ"
    delta = vint(len(base)) + vint(len(want)) + bytes([0xB0, 500 & 255, 500 >> 8, 3]) + b"XYZ"
    assert C.apply_delta(base, delta) == want
    whole = C.head(3, len(base)) + zlib.compress(base)
    back = len(whole)
    ofs = bytes([(back >> 7) - 1 | 128, back & 127]) if back > 127 else bytes([back])
    a = pack_of(whole, C.head(6, len(delta)) + ofs + zlib.compress(delta))
    assert [p.data for p in C.read_pack(a)] == [base, want]
    thin = pack_of(C.head(7, len(delta)) + bytes.fromhex(C.oid_of("blob", base)) + zlib.compress(delta))
    give = lambda o: ("blob", base) if o == C.oid_of("blob", base) else None
    assert C.read_pack(thin, give)[0].data == want
    assert C.read_pack(C.complete_pack(thin, give))[0].data == want
    with pytest.raises(ValueError):
        C.read_pack(thin)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_hostile_bytes_never_escape(data):
    for f in (C.read_pack, C.read_index, C.read_bundle, C.parse_tree, C.parse_commit, C.frames, C.parse_push, C.inflate):
        try:
            f(data)
        except ValueError:
            pass
    try:
        C.apply_delta(b"base", data)
    except ValueError:
        pass


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["blob", "tree", "commit", "tag"]), st.binary(max_size=300)), max_size=8))
def test_any_pack_comes_back(objects):
    assert [(p.kind, p.data) for p in C.read_pack(C.write_pack(objects))] == objects


def test_texts_of_the_wire():
    push = b"0077" + b"0" * 40 + b" " + b"1" * 40 + b" refs/heads/main\0side-band ofs"
    push = (b"%04x" % (len(push))) + push[4:] + b"0000PACK"
    cmds, caps, at = C.parse_push(push)
    assert cmds == [("0" * 40, "1" * 40, "refs/heads/main")] and caps == ["side-band", "ofs"] and push[at:] == b"PACK"
    fetch = C.parse_fetch(["command=fetch", "agent=x", "want " + "a" * 40, "have " + "b" * 40, "deepen 1", "done\n"])
    assert fetch == {"wants": ["a" * 40], "haves": ["b" * 40], "done": True, "include_tag": False, "depth": 1}
    assert C.parse_fetch(["want " + "a" * 40, "filter blob:none"]) is None and C.parse_fetch(["done"]) is None
    refs, pack = C.read_bundle(C.write_bundle([("refs/heads/b", "2" * 40), ("refs/heads/a", "1" * 40)], b"PACK"))
    assert refs == [("refs/heads/a", "1" * 40), ("refs/heads/b", "2" * 40)] and pack == b"PACK"
    with pytest.raises(ValueError):
        C.read_bundle(b"# v2 git bundle\n-" + b"1" * 40 + b"\n\n")
    assert C.capability_ok(b"s", "r", "n", 10, C.capability(b"s", "r", "n", 10), 10) and not C.capability_ok(b"s", "r", "n", 10, C.capability(b"s", "r", "n", 10), 11)
    tree = b"40000 dir\0" + bytes(20) + b"100755 run\0" + bytes([1] * 20)
    assert C.parse_tree(tree) == [("040000", "tree", "00" * 20, "dir"), ("100755", "blob", "01" * 20, "run")]
    assert C.parse_tree(tree[:-1], lenient=True) == C.parse_tree(tree)[:1]
    assert C.edges("tree", tree) == [("entry", "00" * 20), ("entry", "01" * 20)]
    assert C.maybe_gunzip(gzip.compress(b"x")) == b"x" == C.maybe_gunzip(b"x") and C.gzip_if_smaller(b"x") == b"x" and C.maybe_gunzip(C.gzip_if_smaller(b"x" * 999)) == b"x" * 999


def test_codec_columns(spark):
    df = spark.createDataFrame([(b"x" * 100,), (b"",), (None,)], "b binary")
    assert [r.x for r in df.select(C.gunzip_col(C.gzip_col("b")).alias("x")).collect()] == [b"x" * 100, b"", None]
    assert [r.x for r in df.select(C.inflate_col("b").alias("x")).collect()][::2] == [None, None]
    one = spark.createDataFrame([("s", "body"), (None, "b")], "k string, b string")
    assert [r.x for r in one.select(C.sign_col("k", "b").alias("x")).collect()] == [C.sign(b"s", b"body"), None]
