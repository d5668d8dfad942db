"""Boolean column expressions over names, paths, hosts and grants. All are built-in expressions: they stay in generated
code, and constant prefixes reach the scan. A null operand gives null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name rules.
REPO_ID = r"^[a-zA-Z0-9][a-zA-Z0-9._-]{0,99}$"
REF_BAD_CHARS = r"[\x00-\x20\x7f~^:?*\[\\]"
REF_BAD_PARTS = r"\.\.|@\{|(^|/)\.|//|/$|\.lock(/|$)|\.$"
BUNDLE_NAME = r"^[0-9]+\.bundle$"
LARGE_OID = r"^[a-f0-9]{64}$"
FULL_OID = r"^[0-9a-f]{40}$"
REVISION = r"^[0-9a-f]{4,64}$"
MAX_KEY_BYTES = 512
# Path segments whose answers depend on refs and packs only.
CACHED_SEGMENTS = ["/contents", "/commits", "/branches", "/tags", "/tree", "/git/", "/diff"]
# Host names that are internal, by suffix and as a whole.
INTERNAL_SUFFIXES = ["localhost", ".localhost", ".internal", ".flycast", ".local", ".consul", ".home.arpa"]
INTERNAL_HOSTS = ["fly-local-6pn", "metadata", "instance-data"]
# Code points that a case-folding file system ignores in names.
IGNORED_CODE_POINTS = (
    "\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u206a\u206b\u206c"
    "\u206d\u206e\u206f\u2060\u00ad\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\ufeff"
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def has_any_prefix(name: Column | str, prefixes: Sequence[str]) -> Column:
    """Whether name begins with one of the prefixes; without prefixes everything passes."""
    return any_of([_c(name).startswith(p) for p in prefixes]) if prefixes else F.lit(True)


def valid_ref_name(name: Column | str) -> Column:
    n = _c(name)
    return n.startswith("refs/") & ~n.rlike(REF_BAD_CHARS) & ~n.rlike(REF_BAD_PARTS)


def valid_repo_id(repo: Column | str) -> Column:
    r = _c(repo)
    return r.rlike(REPO_ID) & (r != "..") & (r != "api")


def valid_blob_name(name: Column | str) -> Column:
    """A relative name of at most 512 bytes without backslashes, control bytes and empty or dot segments."""
    n = _c(name)
    return (n != "") & (F.octet_length(n) <= MAX_KEY_BYTES) & ~n.rlike(r"[\x00-\x1f\x7f\\]") & ~n.rlike(r"(^|/)(\.|\.\.)?(/|$)")


def valid_prefix(prefix: Column | str) -> Column:
    """A prefix may end within or after a segment; empty means everything."""
    p = _c(prefix)
    return ~p.startswith("/") & ~p.contains("\\") & ~p.rlike(r"(^|/)\.\.?(/|$)")


#: The name of the metadata folder or one of its short ones, with what file systems drop: ignored code points anywhere in
#: the long name, dots and blanks at the end, and a stream's name after a colon.
_METADATA = "(?is)^(?:git~[12]|{0}*{1}{0}*)(?::.*|[. ]*)\\z".format(f"[{IGNORED_CODE_POINTS}]", f"[{IGNORED_CODE_POINTS}]*".join([r"\.", "g", "i", "t"]))


def is_dot_git(component: Column | str) -> Column:
    """The spellings of the metadata folder that some file system takes for it."""
    return _c(component).rlike(_METADATA)


def valid_tree_path(path: Column | str) -> Column:
    """Every component is non-empty, no dot name, without control bytes and no spelling of the metadata folder."""
    p = _c(path)
    parts = F.split(p, "/")
    return ~p.rlike(r"[\x00-\x1f\x7f]") & ~F.exists(parts, lambda x: x.isin("", ".", "..") | is_dot_git(x))


def hook_matches(active: Column | str, events: Column | str, event: Column | str) -> Column:
    """Active, and subscribed to the event or to all. Null operands count as not matching."""
    e = _c(events)
    hit = F.array_contains(e, _c(event)) | F.array_contains(e, F.lit("*"))
    return F.coalesce(_c(active) & hit, F.lit(False))


def scope_allows(scopes: Column | str, only_repo: Column | str, scope: Column | str, repo: Column | str, implied: dict[str, str] | None = None) -> Column:
    """Whether a grant covers (scope, repo): a grant for one repo is confined to it, and a scope may imply another
    (by default writing implies reading). implied maps the implied scope to the one that implies it."""
    s = _c(scope)
    within = F.coalesce(_c(only_repo), F.lit("")).isin("") | (_c(only_repo) == F.coalesce(_c(repo), F.lit("")))
    hit = F.array_contains(_c(scopes), s)
    for weak, strong in (implied or {"git:read": "git:write"}).items():
        hit = hit | ((s == weak) & F.array_contains(_c(scopes), F.lit(strong)))
    return F.coalesce(within & hit, F.lit(False))


def not_modified(etag: Column | str, seen: Column | str) -> Column:
    """Conditional read: the reader's tag equals the current one."""
    return F.coalesce(_c(etag) == _c(seen), F.lit(False))


def cacheable_path(path: Column | str) -> Column:
    return any_of([_c(path).contains(s) for s in CACHED_SEGMENTS])


#: A host of the inner network, in lower case: a listed one, one that ends in a listed suffix, or is one but for its dot; a
#: final dot aside.
_INTERNAL = r"(?s)^(?:{}|{}|.*(?:{}))\.?\z".format(*["|".join(map(re.escape, x)) for x in (INTERNAL_HOSTS, [x.removeprefix(".") for x in INTERNAL_SUFFIXES], INTERNAL_SUFFIXES)])


def host_allowed(host: Column | str) -> Column:
    return ~F.lower(_c(host)).rlike(_INTERNAL)


def valid_bundle_name(name: Column | str) -> Column:
    return _c(name).rlike(BUNDLE_NAME)


def valid_large_oid(oid: Column | str) -> Column:
    return _c(oid).rlike(LARGE_OID)


def is_full_oid(oid: Column | str) -> Column:
    return _c(oid).rlike(FULL_OID)
