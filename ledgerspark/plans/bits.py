"""SQL texts of byte computations, for oracles: what the codecs do, said over lists of numbers."""

from __future__ import annotations

#: Start and factor of FNV-1a (64 bits), polynomial of CRC-32.
FNV_START, FNV_FACTOR, CRC = 14695981039346656037, 1099511628211, 3988292384


def byte_list(blob: str) -> str:
    """The bytes of a blob as a list of numbers."""
    return f"list_transform(range(octet_length({blob})), lambda i: ('0x' || substr(hex({blob}), (2 * i + 1)::int, 2))::bigint)"


def fnv(blob: str) -> str:
    """FNV-1a of a blob that isn't empty, as 16 hex digits."""
    n = f"list_reduce(list_prepend({FNV_START}::hugeint, list_transform({byte_list(blob)}, lambda b: b::hugeint)), lambda h, b: (xor(h, b) * {FNV_FACTOR}) % 18446744073709551616)"
    return f"printf('%08x', ({n} // 4294967296)::bigint) || printf('%08x', ({n} % 4294967296)::bigint)"


def hmac(key: str, body: str) -> str:
    """HMAC-SHA256 of a blob, as hex digits; key is a blob too."""
    k = f"hex(case when octet_length({key}) > 64 then unhex(sha256({key})) else {key} end)"
    pad = lambda x: f"unhex(array_to_string(list_transform(range(64), lambda i: printf('%02x', xor(('0x' || coalesce(nullif(substr({k}, (2 * i + 1)::int, 2), ''), '00'))::int, {x}))), ''))"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || {body})))"
