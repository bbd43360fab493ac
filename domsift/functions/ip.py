"""IP address text -> sortable keys, as pure Spark SQL expressions.

Both families share one 16-byte big-endian number line (IPv4 is placed in
the low four bytes, as a u32 widened to u128) and a separate version
column, so ``BETWEEN`` on ``BINARY`` (compared unsigned, byte by byte)
gives numeric order.  Nothing here runs Python per row.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# An IPv4 octet without leading zeros, and a dotted quad.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (keeps trees small)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _v4_number(s: Column) -> Column:
    parts = F.split(s, r"\.")
    return (
        parts.getItem(0).cast("bigint") * F.lit(16777216)
        + parts.getItem(1).cast("bigint") * F.lit(65536)
        + parts.getItem(2).cast("bigint") * F.lit(256)
        + parts.getItem(3).cast("bigint")
    )


def ipv4_int(col: Column | str) -> Column:
    """Dotted quad -> BIGINT in [0, 2^32), null when the text is not a valid IPv4."""
    return _let(F.trim(_c(col)), lambda s: F.when(s.rlike(IPV4_PATTERN), _v4_number(s)))


def _v4_tail_as_hex(s: Column) -> Column:
    """'…:a.b.c.d' -> '…:hhhh:hhhh' (two hex groups), else unchanged."""
    tail = _let(
        _v4_number(F.regexp_extract(s, r"([0-9.]+)$", 1)),
        lambda n: F.concat(
            F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535))))
        ),
    )
    return F.when(s.rlike(_V4_TAIL), F.concat(F.regexp_extract(s, r"^(.*:)", 1), tail)).otherwise(s)


def _groups_of(s: Column) -> Column:
    """Split at '::' into head and tail groups and pad the gap with zero groups."""
    empty = F.array().cast("array<string>")
    head = F.substring_index(s, "::", 1)
    tail = F.substring_index(s, "::", -1)
    head_groups = F.when(head == "", empty).otherwise(F.split(head, ":"))
    tail_groups = F.when(tail == "", empty).otherwise(F.split(tail, ":"))
    both = F.array(head_groups, tail_groups)
    return F.when(
        s.contains("::"),
        _let(
            both,
            lambda ht: F.when(
                F.size(ht.getItem(0)) + F.size(ht.getItem(1)) <= 7,
                F.concat(
                    ht.getItem(0),
                    F.array_repeat(F.lit("0"), F.lit(8) - F.size(ht.getItem(0)) - F.size(ht.getItem(1))),
                    ht.getItem(1),
                ),
            ).otherwise(F.array(F.lit("x"))),  # '::' must stand for at least one group
        ),
    ).otherwise(F.split(s, ":"))


def _v6_valid(s: Column, g: Column) -> Column:
    return (
        s.rlike(r"^[0-9a-f:]+$")
        & ~s.contains(":::")
        & ((F.length(s) - F.length(F.regexp_replace(s, "::", ""))) <= 2)
        & (F.size(g) == 8)
        & F.forall(g, lambda x: x.rlike(r"^[0-9a-f]{1,4}$"))
    )


def _v6_groups(col: Column | str) -> Column:
    """IPv6 text -> array of 8 lower-case hex groups, or null if invalid."""
    return _let(
        _v4_tail_as_hex(F.lower(F.trim(_c(col)))),
        lambda s: _let(_groups_of(s), lambda g: F.when(_v6_valid(s, g), g)),
    )


def ip_version(col: Column | str) -> Column:
    """4, 6 or null (invalid text)."""
    return _let(
        _c(col),
        lambda c: F.when(ipv4_int(c).isNotNull(), F.lit(4).cast("tinyint")).when(
            _v6_groups(c).isNotNull(), F.lit(6).cast("tinyint")
        ),
    )


def ip_key(col: Column | str) -> Column:
    """Address text -> BINARY(16) on the shared number line; null if invalid."""
    return _let(
        _c(col),
        lambda c: _let(
            ipv4_int(c),
            lambda n: F.when(n.isNotNull(), F.unhex(F.lpad(F.hex(n), 32, "0"))).otherwise(
                _let(
                    _v6_groups(c),
                    lambda g: F.unhex(F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")),
                )
            ),
        ),
    )


def version_of_key(text: Column | str, key: Column | str) -> Column:
    """4, 6 or null for an address whose ``ip_key`` is at hand (the text isn't parsed again)."""
    return F.when(_c(key).isNull(), F.lit(None)).when(_c(text).contains(":"), F.lit(6)).otherwise(F.lit(4)).cast("tinyint")


def key_from_ipv4_int(col: Column | str) -> Column:
    """BIGINT IPv4 number -> BINARY(16) key."""
    return F.unhex(F.lpad(F.hex(_c(col)), 32, "0"))


def ipv4_text(col: Column | str) -> Column:
    """BIGINT in [0, 2^32) -> dotted quad."""
    x = _c(col)
    return F.concat_ws(
        ".",
        F.shiftright(x, 24).bitwiseAND(F.lit(255)).cast("string"),
        F.shiftright(x, 16).bitwiseAND(F.lit(255)).cast("string"),
        F.shiftright(x, 8).bitwiseAND(F.lit(255)).cast("string"),
        x.bitwiseAND(F.lit(255)).cast("string"),
    )


# --- 16-byte key arithmetic (successor / predecessor), via two unsigned halves ---

_TWO64 = "18446744073709551616"


def _halves(key: Column) -> tuple[Column, Column]:
    hexed = F.lpad(F.hex(key), 32, "0")
    hi = F.conv(F.substring(hexed, 1, 16), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(hexed, 17, 16), 16, 10).cast("decimal(20,0)")
    return hi, lo


def _join_halves(hi: Column, lo: Column) -> Column:
    return F.unhex(
        F.concat(
            F.lpad(F.conv(hi.cast("string"), 10, 16), 16, "0"),
            F.lpad(F.conv(lo.cast("string"), 10, 16), 16, "0"),
        )
    )


def key_succ(col: Column | str) -> Column:
    """key + 1 (wraps to null past the top of the line)."""
    key = _c(col)
    hi, lo = _halves(key)
    lo1 = lo + F.lit(1)
    carry = lo1 == F.lit(_TWO64).cast("decimal(21,0)")
    new_hi = F.when(carry, hi + F.lit(1)).otherwise(hi)
    new_lo = F.when(carry, F.lit(0).cast("decimal(20,0)")).otherwise(lo1)
    return F.when(new_hi < F.lit(_TWO64).cast("decimal(21,0)"), _join_halves(new_hi, new_lo))


def key_pred(col: Column | str) -> Column:
    """key - 1 (null below zero)."""
    key = _c(col)
    hi, lo = _halves(key)
    borrow = lo == F.lit(0)
    new_hi = F.when(borrow, hi - F.lit(1)).otherwise(hi)
    new_lo = F.when(borrow, F.lit(_TWO64).cast("decimal(21,0)") - F.lit(1)).otherwise(lo - F.lit(1))
    return F.when(new_hi >= F.lit(0), _join_halves(new_hi, new_lo))


# --- networks (rule literals, parsed once on the driver) ---


@dataclass(frozen=True)
class Network:
    version: int
    lo: bytes
    hi: bytes
    text: str


def cidr_bounds(net: str) -> Network:
    """'10.0.0.0/8' -> Network(4, lo, hi).  Host bits are allowed (masked off)."""
    n = ipaddress.ip_network(str(net).strip(), strict=False)
    lo = int(n.network_address)
    hi = int(n.broadcast_address)
    return Network(n.version, lo.to_bytes(16, "big"), hi.to_bytes(16, "big"), str(n))


def ip_in_networks(ip_text: Column, networks: list[Network]) -> Column:
    """True when the address lies in any of the networks (family must match)."""
    if not networks:
        return F.lit(False)

    def test(vk: Column) -> Column:
        cond = F.lit(False)
        for net in networks:
            cond = cond | (
                (vk.getField("v") == F.lit(net.version))
                & vk.getField("k").between(F.lit(bytearray(net.lo)), F.lit(bytearray(net.hi)))
            )
        return F.coalesce(cond, F.lit(False))

    return _let(
        ip_text,
        lambda c: _let(
            _let(ip_key(c), lambda k: F.struct(version_of_key(c, k).alias("v"), k.alias("k"))), test
        ),
    )
