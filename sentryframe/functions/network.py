"""Column functions over addresses.

Both families are decided by patterns inside generated code; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"

# Ranges that are not public (fixed values, as Python's ipaddress reads the registries):
# 0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.0.0/24 without .9 and .10, 192.0.2/24,
# 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 224/4 and 240/4.
NON_PUBLIC_V4 = (
    r"^(?:0\.|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\."
    r"|192\.0\.0\.(?!(?:9|10)$)|192\.0\.2\.|192\.168\.|198\.1[89]\.|198\.51\.100\."
    r"|203\.0\.113\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)"
)

_H = r"[0-9a-f]{1,4}"
# RFC 4291 text: eight groups, or one "::" beside at most seven; a dotted tail counts as two.
IPV6 = (
    rf"^(?:(?:{_H}:){{6}}(?:{_H}:{_H}|{IPV4})"
    rf"|(?!(?:\W*\b\w+\b){{8}})(?:{_H}(?::{_H})*)?::(?:(?:{_H}:)*{_H})?"
    rf"|(?!(?:\W*\b\w+\b){{10}})(?:{_H}(?::{_H})*)?::(?:{_H}:)*{IPV4})$"
)
# Only 2000::/3 and the former site-local fec0::/10 can be public.  Inside the first 2001::/23, 2001:db8::/32 and
# 2002::/16 are special; 2001:1::1, 2001:1::2, 2001:3::/32, 2001:4:112::/48, 2001:20::/28 and
# 2001:30::/28 are public again (fixed values).  Mapped IPv4 lies outside and is not public.
GLOBAL_V6 = r"^(?:[23][0-9a-f]{3}|fe[c-f][0-9a-f]):"
SPECIAL_V6 = r"^(?:2001:(?::|0{0,2}[0-9a-f]{1,2}:|0?1[0-9a-f]{2}:|0?db8:)|2002:)"
PUBLIC_AGAIN_V6 = (
    r"^2001:(?:0{0,3}1::0{0,3}[12]$|0{0,3}3:|0{0,3}4:0?112:|0{0,2}[23][0-9a-f]:)"
)


def is_public_ip(address: Column) -> Column:
    """True for a routable public address; false for private, special or invalid text."""
    plain = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    v6 = F.regexp_replace(plain, "%.+$", "")
    return F.when(
        plain.contains(":"),
        v6.rlike(IPV6) & v6.rlike(GLOBAL_V6) & (~v6.rlike(SPECIAL_V6) | v6.rlike(PUBLIC_AGAIN_V6)),
    ).otherwise(plain.rlike(f"^{IPV4}$") & ~plain.rlike(NON_PUBLIC_V4))
