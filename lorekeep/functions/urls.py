"""External URLs: parts, which of them can be checked, normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reserved IPv4 blocks
RESERVED_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "233.252.0.0/24",
    "240.0.0.0/4", "255.255.255.255/32",
]
# fixed values: hosts that only resolve inside one machine or one network
PRIVATE_HOSTS = ["localhost", "pi.hole", "ui.reclaim"]
PRIVATE_SUFFIXES = [".localhost", ".onion"]

_OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def url_part(url: Column, part: str) -> Column:
    """HOST, PROTOCOL, PATH, QUERY, REF or USERINFO; NULL for an invalid URL."""
    return F.try_parse_url(url, F.lit(part))


def url_host(url: Column) -> Column:
    return F.lower(url_part(url, "HOST"))


def _bound(value: Column, test) -> Column:
    """``test(value)`` with the value evaluated once, however often the test uses it."""
    return F.exists(F.array(value), test)


def ipv4_number(host: Column) -> Column:
    """Dotted quad as a number, NULL for anything else."""
    number = F.aggregate(
        F.split(host, r"\."), F.lit(0).cast("long"), lambda acc, part: acc * 256 + part.try_cast("long")
    )
    return F.when(host.rlike(_IPV4), number)


def _block_range(block: str) -> tuple[int, int]:
    address, bits = block.split("/")
    first = 0
    for octet in address.split("."):
        first = first * 256 + int(octet)
    return first, first + 2 ** (32 - int(bits)) - 1


def is_reserved_address(host: Column) -> Column:
    def reserved(number: Column) -> Column:
        hit = F.lit(False)
        for first, last in map(_block_range, RESERVED_BLOCKS):
            hit = hit | number.between(first, last)
        return hit

    return F.coalesce(host.rlike(_IPV4) & _bound(ipv4_number(host), reserved), F.lit(False))


def is_checkable(url: Column, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """Whether the URL names a public host that a checker may contact."""

    def public(host: Column) -> Column:
        private = host.isin(PRIVATE_HOSTS)
        for suffix in PRIVATE_SUFFIXES:
            private = private | F.endswith(host, F.lit(suffix))
        return F.contains(host, F.lit(".")) & ~private & ~is_reserved_address(host)

    # the cheap test on the text comes first
    wanted = F.lower(F.substring_index(url, ":", 1)).isin(list(schemes))
    good = wanted & _bound(url_host(url), public) & (F.coalesce(url_part(url, "USERINFO"), F.lit("")) == "")
    return F.coalesce(good, F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#[^#]*$", "")


def has_host(url: Column) -> Column:
    """Valid URL with a host; mail addresses need none."""
    return F.startswith(url, F.lit("mailto:")) | F.coalesce(url_part(url, "HOST") != "", F.lit(False))


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
