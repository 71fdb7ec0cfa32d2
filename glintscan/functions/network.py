"""Hosts, addresses and indicator strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glintscan import catalogue as K
from glintscan.functions.punycode import decoded_host
from glintscan.sqltext import ends_with_any


def url_host(url: Column) -> Column:
    """Host of an ``http(s)`` URL as the extraction pattern yields it."""
    return F.lower(F.regexp_extract(url, r"^https?://([a-zA-Z0-9._-]+)", 1))


def _number(part: Column) -> Column:
    """One part of an IPv4 literal: decimal, octal or hexadecimal; NULL if malformed."""
    digits = F.regexp_replace(part, r"^0[xX]?0*", "")
    in_base = lambda b: F.when(digits == "", F.lit(0).cast("bigint")).when(
        F.char_length(digits) <= 12, F.conv(digits, b, 10).try_cast("bigint")
    )
    return (
        F.when(F.rlike(part, F.lit(r"^0[xX][0-9a-fA-F]*\z")), in_base(16))
        .when(F.rlike(part, F.lit(r"^0[0-7]*\z")), in_base(8))
        .when(F.rlike(part, F.lit(r"^[1-9][0-9]*\z")), part.try_cast("bigint"))
    )


def is_numeric_host(host: Column) -> Column:
    """The last label is a number, so the host must be an IPv4 literal."""
    return F.rlike(host, F.lit(r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)\.?\z"))


def ipv4_value(host: Column) -> Column:
    """IPv4 literal (also short, octal and hex forms) as a number; NULL if not one."""
    parts = F.transform(F.split(F.regexp_replace(host, r"\.\z", ""), r"\."), _number)
    n = F.size(parts)
    head = F.slice(parts, 1, n - 1)
    last = F.element_at(parts, -1)
    room = F.pow(F.lit(256.0), 5 - n).cast("bigint")
    value = F.aggregate(
        head,
        F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(3).alias("k")),
        lambda a, x: F.struct(
            (a["v"] + x * F.pow(F.lit(256.0), a["k"]).cast("bigint")).alias("v"), (a["k"] - 1).alias("k")
        ),
        lambda a: a["v"],
    )
    fits = F.coalesce(F.forall(head, lambda x: F.coalesce(x <= 255, F.lit(False))) & (last < room), F.lit(False))
    return F.when(n.between(1, 4) & fits, value + last)


def is_public_ipv4(v: Column) -> Column:
    a, b, c = (F.shiftright(v, 24), F.shiftright(v, 16), F.shiftright(v, 8))
    return ~(
        (a == 10)
        | (F.shiftright(v, 20) == (172 << 4) + 1)
        | (b == (192 << 8) + 168)
        | (a == 127)
        | (b == (169 << 8) + 254)
        | (v == 0xFFFFFFFF)
        | (c == (192 << 16) + 2)
        | (c == (198 << 16) + (51 << 8) + 100)
        | (c == (203 << 16) + 113)
    )


def is_public_host(host: Column, address: Column) -> Column:
    """Can the host be an indicator: well-known hosts, local addresses and names with a malformed ``xn--`` label cannot."""
    quiet = host.isin(K.QUIET_HOSTS) | ends_with_any(host, K.QUIET_SUFFIXES)
    return F.when((host == "") | (host.isNotNull() & decoded_host(host).isNull()), False).when(
        is_numeric_host(host), F.coalesce(is_public_ipv4(address), F.lit(False))
    ).otherwise(~quiet)


def is_public_url(url: Column) -> Column:
    host = url_host(url)
    return is_public_host(host, ipv4_value(host))


RTLO = "‮"


def visual_spoofing(s: Column) -> Column:
    return (
        F.when(F.contains(s, F.lit(RTLO)), "RTLO")
        .when(F.contains(F.lower(s), F.lit("xn--")), "Punycode/Cyrillic")
        .when(F.rlike(s, F.lit("[\\x{400}-\\x{4FF}]")), "Punycode/Cyrillic")
    )


def defang(s: Column) -> Column:
    hx = F.replace(F.replace(s, F.lit("http://"), F.lit("hxxp://")), F.lit("https://"), F.lit("hxxps://"))
    spoofed = F.contains(s, F.lit("xn--")) | F.contains(s, F.lit(RTLO))
    return F.when(s.isNull(), "").when(spoofed, hx).otherwise(F.replace(hx, F.lit("."), F.lit("[.]")))


def url_id(url: Column) -> Column:
    """URL-safe base64 without padding."""
    plain = F.replace(F.base64(F.encode(url, "UTF-8")), F.lit("\r\n"), F.lit(""))
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*\z", "")


def platform(repo_url: Column) -> Column:
    host = F.lower(F.regexp_extract(repo_url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(F.rlike(host, F.lit(r"^(?:.*\.)?github\.com\z")), "github").when(
        F.rlike(host, F.lit(r"^(?:.*\.)?gitlab\.com\z")), "gitlab"
    )
