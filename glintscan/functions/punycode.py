"""Internationalised host names: labels of the form ``xn--...`` are decoded by a fold over their characters (RFC 3492)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of RFC 3492, section 5.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
PREFIX = "xn--"
LIMIT = 2**31


def _long(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, _long(b))


def adapted(delta: Column, points: Column, first: Column) -> Column:
    """The next bias. The division by 35 that the RFC repeats while a value is over 455 is done at once, by the number of repetitions."""
    start = F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))
    start = start + _div(start, points)
    step, over = BASE - T_MIN, (BASE - T_MIN) * T_MAX // 2
    times = sum(F.when(_div(start, step**j) > over, 1).otherwise(0) for j in range(6))
    left = _div(start, F.pow(F.lit(float(step)), times))
    return _long(times * BASE + _div((step + 1) * left, left + SKEW))


def decoded_label(label: Column) -> Column:
    """The text of a lower-case ``xn--`` label; NULL where it is malformed or holds nothing but ASCII."""
    encoded = F.substring(label, len(PREFIX) + 1, 2**31 - 1)
    basic = F.regexp_extract(encoded, r"^(.*)-[^-]*\z", 1)
    digits = F.regexp_extract(encoded, r"([^-]*)\z", 1)
    codes = F.transform(F.filter(F.split(basic, ""), lambda c: c != ""), lambda c: _long(F.ascii(c)))
    start = F.struct(
        codes.alias("out"), _long(FIRST_CODE).alias("n"), _long(0).alias("i"), _long(0).alias("before"), _long(1).alias("w"),
        _long(BASE).alias("k"), _long(FIRST_BIAS).alias("bias"), F.lit(True).alias("ok"))

    def step(a: Column, digit: Column) -> Column:
        t = F.greatest(_long(T_MIN), F.least(_long(T_MAX), a["k"] - a["bias"]))
        i, points = a["i"] + digit * a["w"], _long(F.size(a["out"]) + 1)
        n = a["n"] + _div(i, points)
        fine = (digit >= 0) & (i < LIMIT)
        code = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        keep = [a[c].alias(c) for c in ("out", "n", "i", "before", "w", "k", "bias")]
        wider = a["w"] * (BASE - t)
        place = i % points
        ended = F.struct(
            F.concat(F.slice(a["out"], F.lit(1), place.cast("int")), F.array(n), F.slice(a["out"], (place + 1).cast("int"), F.size(a["out"]))).alias("out"),
            n.alias("n"), (place + 1).alias("i"), (place + 1).alias("before"), _long(1).alias("w"), _long(BASE).alias("k"),
            adapted(i - a["before"], points, a["before"] == 0).alias("bias"), F.lit(True).alias("ok"))
        longer = F.struct(
            a["out"].alias("out"), a["n"].alias("n"), i.alias("i"), a["before"].alias("before"), wider.alias("w"), (a["k"] + BASE).alias("k"),
            a["bias"].alias("bias"), (wider < LIMIT).alias("ok"))
        failed = F.struct(*keep, F.lit(False).alias("ok"))
        return F.when(~a["ok"] | ~fine, failed).when(digit >= t, longer).when(code, ended).otherwise(failed)

    values = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: _long(
        F.when(c.between("a", "z"), F.ascii(c) - ord("a")).when(c.between("0", "9"), F.ascii(c) - ord("0") + 26).otherwise(-1)))
    text = lambda out: F.decode(F.unhex(F.array_join(F.transform(out, lambda n: F.lpad(F.hex(n), 8, "0")), "")), "UTF-32")
    whole = lambda a: a["ok"] & (a["k"] == BASE) & (F.size(a["out"]) > F.char_length(basic))
    return F.aggregate(values, start, step, lambda a: F.when(whole(a), text(a["out"])))


def decoded_host(host: Column) -> Column:
    """A lower-case host with its ``xn--`` labels decoded; NULL where one of them cannot be."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.when(F.startswith(x, F.lit(PREFIX)), decoded_label(x)).otherwise(x))
    return F.when(~F.contains(host, F.lit(PREFIX)), host).when(F.forall(labels, lambda x: x.isNotNull()), F.array_join(labels, "."))
