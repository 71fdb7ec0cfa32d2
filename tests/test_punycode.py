"""Decoding of internationalised labels against the codec of the standard library."""

import random

from pyspark.sql import functions as F

from glintscan.functions.network import is_public_url
from glintscan.functions.punycode import decoded_host, decoded_label


def plain(label):
    digits = label[4:].rsplit("-", 1)[-1]
    if not digits or not all(c.isascii() and (c.islower() or c.isdigit()) for c in digits):
        return None
    try:
        text = label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError):
        return None
    return None if any(0xD800 <= ord(c) <= 0xDFFF for c in text) else text


def test_labels(spark):
    rng = random.Random(5)
    words = ["bücher", "münchen", "пример", "例え", "ليهمابتكلموشعربي؟", "他们为什么不说中文", "3年b組金八先生", "パフィーdeルンバ", "a" * 40 + "é", "😀x", "-é-"]
    words += ["".join(rng.choices("abz09-éßжя中文ア😀", k=rng.randint(1, 20))) for _ in range(300)]
    labels = ["xn--" + w.encode("punycode").decode() for w in words if not w.isascii()]
    labels += ["xn--" + "".join(rng.choices("abcxyz0189-", k=rng.randint(0, 14))) for _ in range(300)]
    labels += ["xn--", "xn---", "xn--abc-", "xn--99999999", "xn--9999999999999999999999", "xn--a_b", "xn--\n"]
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select("x", decoded_label(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == {x: plain(x) for x in labels}
    assert sum(r.y is None for r in rows) > 50 and sum(r.y in words for r in rows) > 200


def test_hosts(spark):
    hosts = {"xn--bcher-kva.org": "bücher.org", "plain.org": "plain.org", "a.xn--99999999.org": None, "xn--.com": None, None: None}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(
        "h", decoded_host(F.col("h")).alias("d"), is_public_url(F.concat(F.lit("http://"), "h", F.lit("/x"))).alias("public")).collect()
    assert {r.h: r.d for r in rows} == hosts
    assert {r.h: r.public for r in rows} == {h: None if h is None else d is not None for h, d in hosts.items()}
