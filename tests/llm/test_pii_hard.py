"""Surrogates of hard inputs, and whole documents against entities found by other means."""

import ipaddress
import re

import pytest
import regex
from pyspark.sql import functions as F

from rollmill.llm import pii

N = 1_000_000
HARD = {
    "labels": "x@" + "a." * (N // 2) + "com", "local": "a" * N + "@b.co", "domain": "a@" + "q" * N, "at": "@" * N, "name": "Mr A" + "a" * N, "apostrophes": "Mr A" + "b'c" * (N // 3), "names": "Mr Ab " * (N // 6),
    "secret": "token=" + "Ab1" * (N // 3), "assigned": "key=" * (N // 4), "hex": "0f" * (N // 2), "digits": "1" * N, "dashed": "1-" * (N // 2), "dots": "1." * (N // 2), "phone": "+1 " * (N // 3), "iban": "DE89 " * (N // 5), "spaces": " " * N,
}


def safe(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.safe_text for r in sorted(pii.replace_pii(df).collect(), key=lambda r: r["__row"].doc_id)]


def test_no_pattern_recurses_over_a_million_characters(spark):
    df = spark.createDataFrame(list(HARD.items()), "k string, text string")
    found = {r.k: r.n for r in df.select("k", F.size(F.regexp_extract_all("text", F.lit(pii.ENTITY), F.lit(0))).alias("n")).collect()}
    assert found["local"] == found["name"] == found["apostrophes"] == found["secret"] == found["hex"] == 1 and found["names"] == N // 12
    assert found["at"] == found["spaces"] == found["domain"] == found["labels"] == 0


def test_long_texts_are_replaced(spark):
    hard = {k: v[:50_000] + "@b.co" * (k == "local") for k, v in HARD.items()}
    got = dict(zip(hard, safe(spark, list(hard.values())), strict=True))
    changed = {k for k in hard if got[k] != hard[k]}
    assert {"local", "name", "apostrophes", "names", "secret", "hex"} <= changed and not changed & {"at", "spaces", "domain", "labels"}
    assert got["local"].endswith(".co") and len(got["local"]) == len(hard["local"])


def test_a_format_that_is_used_up_grows(spark):
    mails = [f"{a}@{b}.io" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = safe(spark, mails)
    assert len(set(got)) == len(mails) and not set(got) & set(mails)
    assert all(re.fullmatch(r"[a-z]{1,29}@[a-z]\.io", g) for g in got)
    entities = spark.createDataFrame([("ip", f"127.0.0.{i}") for i in range(9)] + [("phone", str(i)) for i in range(10)], "type string, norm string")
    out = pii.surrogates(entities).collect()
    assert len({(r.type, r.surrogate) for r in out}) == 19 and not {r.surrogate for r in out} & {str(i) for i in range(10)}


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_codes_classes_and_check_digits_stay(spark):
    phones = ["+1 (310) 555-4510", "+49 30 1234 5678", "+44 20 7946 0958", "+420 222 333 444", "+7 495 123 4567", "(310) 555-4510"]
    ips = ["10.1.2.3", "192.168.7.9", "172.16.5.4", "172.32.5.4", "127.0.0.1", "169.254.1.1", "8.8.8.8", "230.1.1.1"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "DE12 3704 0044 0532 0130 00"]
    got = safe(spark, phones + ips + ibans)
    for old, new in zip(phones, got, strict=False):
        assert old != new and re.sub(r"\d", "0", old) == re.sub(r"\d", "0", new) and old.split()[0].split("(")[0] == new.split()[0].split("(")[0]
    kind = lambda x: (lambda a: (a.is_private, a.is_loopback, a.is_link_local, a.is_multicast, a.is_global))(ipaddress.ip_address(x))
    for old, new in zip(ips, got[len(phones) :], strict=False):
        assert old != new and kind(old) == kind(new), (old, new)
    for old, new in zip(ibans, got[len(phones) + len(ips) :], strict=True):
        assert old[:2] == new[:2] and len(old) == len(new) and (mod97(old.replace(" ", "")) == 1) == (mod97(new.replace(" ", "")) == 1) and old != new
    assert sum(mod97(x.replace(" ", "")) == 1 for x in got[-3:]) == 2


# Entities by patterns of another engine, written for this test.
PLAIN = [
    r"[\p{L}\d._%+-]+@(?:[\p{L}\d-]+\.)+\p{L}{2,}", r"(?<=token = \")[0-9a-f]{40}(?=\")", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", r"(?<!\d)\d{4}(?:[ -]?\d){9,15}(?!\d)", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_whole_documents_against_plain_search(spark, sf):
    """Everything but entities stays; an entity has one surrogate in all documents, and no other entity has it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(10))
    out = pii.replace_pii(docs).select("__row.doc_id", "__row.text", "safe_text", "n_entities").collect()
    assert len(out) == docs.count()
    plain = regex.compile("|".join(PLAIN))
    forward, backward = {}, {}
    found = 0
    for r in out:
        text = r.text or ""
        spans = [m.span() for m in plain.finditer(text)]
        if not spans:
            assert r.n_entities > 0 or (r.safe_text == r.text)
            continue
        found += len(spans)
        keep, at = [], 0
        for a, b in spans:
            keep.append(regex.escape(text[at:a]))
            at = b
        keep.append(regex.escape(text[at:]))
        if r.n_entities != len(spans):
            continue  # names and other kinds beside
        m = regex.fullmatch("(.+?)".join(keep), r.safe_text, regex.S)
        assert m, r.doc_id
        for (a, b), new in zip(spans, m.groups(), strict=True):
            old = text[a:b].lower()
            assert new.lower() != old and forward.setdefault(old, new.lower()) == new.lower() and backward.setdefault(new.lower(), old) == old
    assert found > 20 and len(forward) > 10
    same = docs.join(spark.createDataFrame([(r.doc_id, r.safe_text) for r in out], "doc_id long, s string").distinct(), "doc_id").where(F.col("text") == F.col("s")).count()
    assert same > 0.5 * docs.count()
