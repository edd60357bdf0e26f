"""Personal data against the plain patterns, and behind planted disguises."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galeframe.llm import private
from tests.llm import brute

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_card(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return 14 <= len(digits) <= 19 and total % 10 == 0


def plain(text):
    out = set()
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": is_card(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.add((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab.@-+ 0123456789()é", max_size=60))
def test_plain_spans_are_those_of_the_patterns(text):
    assert {s[:3] for s in private.spans(text) if s[4]} == plain(text)
    assert {(k, a, b) for k, found in private.plain(text).items() for a, b in found} == plain(text)


DISGUISED = [
    ("email", "john.doe (at) example (dot) com", "john.doe@example.com"),
    ("email", "john at example dot com", "john@example.com"),
    ("email", "john dot doe at mail5 dot example dot com", "john.doe@mail5.example.com"),
    ("email", "john[at]example.com", "john@example.com"),
    ("email", "jоhn@exаmple.com", "john@example.com"),
    ("email", "john＠example．com", "john@example.com"),
    ("email", "19@mail5 dot example dot com", "19@mail5.example.com"),
    ("email", "pablo arroba ejemplo punto com", "pablo@ejemplo.com"),
    ("email", "john_at_example_dot_com", "john@example.com"),
    ("email", "john @ example.com", "john@example.com"),
    ("email", "jo​hn@example.com", "john@example.com"),
    ("email", "john AT example.com", "john@example.com"),
    ("email", "john.doe at example.com", "john.doe@example.com"),
    ("email", "19 at mail5.example.com", "19@mail5.example.com"),
    ("ip", "192[.]168[.]1[.]1", "192.168.1.1"),
    ("ip", "192 dot 168 dot 1 dot 20", "192.168.1.20"),
    ("ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
    ("ip", "١٩٢.168.1.1", "192.168.1.1"),
    ("phone", "plus one six five nine five five five three nine four nine", "+16595553949"),
    ("phone", "+1 (six five nine) five five five - three nine four nine", "+1 (659) 5553949"),
    ("phone", "+１ (６５９) 555-3949", "+1 (659) 555-3949"),
    ("phone", "+1 (7O3) 555-38l4", "+1 (703) 555-3814"),
    ("phone", "plus four nine double one five double seven one two three four", "+49115771234"),
    ("phone", "+uno seis cinco nueve cinco cinco cinco tres nueve cuatro nueve", "+16595553949"),
    ("card", "four three eight one eight nine three five five seven seven four one six zero nine", "4381893557741609"),
    ("card", "4381‑8935‑5774‑1609", "4381-8935-5774-1609"),
    ("card", "4381​8935​5774​1609", "4381893557741609"),
    ("card", "4381 8935 5774 16O9", "4381 8935 5774 1609"),
]


@pytest.mark.parametrize(("kind", "disguised", "value"), DISGUISED)
@pytest.mark.parametrize(("before", "after"), [("", ""), ("ein Straßenname, é ", " und so weiter"), ("текст ﻿( ", ", then")])
def test_disguises_are_undone_and_led_back(kind, disguised, value, before, after):
    got = [s for s in private.spans(before + disguised + after) if not s[4]]
    assert got == [(kind, len(before), len(before) + len(disguised), value, False)]


@pytest.mark.parametrize("text", ["look at some point later", "meet me at example.com", "call +1 659 555 3949 one day", "at the dot in the end", "one two three go", "on page two dot five", "lunch @ noon", "room 10l of 12", "das ist null und eins", "vol. 1 . 2 of 2019–2020", "(a) first. (b) second.com", "see a at b dot c", "it ended. at example.com", "in part 9 at example.com", "john.doe at noon. Then", "john.doe at home.Then we go"])
def test_clean_texts_get_no_more_spans(text):
    assert [s for s in private.spans(text) if not s[4]] == []


def test_rows(spark):
    r = random.Random(0)
    rows = [(i, *rest) for i, (_, *rest) in enumerate(brute.corpus())]
    rows += [(1000 + k, f"{brute.prose(r, 30)} {d} {brute.prose(r, 9)}, a@b.example +1 (743) 555-3824", "en", "s", 1) for k, (_, d, _) in enumerate(DISGUISED)] + [rows[3], (None, "x@y.zz", None, None, None)]
    df = brute.clashing(brute.frame(spark, rows)).withColumn("spans", F.lit(1))
    got = private.find(df)
    assert got.columns == df.columns
    by = {s["doc_id"]: s for s in got.collect()}
    for i, text, *_ in rows:
        assert [tuple(s) for s in by[i]["spans"]] == private.spans(text or "")
        assert {tuple(s)[:3] for s in by[i]["spans"] if s["plain"]} == plain(text)
    for k, (kind, d, value) in enumerate(DISGUISED):
        text = by[1000 + k]["text"]
        assert (kind, text.index(d), text.index(d) + len(d), value, False) in [tuple(s) for s in by[1000 + k]["spans"]]
    clean = {s["doc_id"]: s["text"] for s in private.redact(df).collect()}
    assert clean[0] is None and clean[None] == "<email>" and clean[1000].endswith(", <email> <phone>") and "john" not in clean[1000]
    assert private.redact(df).columns == df.columns and private.find(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["x" * 10**6, "1" * 10**6, "one " * 10**5, "a at " * 10**5, "+1" + "(" * 10**6, "a@" * 10**5, "1." * 10**5, "1O" * 10**5, "a dot " * 10**5 + "at b", "[at " * 10**5])
def test_long_texts_are_no_trouble(text):
    assert all(s[2] <= len(text) for s in private.spans(text))
