import random
import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm.unicode_form import _doubles, bare, consistent, consistent_text, inconsistent_rows, suspect, transducer

GREEK = "Βαθεσίμων Πωλύδου"
LATIN = "Barapogas son of Tirobonou"


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_fixed_point_and_quick_check(text):
    once = consistent_text(text)
    assert transducer().consistent(once) == once
    if not suspect(text):
        assert transducer().consistent(text) == text


def test_disguises_come_back_to_the_clean_twin():
    rnd = random.Random(4)
    doubles = _doubles()
    for clean, target in ((GREEK, "greek"), (LATIN, "latin")):
        back: dict = {}
        for foreign, own in doubles[target].items():
            back.setdefault(own, []).append(foreign)
        for _ in range(300):
            out = []
            for c in clean:
                k = rnd.random()
                if c == " ":
                    out.append(rnd.choice("   　 "))
                elif k < 0.1:
                    out.append(ud.normalize("NFD", c))
                elif k < 0.2:
                    out.append(c + rnd.choice("​­⁠﻿͏︎"))
                elif k < 0.25 and c in back:
                    out.append(rnd.choice(back[c]))
                elif k < 0.3 and "a" <= c.lower() <= "z":
                    out.append(chr(ord(c) + 0xFEE0))
                else:
                    out.append(c)
            assert consistent_text("".join(out)) == clean, "".join(out).encode("unicode_escape")


def test_named_cases():
    pairs = {"１２［．］－": "12[.]-", "καὶά": "καὶά", "µέν": "μέν", "Reсtо": "Recto", "о δὲ": "ο δὲ", "​": "", "Ａ．": "A.", "a‐b‑c": "a-b-c", "“x”’": "\"x\"'", "ab\tc\nd": "ab\tc\nd", "мир": "мир"}
    assert {k: consistent_text(k) for k in pairs} == pairs
    assert consistent_text(None) is None and consistent_text("") == ""
    assert consistent_text("Case and Missing accents kept") == "Case and Missing accents kept"
    assert bare("ΖΉΝΩΝ ς") == "ζηνων σ"


def test_operator(spark):
    rows = [(1, "Πωνίγωνоς", "x"), (2, GREEK, "x"), (3, None, "x"), (4, "", "x"), (5, "a b" + "c" * 200_000, "x"), (1, "Πωνίγωνоς", "x")]
    df = spark.createDataFrame(rows, "id int, value string, consistent_form string")
    assert sorted(r["id"] for r in inconsistent_rows(df.drop("consistent_form"), "value").collect()) == [1, 1, 5]
    got = inconsistent_rows(df, "value", form=True).filter("id = 1").first()
    assert got["consistent_form"] == "Πωνίγωνος" and got["consistent_form_in"] == "x"
    fixed = {r["id"]: r["v"] for r in df.select("id", consistent(F.col("value")).alias("v")).collect()}
    assert fixed[2] == GREEK and fixed[3] is None and fixed[4] == "" and fixed[5].startswith("a bc") and len(fixed[5]) == 200_003
    assert inconsistent_rows(df.limit(0), "value").count() == 0
