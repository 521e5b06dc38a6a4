import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.canonical import NONE, grams, map_to_canonical, take_apart, PLACES
from weftline.llm.setsim import set_similarity_join

sets = st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=8), max_size=12)


@settings(max_examples=8, deadline=None)
@given(sets, sets, st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_join_equals_brute_force(spark, a, b, t):
    schema = "id int, toks array<string>"
    got = {(r["left_id"], r["right_id"]) for r in set_similarity_join(spark.createDataFrame(list(enumerate(a)), schema), spark.createDataFrame(list(enumerate(b)), schema), t).collect()}
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= t - 1e-12}
    assert got == want


REF = [(1, "Phetysados", "Pathopolites", "Kyniphokome"), (2, "Gonotyne", "Bonathites", None), (3, "Pebygetheia", "Phamepolites", None), (4, "Pebygetheia", "Thinenites", None), (5, "Ano Chythyleia", "Phamepolites", None), (6, None, "Phamepolites", None), (None, "Gonotyne", "Bonathites", None)]
CASES = {
    "Phetysados": 1, " phetusados (Path.) ": 1, "Path.: Phetyssados (?)": 1, "near Kyniphokome": 1, "Kynifokome, Pathopolites": 1, "Gono-tyne?": 2, "Gonoty.": 2, "village of Gontoyne [sic]": 2,
    "Pebygetheia (Pham.)": 3, "Thinenites: Pebygethia": 4, "A. Chythyleia": 5, "Chythyleia, Ano": 5, "AnoChythyleia": 5, "ANO CHYTHYLEIÁ": 5,
    "unknown": NONE, "?": NONE, "-": NONE, "Lakachanis (Bonathites)": NONE, "Gonotyne (Thin.)": NONE, "bought on the market": NONE, "x" * 5000: NONE,
}


def ref(spark):
    return spark.createDataFrame(REF, "place_id long, place_name string, nome string, alt_name string")


def mapped(spark, values):
    df = spark.createDataFrame([(v, "clash") for v in values], "place string, ref string")
    return {r["place"]: r["place_id"] for r in map_to_canonical(df, "place", ref(spark), "place_id", ["place_name", "alt_name"], "nome").collect()}


def test_typed_places(spark):
    got = mapped(spark, [*CASES, None, "", "  ", " ", "Gonotyne?", "Gonotyne?"])
    assert got == CASES | {"Gonotyne?": 2}


def test_empty_sides(spark):
    assert mapped(spark, []) == {}
    df = spark.createDataFrame([("Gonotyne",)], "place string")
    out = map_to_canonical(df, "place", ref(spark).limit(0), "place_id", ["place_name", "alt_name"], "nome").collect()
    assert [(r["place"], r["place_id"]) for r in out] == [("Gonotyne", NONE)]


def test_misspelt_names_find_home(spark):
    rnd = random.Random(8)
    syl = [c + v for c in "bdgklmnprst" for v in "aeio"]
    names = ["".join(rnd.choice(syl) for _ in range(5)) for _ in range(60)]
    reference = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "place_id long, place_name string, nome string")
    typed = {}
    for i, n in enumerate(names):
        k = rnd.randrange(1, len(n) - 1)
        typed[rnd.choice([n[:k] + n[k + 1 :], n[:k] + n[k + 1] + n[k] + n[k + 2 :], n[:k] + "z" + n[k + 1 :], n[:k] + n[k] + n[k:]])] = i
    df = spark.createDataFrame([(v,) for v in typed], "place string")
    got = {r["place"]: r["place_id"] for r in map_to_canonical(df, "place", reference, "place_id", ["place_name"]).collect()}
    assert sum(got[v] == i for v, i in typed.items()) >= 0.95 * len(typed)


def test_parts():
    assert take_apart("Pham.: Xophe (?)", ["phamepolites", "pathopolites"], PLACES)[1] == "phamepolites"
    assert take_apart("P", ["phamepolites"], PLACES)[1] is None
    assert grams("aaa", 2) == ["^a", "aa", "aa#2", "a$"]
