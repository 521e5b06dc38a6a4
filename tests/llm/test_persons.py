import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm.lsh import band_keys, collision, paired_band_keys, tune_bands, tune_paired_bands
from weftline.llm.persons import _part_distance, link_spellings, read_name, star_clusters


def test_curve_is_met_by_measured_recall():
    rng = np.random.default_rng(1)
    bands, rows = tune_bands(0.5, 0.9)
    assert collision(0.5, bands, rows) >= 0.9 > collision(0.5, bands - 1, rows)
    hits = 0
    for _ in range(400):
        both = rng.integers(0, 2**60, 20, dtype=np.uint64)
        a, b = np.r_[both, rng.integers(0, 2**60, 10, dtype=np.uint64)], np.r_[both, rng.integers(0, 2**60, 10, dtype=np.uint64)]  # J = 20 / 40
        k = band_keys(np.r_[a, b], np.array([0, 30, 60]), bands, rows, np.zeros(2, dtype=np.uint64))
        hits += bool((k[0] == k[1]).any())
    assert hits / 400 > 0.85


def test_paired_bands_need_both_parts():
    n = tune_paired_bands(0.3, 0.97)
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**60, 9, dtype=np.uint64) for _ in range(3)]
    flat, off = np.concatenate(sets), np.array([0, 9, 18, 27])
    k = paired_band_keys(flat, off, np.array([0, 0, 0]), np.array([1, 1, 2]), n, np.zeros(3, dtype=np.uint64))
    assert (k[0] == k[1]).all() and not (k[0] == k[2]).any()


def test_readings():
    assert read_name("Ζήνων Θέωνος") == read_name("Θέωνος Ζήνων") == read_name("Θέωνος, Ζήνων") == read_name("ΖΗΝΩΝ ΘΕΩΝΟΣ, γέρδιος")
    assert read_name("Zenon son of Theodorou") == read_name("Zenon Theodorou")
    assert read_name("Verso") == [] and read_name(None) == [] and read_name("Fr. 2") == [] and read_name(", ,") == []


P = [
    (1, "a", "Πιγιλύγιος Τιπώμου", ["Πιγιλύγιος Τιπώμου", "Πιγι. Τιπώμου"], 50), (4, "a", "Πιγιλγιος Τιπώμου", None, None), (2, "a", "Τιπώμος Πιγιλύγιου", [], 3),
    (3, "b", "Πιγιλύγιος Τιπώμου", ["Πιγιλύγιος Τιπώμου"], 1), (5, "a", "Δωράνος Σακύτου", [None, ""], 2), (6, None, "Πιγιλύγιος Τιπώμου", ["x y"], 9), (7, "a", "Νοβωνώμας Σακύτου", ["Νοβωνώμας Σακύτου"], 1),
    (None, "a", "Πιγιλύγιος Τιπώμου", None, 1), (8, "a", None, None, 1),
]
M = [
    (1, 0, "a", "Πιγιλύγιωι Τιπώμου", 1), (1, 1, "a", "Τιπώμου, Πιγιλύγιος", 1), (1, 2, "a", "Πιγιλύγιος Τυλωβάμου", None), (1, 3, "a", "Πιγ. Τιπώμου", 1), (2, 0, "b", "Πειγιλύγιος Τιπώμου", 3),
    (2, 1, "b", "Δωράνος Σακύτου", None), (3, 0, "a", "Νοβωνώμας Σακύτου", 5), (3, 1, "a", None, None), (3, 2, "a", "Recto", None), (3, 3, "a", "Τιπώμος Πιγιλύγιου", 2), (3, 4, "a", "Πιγιλύγιоς Τιπώμου", 1), (3, 5, None, "Πιγιλύγιος Τιπώμου", None),
]


def links(spark, persons, mentions):
    p = spark.createDataFrame(persons, "person_id long, archive_key string, canonical_name string, variants array<string>, n int")
    m = spark.createDataFrame([r[:4] for r in mentions], "row_no long, elem_no int, archive_key string, spelling string")
    return link_spellings(p, m, block="archive_key", person="person_id", spellings=["canonical_name", "variants"], support="n", mention_keys=["row_no", "elem_no"], mention="spelling",
                          by_names={"νοβονομ": ["δοραν"], "δοραν": ["νοβονομ"]})


def test_links(spark):
    clusters, found = links(spark, P, M)
    c = {r["person_id"]: r["cluster"] for r in clusters.collect()}
    assert c == {1: 1, 4: 1, 2: 2, 3: 3, 5: 5, 6: 6, 7: 5, 8: 8}
    got = {(r["row_no"], r["elem_no"]): r["cluster"] for r in found.collect()}
    assert got == {(a, b): w for a, b, _, _, w in M if w is not None}


def test_empty_sides(spark):
    clusters, found = links(spark, P[:0], M)
    assert clusters.count() == 0 == found.count()
    clusters, found = links(spark, P, M[:0])
    assert clusters.count() == len(P) - 1 and found.count() == 0


def test_noisy_spellings_are_linked(spark):
    rnd = random.Random(6)
    syl = [c + v for c in "βδγκλμνπρστ" for v in "αιου"]
    names = list({"".join(rnd.choice(syl) for _ in range(4)) for _ in range(30)})
    people = [(i, "a", f"{g}σ {f}υ", [f"{g}σ {f}υ"], 1) for i, (g, f) in enumerate(zip([n[:-1] + "ο" for n in names], rnd.sample([n[:-1] + "ο" for n in names], len(names))))]
    mentions = []
    for i, _, n, _, _ in people:
        k = rnd.randrange(1, 6)
        mentions.append((i, 0, "a", rnd.choice([n[:k] + n[k + 1 :], n[:k] + n[k] + n[k:], n[:k] + "φ" + n[k + 1 :]]), i))
    got = {r["row_no"]: r["cluster"] for r in links(spark, people, mentions)[1].collect()}
    right = sum(got.get(a) == w for a, _, _, _, w in mentions)
    assert right >= 0.9 * len(mentions) and all(got[a] == w for a, _, _, _, w in mentions if a in got)


def test_stars(spark):
    rows = spark.createDataFrame([(i, 0) for i in range(7)], "id long, rank int")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.9), (1, 3, 0.8), (4, 5, 1.0)], "a long, b long, sim double")
    got = {r["id"]: r["center"] for r in star_clusters(rows, e).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_given_names_alone(spark):
    people = [
        (1, "a", "Θυκυβίος Ψιρωνέφιου", ["Θυκυβίος Ψιρωνέφιου", "Θυκυβίος"], 1), (2, "a", "Θυκυβίος Κεβησήδιου", [], 1), (3, "a", "Λιλεθέτων Μοταβότιου", [], 1),
        (4, "b", "Λιλεθέτων Σακύτου", [], 1), (5, "b", "Λιλεθέτων Κεβησήδιου", [], 1), (6, "a", "Νοβωνώμας Σακύτου", [], 1), (7, "c", "Ταμίβος Σακύτου", [], 1), (0, "c", "Ταμίβου", ["Ταμίβος"], 1),
    ]
    mentions = [
        (1, 0, "a", "Θυκυβίος", 1),  # listed by one person, though another bears the name too
        (1, 1, "a", "Θυκυβίου", None),  # in another case: two persons bear it
        (1, 2, "a", "Λιλεθέτωνος", 3), (1, 3, "b", "Λιλεθέτων", None), (1, 4, "a", "ΛΙΛΕΘΕΤΩΝ", 3), (1, 5, "a", "Δωράνος", 6), (1, 6, "a", "Λιλ.", None),
        (1, 7, "a", "Μοταβότιος", None), (1, 8, "c", "Ταμίβος", 0), (1, 9, "a", "Verso", None), (1, 10, None, "Λιλεθέτων", None), (1, 11, "c", "Ταμίβος Σακύτου", 0),
    ]
    clusters, found = links(spark, people, mentions)
    assert {r["person_id"]: r["cluster"] for r in clusters.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 0, 0: 0}
    got = {(r["row_no"], r["elem_no"]): r["cluster"] for r in found.collect()}
    assert got == {(a, b): w for a, b, _, _, w in mentions if w is not None}


def test_all_words_of_a_long_name_count():
    one = read_name("Aurelius Theon son of Apollonios")
    two = read_name("Aurelius Dionysios Apolloniou")
    assert one and two and not set(one) & set(two)
    assert {f for _, f in one} & {f for _, f in two} and all(" " in g for g, _ in one)


def test_long_stems_are_compared_whole(spark):
    stem = "ab" * 60
    rows = spark.createDataFrame([(stem + "cd", stem + "cd"), (stem + "cd", stem + "xyz")], "a string, b string")
    got = [r[0] for r in rows.select(_part_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [0, 3]


def test_copies_of_rows_hang_together_and_cost_no_pairs(spark):
    people = [(i, "a", "Θυκυβίος Ψιρωνέφιου", ["Θυκυβίος Ψιρωνεφίου"], i) for i in range(300)] + [(900, "a", "Θυκυβίος Ψιρωνέφου", [], 1)]
    clusters, found = links(spark, people, [(1, 0, "a", "Θυκυβίος Ψιρωνέφιου", 0)])
    assert {r["cluster"] for r in clusters.collect()} == {0} and found.first()["cluster"] == 0
