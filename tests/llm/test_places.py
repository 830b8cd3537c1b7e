from pyspark.sql import functions as F

from tallyloom.functions.text import osa
from tallyloom.llm.places import PlaceMatcher, Vocabulary, bound, map_places, with_unit

UNITS = [(0, "Narmainagar", "narmenagar", "Hapi"), (1, "KHIPIKHAL", "kipikal", "Birmi"), (2, "Luhashi", "luhasi", "Rekhi"), (3, "Luhashi", "luhasi", "Naibud"), (4, "Kanas", "kanas", "Vishum"), (5, "Dhebhaji", "debaji", "Dogi")]


def units(spark):
    return spark.createDataFrame(UNITS, "unit_id int, panchayat string, panchayat_key string, block string")


def test_vocabulary_finds_all_words_within_the_bound():
    words = {"kanas", "kanaus", "sentig", "narmenagar", "kas", "ka", "k"}
    v = Vocabulary(words)
    for q in ["kans", "knaas", "sentg", "narmngar", "narmenagar", "kaanas", "xyz", "", "k"]:
        want = {w: d for w in words if (d := osa(q, w, bound(max(len(q), len(w))))) <= bound(max(len(q), len(w))) and d < len(q)}
        # deletions reach at least what both words' own bounds allow
        strict = {w for w, d in want.items() if d <= min(bound(len(q)), bound(len(w)))}
        assert strict <= set(v.near(q)) <= set(want)


def test_mapping(spark):
    rows = [
        ("pension", "a", "Kipikhal", "BIRMI", False, 1), ("pension", "b", "Gram Panchayat kanaas", None, False, 4), ("pension", "c", "luhasee", "Naibud ", False, 3), ("pension", "d", "luhasee", "REKHI", False, 2),
        ("pension", "e", "कानास", "Vishum", False, 4), ("pension", "f", "same as above", "Vishum", False, -1), ("pension", "g", "Rampaulitaupur", "Vishum", False, -1), ("pension", "h", "DHEBHA...", "DOGI", False, 5),
        ("pension", "i", "Narmai nagar", "Hapi", False, 0), ("standard", "j", "gramkanas", "Vishum", True, 4), ("standard", "k", "narmenagarw12", None, True, 0), ("pension", "l", "luhasee", "elsewhere", False, 2),
        ("pension", "m", "Kanas word " * 3000, "Vishum", False, -1), ("pension", "n", "-", "x", False, -1),
        # no cases: exact, null, blank
        ("pension", "x", "Kanas", "Vishum", False, None), ("standard", "y", "kanas", None, True, None), ("pension", "z", None, None, False, None), ("pension", "w", "  ", None, False, None),
    ]
    df = spark.createDataFrame(rows, "src string, record_id string, value string, block string, is_key boolean, unit_id int")
    got = {r["record_id"]: r["unit_id"] for r in map_places(df.union(df.limit(5)), units(spark)).collect()}
    want = {r[1]: r[5] for r in rows if r[5] is not None}
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if k != "m"} == {k: v for k, v in want.items() if k != "m"}
    assert map_places(df.limit(0), units(spark)).count() == 0
    assert {r["unit_id"] for r in map_places(df, units(spark).limit(0)).collect()} == {-1}


def test_with_unit_keeps_every_row(spark):
    df = spark.createDataFrame([("Kanas", "Vishum", "old"), (None, None, "old"), ("?", "x", "old")], "p string, b string, unit string")
    assert sorted((r["p"] or "", r["unit"]) for r in with_unit(df, "p", "b", units(spark)).collect() if r["unit"]) == [("Kanas", 4)]
    assert with_unit(df, "p", "b", units(spark)).count() == 3


def test_an_exact_name_of_another_block_still_wins_over_none():
    m = PlaceMatcher([(i, n, k, b) for i, n, k, b in UNITS], {})
    assert m("Kanas.", "Hapi", False) == 4
    assert F is not None


def test_entries_of_several_words_in_any_order():
    more = [*UNITS, (6, "Upper New Lake View Colony", "upernevlakevievkoloni", "Dogi"), (7, "Lower New Lake View Colony", "lovernevlakevievkoloni", "Dogi")]
    m = PlaceMatcher(more, {})
    assert m("Uper New Lake View Colony", None, False) == 6 and m("colony lake viev new lower", None, False) == 7
    assert m("UpperNewLakeViewColony", None, False) == 6 and m("Some Thing Else Entirely Here", None, False) == -1


def test_what_a_key_has_glued_on_comes_off_however_much_it_is():
    m = PlaceMatcher(list(UNITS), {"gram": 0.2})
    assert m("gramgramgramgramgramkipikalgramgram", None, True) == 1
