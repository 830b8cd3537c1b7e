import glob
from statistics import mean

from tallyloom.llm import entities as N2
from tallyloom.llm.queries import QUERIES
from tallyloom.session import shared_dir


def test_edges_are_pruned_alike_in_one_slice_and_in_several(spark):
    """An edge stays if it weighs at least the mean edge of one of its records to the other's table."""
    rows = [(i, i // 20, [f"k{i * i % 7}", f"h{i * 5 % 11}", f"s{i % 3}"]) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, src int, keys array<string>")
    for share in (1000.0, 2.0):
        e = N2.candidates(p, 4, share)
        all_ = {(r["l"], r["r"]): r["w"] for r in e.collect()}
        to = {}
        for (l, r), w in all_.items():
            to.setdefault((l, r // 20), []).append(w)
            to.setdefault((r, l // 20), []).append(w)
        want = {(l, r) for (l, r), w in all_.items() if w >= min(mean(to[l, r // 20]), mean(to[r, l // 20])) - 1e-9}
        assert all_.keys() == {(a[0], b[0]) for a in rows for b in rows if a[1] < b[1] and set(a[2]) & set(b[2])}
        got = N2.prune(e, 60, share)
        assert {(r["l"], r["r"]) for r in got.collect()} == want and 0 < len(want) < len(all_)
        assert ("Union" in got._jdf.queryExecution().optimizedPlan().toString()) == (share < 1000)


def test_of_people_only_the_ids_and_the_last_round_stay_on_disk(spark, folder):
    tables = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables/*"))
    before = tables()
    out = QUERIES["p2_found"](spark, folder)
    assert sorted(x.rsplit("/", 1)[1].split("-")[0] for x in tables() - before) == ["ids", "scored"]
    assert out.count() > 0
