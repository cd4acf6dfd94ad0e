import random

import pytest

from pagegraph.operators import stats
from pagegraph.operators.ranks import numbered
from pagegraph.plans import q_stats


def test_bootstrap_of_all_runs(spark, tmp_path):
    """The first thirty runs of each tool are unlike all later ones; the interval is that of a's median less b's."""
    rows = [(k, "page", 0, (9.0 if k % 2 else 3.0) if k < 60 else (2.0 if k % 2 else 1.0)) for k in range(1000)]
    frame = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").selectExpr("*", "timestamp_seconds(event_id) AS ts")
    frame.write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in q_stats.bootstrap_ci(spark, str(tmp_path)).collect()] == [("page", -1000, -1000)]


def test_numbered_hot_group(spark):
    """A group with most rows is numbered over several tasks, as the small ones and those without a key are."""
    rng = random.Random(6)
    rows = [("hot", k) for k in range(3000)] + [(rng.choice(["a", "b", None]), k) for k in range(200)]
    rng.shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "key string, at int").repartition(8), ["key"], ["at"]).collect()
    want = {}
    for key in ("hot", "a", "b", None):
        want |= {(key, at): n for n, at in enumerate(sorted(at for k, at in rows if k == key), 1)}
    assert {(r.key, r.at): r["rank"] for r in got} == want and len(got) == len(rows)


def test_bootstrap_brute_force(spark):
    rng = random.Random(3)
    samples = {key: {t: [rng.choice([rng.randint(50, 150), 100]) + 40 * (t == "b") for _ in range(n)] for t, n in sizes} for key, sizes in {"odd": (("a", 31), ("b", 47)), "even": (("a", 40), ("b", 20)), "two": (("a", 1), ("b", 2))}.items()}
    rows = [(key, t, d) for key, tools in samples.items() for t, ds in tools.items() for d in ds] + [("one tool", "a", 5), ("even", "a", None), ("even", "c", 1)]
    frame = spark.createDataFrame(rows, "key string, tool string, d long")
    got = {r.key: (r.ci_low, r.ci_high) for r in stats.bootstrap_ci(frame, "key", "tool", "d", 4000).collect()}
    assert got.keys() == samples.keys()

    def median(ds):
        ds = sorted(rng.choices(ds, k=len(ds)))
        return (ds[(len(ds) - 1) // 2] + ds[len(ds) // 2]) // 2

    for key, tools in samples.items():
        diffs = sorted(median(tools["a"]) - median(tools["b"]) for _ in range(20000))
        assert got[key] == pytest.approx((diffs[500], diffs[19500]), abs=3)
    again = {r.key: (r.ci_low, r.ci_high) for r in stats.bootstrap_ci(frame.repartition(3), "key", "tool", "d", 4000).collect()}
    assert again == got
