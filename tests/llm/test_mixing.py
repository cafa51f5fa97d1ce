import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import mixing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.floats(0.01, 0.99), st.integers(0, 5))
def test_flight_keeps_both_totals(sizes, p, seed):
    x = np.array(sizes, float)
    before = np.full(len(x), p)
    after = mixing.flight(before, x, np.random.default_rng(seed))
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert abs(after.sum() - before.sum()) < 1e-4 and abs((after * x).sum() - (before * x).sum()) < 1e-2
    landed = mixing.land(after, x)
    assert set(landed) <= {0.0, 1.0} and (len(x) == 0 or abs((landed * x).sum() - (before * x).sum()) <= 2 * x.max())


def test_flight_is_unbiased():
    x = np.array([3.0, 8, 1, 6, 2, 7, 4, 9])
    total = np.zeros(8)
    for s in range(800):
        total += mixing.land(mixing.flight(np.full(8, 0.5), x, np.random.default_rng(s)), x)
    assert (np.abs(total / 800 - 0.5) < 0.12).all()


def test_plan_takes_the_largest_reachable_total():
    targets = pd.DataFrame({"source": ["a", "B_c", "none"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 4, 3]})
    totals = pd.DataFrame({"source": ["a", "b-c"], "docs": [10, 10], "tokens": [1000, 200]})
    got = mixing.plan(totals, targets).set_index("source")
    assert abs(got.goal["a"] - 1000) < 1e-6 and abs(got.goal["b-c"] - 600) < 1e-6 and got.goal["none"] == 0 and got.sure["b-c"] == 3
    got = mixing.plan(totals, targets, 10_000).set_index("source")
    assert got.goal["a"] == 1000 and got.goal["b-c"] == 800


def docs(n=3000):
    rng = np.random.default_rng(1)
    names = ["big", "big ", "BIG", "small_one", "small-one", None, "untargeted"]
    rows = []
    for i in range(n):
        source = names[int(rng.choice(7, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]))]
        rows.append((i, None if i % 97 == 0 else "" if i % 89 == 0 else "word " * int(rng.integers(1, 40)), source, 1, "x"))
    return rows


def test_mix(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string, source string, copies int, p string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small-one", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix(df, targets, block=200)
    rows = chosen.collect()
    tokens = pd.DataFrame(rows, columns=chosen.columns)
    tokens["all"] = tokens.n_tokens * tokens.copies
    share = tokens.groupby("source")["all"].sum() / tokens["all"].sum()
    assert abs(share["big"] - 2 / 3) < 0.005 and abs(share["small-one"] - 1 / 3) < 0.005
    assert tokens.doc_id.is_unique and (tokens[tokens.source == "small-one"].copies <= 3).all() and (tokens[tokens.source == "big"].copies == 1).all()
    again = mixing.mix(df.repartition(7), targets, block=200).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    report = {r.source: r for r in mixing.shares(chosen, targets).collect()}
    assert report["absent"].tokens == 0 and abs(report["big"].reached_share - 2 / 3) < 0.005
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
