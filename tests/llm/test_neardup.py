import itertools
import random
from pathlib import Path

import numpy as np

from quillmesh.llm import batches, neardup
from quillmesh.llm.shingles import WORD
from quillmesh.session import checkpoint_dir


def shingles(text, width=3):
    if text is None:
        return None
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= 8 else None


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def corpus(n, seed=1):
    rng = random.Random(seed)
    base = [[rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 40)) for _ in range(40)] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 500)}"
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "only three words"), (n + 3, out[0][1]), (n + 4, out[0][1].upper() + "!"), (n + 5, "Wort " * 9)]


def test_pairs_equal_brute_force(spark):
    rows = corpus(120)
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if similarity(shingles(x), shingles(y)) >= 0.6}
    member, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, text string"), 0.6, 3)
    got = [tuple(r) for r in neardup.all_pairs(member, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_large_buckets_are_cut_into_blocks_without_loss(spark):
    rows = [(i, [7, i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, bands array<long>")
    got = {tuple(r) for r in neardup.candidate_pairs(df, block=8).collect()}
    assert got == set(itertools.combinations(range(100), 2))


def test_large_classes_are_dealt_into_parts_without_loss(spark):
    classes = {0: range(0, 30), 100: range(100, 140), 200: [200], 300: [300, 301]}
    member = spark.createDataFrame([(i, c) for c, ids in classes.items() for i in ids], "id long, class_id long")
    links = spark.createDataFrame([(0, 100, 0.7), (100, 200, 0.9)], "a long, b long, similarity double")
    got = [tuple(r) for r in neardup.all_pairs(member, links, block=8).collect()]
    want = {p for ids in classes.values() for p in itertools.combinations(ids, 2)}
    want |= {(x, y) for a, b in ((0, 100), (100, 200)) for x in classes[a] for y in classes[b]}
    assert len(got) == len(set(got)) and set(got) == want


def test_groups(spark):
    rows = corpus(60)
    texts = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, text string, class_id int").select("id", "text")
    got = {r.id: r for r in neardup.groups(texts, 0.6, 3).collect()}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if similarity(shingles(x), shingles(y)) >= 0.6:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert len(got) == len(rows)
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i, _ in rows}
    assert got[63].class_id == got[64].class_id == 0 and got[60].group_id == 60


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_empty(spark):
    texts = spark.createDataFrame([], "id long, text string")
    assert neardup.groups(texts).count() == 0
    assert neardup.groups(spark.createDataFrame([(1, None)], "id long, text string")).collect()[0].group_id == 1


RAW = "raw_id long, batch_no int, path string, size long, sha256 string, body string, downloaded_at timestamp, ord int, id long, cls string"


def raws(n=150, seed=3):
    rng = random.Random(seed)
    texts = [t for _, t in corpus(n, seed)]
    out = []
    for i in range(n):
        sha = rng.choice([None, f"{rng.randint(0, 60):04x}", f" SHA256:{rng.randint(0, 60):04X} ", "", None])
        body = rng.choice([texts[i], texts[i], texts[rng.randrange(n)], None, "short body"])
        path = rng.choice(["raw/", "./raw/", "", " ./"]) + f"d/{rng.randint(0, 12)}.pdf"
        out.append((i + 1, 1 + i // 40, path, rng.choice([0, 5, 5, 6, None]), sha, body, None, 0, 0, "x"))
    return out + [(n + 1, None, None, None, None, None, None, 0, 0, "x"), (n + 2, None, None, None, None, None, None, 0, 0, "x")]


def brute(rows):
    def clean(p):
        if p is None:
            return None
        p = p.strip()
        p = p[2:] if p.startswith("./") else p
        return p[4:] if p.startswith("raw/") else p

    accepted, out = [], set()
    for r in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[0])):
        if r[3] == 0:
            continue
        sha = (r[4] or "").strip().lower().removeprefix("sha256:").strip() or None
        place = (clean(r[2]), r[3]) if r[2] is not None and r[3] is not None else None
        s, loose = shingles(r[5]), sha is None and not (r[5] or "").strip()
        hit = [a for a, h, p, t in accepted if (sha and sha == h) or similarity(s, t) >= 0.6 or (loose and place and place == p)]
        if hit:
            out.add((hit[0], r[0]))
        else:
            accepted.append((r[0], sha, place, s))
    return out


def test_batches_equal_sequential_definition(spark, tmp_path):
    rows = raws()
    df = spark.createDataFrame(rows, RAW)
    want = brute(rows)
    assert {tuple(r) for r in batches.duplicates(df, f"{tmp_path}/h", buckets=2).collect()} == want and len(want) > 20


def test_one_load_equals_batch_by_batch(spark, tmp_path):
    rows = raws(90, 5)
    df = spark.createDataFrame(rows, RAW)
    assert {tuple(r) for r in batches.duplicates_at_once(df, f"{tmp_path}/h", buckets=2).collect()} == brute(rows)


def test_split_pivots_and_new_orders_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "COUNTERS", 64)
    monkeypatch.setattr(batches, "GROWTH", 1)
    rows = raws(120, 7)
    df = spark.createDataFrame(rows, RAW)
    history = batches.History(spark, f"{tmp_path}/h", buckets=2, part=3)
    got = set()
    for number in (None, 1, 2, 3):
        found = history.add(df.where("batch_no is null" if number is None else f"batch_no = {number}"))
        got |= {(r.accepted_id, r.raw_id) for r in found.where("accepted_id is not null").collect()}
    assert got == brute(rows) and len(history.orders) > 1


def test_a_failed_load_is_forgotten_and_a_history_is_opened_again(spark, tmp_path, monkeypatch):
    rows = raws(80, 9)
    df = spark.createDataFrame(rows, RAW)
    first, second = df.where("batch_no is null or batch_no = 1"), df.where("batch_no > 1")
    history = batches.History(spark, f"{tmp_path}/h", buckets=2)
    mark = batches.History._mark
    monkeypatch.setattr(batches.History, "_mark", lambda self, name: 1 / 0 if ".done" in name else mark(self, name))
    try:
        history.add(first)
    except ZeroDivisionError:
        pass
    monkeypatch.setattr(batches.History, "_mark", mark)
    found = batches.History(spark, f"{tmp_path}/h").add(first)
    got = found.unionByName(batches.History(spark, f"{tmp_path}/h").add(second)).where("accepted_id is not null").select("accepted_id", "raw_id")
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_history_is_read_in_buckets(spark, tmp_path):
    history = batches.History(spark, f"{tmp_path}/h", buckets=2)
    history.add(spark.createDataFrame(raws(40, 2), RAW))
    probes = spark.range(10).selectExpr("id pivot", "id cls", "1 n", "0 pos")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = batches.candidates(probes, history.table("pivots"), 0.6, False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def files_below(folder):
    return {p for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file()}


def test_a_load_leaves_its_history_only(spark, tmp_path):
    rows = raws(120, 11)
    df = spark.createDataFrame(rows, RAW)
    before = files_below(checkpoint_dir(spark))
    history = batches.History(spark, f"{tmp_path}/h", buckets=2)
    found = [history.add(df.where(w)) for w in ("batch_no is null or batch_no = 1", "batch_no = 2", "batch_no = 3")]
    assert {(r.accepted_id, r.raw_id) for f in found for r in f.collect() if r.accepted_id} == brute(rows)
    assert files_below(checkpoint_dir(spark)) == before
    assert {p.name for p in (tmp_path / "h").iterdir()} == {"decided", "keys", "loads", "orders", "pivots", "sets"}
    assert len(history.orders) == 1  # of less than a growth by four


def test_sketches_end_pairs_in_the_join_and_lose_none(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(1)
    common = [" ".join(rng.choices(words, k=3)) for _ in range(4)]
    texts = [" ".join([*rng.choices(words, k=40), rng.choice(common), *rng.choices(words, k=20)]) for _ in range(60)]
    texts += [t.replace(t.split()[5], "changed") for t in texts[:20]]
    sets = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "cls long, body string, new boolean")
    probes = batches.pivot_rows(sets, [(1, np.zeros(batches.COUNTERS, np.uint32))])
    pairs = lambda rows: {(r.a, r.b) for r in batches.candidates(rows, rows, 0.6, True).collect()}
    true = {(a, b) for a, b in itertools.combinations(range(80), 2) if similarity(shingles(texts[a]), shingles(texts[b])) >= 0.6}
    with_bits, without = pairs(probes), pairs(probes.drop(*batches.BITS))
    assert len(true) >= 20 and true <= with_bits < without


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(1)
    for n, shared in ((12, 9), (60, 30), (150, 0), (400, 390)):
        a, rest = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (n, n - shared))
        b = np.concatenate([a[:shared], rest])
        differing = [sum(int(x).bit_count() for x in (batches.set_bits(a, w) ^ batches.set_bits(b, w)).view(np.uint64)) for w in (128, batches.WIDE)]
        assert max(differing) <= 2 * (n - shared)
        if not shared:
            assert differing[0] <= 2 * n / 4 < differing[1]  # only the wide one tells sets of this size apart


def test_no_rows(spark, tmp_path):
    assert batches.duplicates(spark.createDataFrame([], RAW), f"{tmp_path}/h", buckets=2).count() == 0
