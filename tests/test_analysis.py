"""Analysis operators against plain Python on random data."""

import random
from fnmatch import fnmatchcase

from pyspark.sql import functions as F

from plumbline.operators import analysis


def merged(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return out


def data(n=300, seed=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(4), s := rng.randrange(500), s + rng.randrange(40)) for i in range(n)]


def test_merge_and_cover(spark):
    rows = data()
    df = spark.createDataFrame(rows, "i int, k int, s int, e int")
    got = sorted(tuple(r) for r in analysis.merge_intervals(df, ["k"], "s", "e").select("k", "s", "e", "n_merged").collect())
    want = sorted((k, *m) for k in range(4) for m in merged([(s, e) for _, j, s, e in rows if j == k]))
    assert got == want
    covered = {r.k: r.covered for r in analysis.covered_length(df, ["k"], "s", "e").collect()}
    assert covered == {k: sum(m[1] - m[0] for m in merged([(s, e) for _, j, s, e in rows if j == k])) for k in range(4)}


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (None, 1, 2)], "k int, s int, e int")
    got = sorted((tuple(r) for r in analysis.merge_intervals(df, ["k"], "s", "e").select("k", "s", "e").collect()), key=str)
    assert got == sorted([(1, 0, 7), (1, 9, 9), (None, 1, 2)], key=str)


def test_containment_equals_all_pairs(spark):
    children, parents = data(120, 5), data(120, 6)
    c = spark.createDataFrame([(k, i, s, e) for i, k, s, e in children], "k int, child int, c0 int, c1 int")
    p = spark.createDataFrame([(k, i, s, e) for i, k, s, e in parents], "k int, parent int, p0 int, p1 int")
    for bucket in (1, 16, 1000):
        got = sorted((r.child, r.parent) for r in analysis.contained_in(c, p, ["k"], ("c0", "c1"), ("p0", "p1"), bucket).collect())
        assert got == sorted((a, b) for a, k, s, e in children for b, j, t, u in parents if k == j and t <= s and e <= u)


def test_best_and_warm(spark):
    df = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 3.0), ("a", 2, 3.0), ("b", 0, 1.0)], "k string, n int, v double")
    assert [tuple(r) for r in analysis.best_per_group(df, ["k"], "v", ["n"]).orderBy("k").collect()] == [("a", 1, 3.0), ("b", 0, 1.0)]
    assert [tuple(r) for r in analysis.warm_statistics(df, ["k"], "n", "v").collect()] == [("a", 3.0, 3.0, 3.0, 2)]


def test_glob(spark):
    words = ["click", "view", "a.b", "a+b", "", "xx\ny", "[", "a[", "]b", "click\n"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for pattern in ("*", "?i*", "a.b", "*y", "", "[a-c]*", "[!a-c]*", "a[.+]b", "a[!.]b", "[]x]*", "[^]", "[", "a[", "*[y]"):
        want = sorted(w for w in words if fnmatchcase(w, pattern))
        assert sorted(r.w for r in df.where(analysis.matches_glob(F.col("w"), pattern)).collect()) == want, pattern
    assert df.where(analysis.matches_glob(F.col("w"), "[^a-c]*")).count() == df.where(analysis.matches_glob(F.col("w"), "[!a-c]*")).count()


def test_strings_and_pivot(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 5), (1, "a", 7), (2, "c", 1)], "k int, t string, v int")
    assert {r.k: r.s for r in analysis.joined_strings(df, ["k"], "t", "s").collect()} == {1: "a,b", 2: "c"}
    assert sorted(tuple(r) for r in analysis.pivot_max(df, ["k"], "t", ["a", "b"], "v").collect() if r.a) == [(1, 7, 2)]


def test_long_parents_are_listed_twice_at_most(spark):
    parents = [(0, 0, 10**9), (1, 5, 6), (2, 100, 4000), (3, None, 7), (4, 6, 6)]
    children = [(0, 5, 6), (1, 0, 10**9), (2, 3999, 4000), (3, 6, None), (4, 6, 6), (5, -1, 0)]
    c = spark.createDataFrame([(1, *r) for r in children], "k int, child int, c0 long, c1 long")
    p = spark.createDataFrame([(1, *r) for r in parents], "k int, parent int, p0 long, p1 long")
    got = sorted((r.child, r.parent) for r in analysis.contained_in(c, p, ["k"], ("c0", "c1"), ("p0", "p1"), 4).collect())
    whole = lambda rows: [r for r in rows if None not in r]
    assert got == sorted((a, b) for a, s, e in whole(children) for b, t, u in whole(parents) if t <= s and e <= u)


def test_size_rollup(spark):
    rows = [("a", "x", 8, 3), ("a", "x", 8, 5), ("a", None, 8, 2), (None, "x", 8, 4)]
    got = {(r.k, r.j, r.level): (r.plain_size, r.primary_size, r.n) for r in analysis.size_rollup(spark.createDataFrame(rows, "k string, j string, plain int, packed int"), ["k", "j"], "plain", "packed").collect()}
    assert got == {("a", "x", 0): (16, 8, 2), ("a", None, 0): (8, 2, 1), (None, "x", 0): (8, 4, 1), ("a", None, 1): (24, 10, 3), (None, None, 1): (8, 4, 1), (None, None, 2): (32, 14, 4)}
    assert analysis.size_rollup(spark.createDataFrame([], "k string, j string, plain int, packed int"), ["k", "j"], "plain", "packed").count() <= 1


def test_pairs_above(spark):
    rng = random.Random(7)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    rows = lambda n: [(rng.choice([None, *range(n)]) if i % 9 == 0 else i, rng.choice([None, 1, 1, 1, 2]), rng.choice(odd) if i % 5 == 0 else float(rng.randrange(-20, 20))) for i in range(n)]
    high, low = spark.createDataFrame(rows(300), "h long, hg int, hv double"), spark.createDataFrame(rows(120), "l long, lg int, lv double")
    want = sorted(map(str, low.join(high, (F.col("lg") == F.col("hg")) & (F.col("hv") > F.col("lv"))).select("l", "h").collect()))
    assert len(want) > 5000
    for block, small in ((1, 1 << 30), (7, 1 << 30), (256, 1 << 30), (7, -1)):
        got = analysis.pairs_above(high, low, ("h", "hg", "hv"), ("l", "lg", "lv"), block=block, tasks=5, small=small)
        assert sorted(map(str, got.collect())) == want


def test_pairs_above_deal_rows_of_one_file_over_tasks(spark):
    """Tables of one file, a few groups and many pairs: the tasks follow the pairs."""
    high, low = spark.range(0, 60_000, 1, 1).selectExpr("id h", "id % 2 hg", "double(id) hv"), spark.range(0, 60_000, 1, 1).selectExpr("id l", "id % 2 lg", "double(id) lv")
    got = analysis.pairs_above(high, low, ("h", "hg", "hv"), ("l", "lg", "lv"))
    assert got.rdd.getNumPartitions() >= 7


def test_pairs_above_as_files_repeat_themselves(spark, tmp_path):
    """Files of the pairs don't hold the keys of low anew for each row of high: a small part of a byte a pair, however the sides are joined."""
    rng = random.Random(5)
    rows = lambda n, first: [(first + i, rng.randrange(5), rng.random()) for i in range(n)]
    high, low = spark.createDataFrame(rows(8000, 10**9), "h long, hg int, hv double"), spark.createDataFrame(rows(8000, 0), "l long, lg int, lv double")
    want = low.join(high, (F.col("lg") == F.col("hg")) & (F.col("hv") > F.col("lv"))).agg(F.count("*"), F.sum("l"), F.sum("h"), F.sum(F.col("l") * (F.col("h") % 1009))).first()
    for i, small in enumerate((1 << 30, -1)):
        analysis.pairs_above(high, low, ("h", "hg", "hv"), ("l", "lg", "lv"), tasks=3, small=small).write.parquet(f"{tmp_path}/{i}")
        assert spark.read.parquet(f"{tmp_path}/{i}").agg(F.count("*"), F.sum("l"), F.sum("h"), F.sum(F.col("l") * (F.col("h") % 1009))).first() == want
        assert sum(f.stat().st_size for f in (tmp_path / str(i)).glob("*.parquet")) < 0.3 * want[0]


def test_pairs_above_of_one_value_are_dealt_over_tasks(spark):
    """All of high have the same group and value: their blocks still go to several tasks."""
    high, low = spark.range(0, 4000, 1, 1).selectExpr("id h", "id div 5000 hg", "9d + id div 5000 hv"), spark.range(0, 900, 1, 1).selectExpr("id l", "id div 5000 lg", "double(id % 20) lv")
    for small in (1 << 30, -1):
        got = analysis.pairs_above(high, low, ("h", "hg", "hv"), ("l", "lg", "lv"), block=64, tasks=6, small=small)
        by_task = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert sum(by_task) == 4000 * 45 * 9 and len(by_task) >= 3 and max(by_task) < 0.7 * sum(by_task)
