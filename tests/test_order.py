"""Positions, cut points and samples against brute force, with tiny ranges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import order as O


@pytest.fixture(params=[64, 500_000])
def narrow(request, monkeypatch):
    """Rows per range of the key table: many ranges, or one."""
    monkeypatch.setattr(O, "NARROW_BUCKET_ROWS", request.param)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.randint(0, 9)) for i in range(1237)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, grp string, v int").repartition(5).cache()


@pytest.mark.parametrize("bucket_rows", [50, 100_000])
def test_exact_rank(table, narrow, bucket_rows):
    got = O.exact_rank(table, [-F.col("v"), "id"], bucket_rows=bucket_rows).collect()
    wanted = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r["rank"] for r in wanted] == list(range(1, 1238))


@pytest.mark.parametrize("bucket_rows", [50, 100_000])
@pytest.mark.parametrize("align", [1, 7, 90])
def test_positions_within_groups(table, narrow, bucket_rows, align):
    got = O.positions(
        table, ["v", "id"], within="grp", align=align, keep_bucket=True, bucket_rows=bucket_rows
    ).collect()
    assert len(got) == 1237
    for g in "abc":
        rows = sorted((r for r in got if r.grp == g), key=lambda r: (r.v, r.id))
        assert [r.pos for r in rows] == list(range(len(rows)))
        batches = {}
        for r in rows:
            batches.setdefault(r.pos // align, set()).add(r["_bucket"])
        assert align == 1 or all(len(b) == 1 for b in batches.values())


def test_positions_do_not_depend_on_partitions(table, narrow):
    one = O.positions(table.coalesce(1), "id", bucket_rows=100).select("id", "pos").collect()
    many = O.positions(table.repartition(200), "id", bucket_rows=100).select("id", "pos").collect()
    assert sorted(one) == sorted(many)


def test_sizes_of_splits():
    assert O.split_counts(90507) == [("train", 72405), ("validation", 9051), ("test", 9051)]
    assert [n for _, n in O.split_counts(1000)] == [800, 100, 100]
    assert [n for _, n in O.split_counts(10)] == [8, 1, 1]
    assert [n for _, n in O.split_counts(7)] == [5, 1, 1]


@pytest.mark.parametrize("bucket_rows", [40, 100_000])
def test_split_exact(table, bucket_rows):
    got = O.split_exact(table, "id", bucket_rows=bucket_rows).collect()
    order = sorted(got, key=lambda r: (hashlib.md5(f"5:{r.id}".encode()).hexdigest(), r.id))
    names = [s for s, n in O.split_counts(1237) for _ in range(n)]
    assert [r.split for r in order] == names


@pytest.mark.parametrize("rows", [0, 1, 2, 3])
def test_split_of_few_rows(spark, rows):
    df = spark.range(rows)
    got = O.split_exact(df, "id").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in got} == {s: n for s, n in O.split_counts(rows) if n}


@pytest.mark.parametrize("n", [0, 5, 700, 5000])
def test_head(table, n):
    got = O.head_n(table, n, ["v", "id"], bucket_rows=64)
    wanted = sorted(table.collect(), key=lambda r: (r.v, r.id))[:n]
    assert sorted(got.collect()) == sorted(wanted)


def test_head_strict(table):
    with pytest.raises(ValueError):
        O.head_n(table, 1238, "id", strict=True)


def test_sample_is_stable(table):
    a = {r.id for r in O.sample_k(table, 16, 5, "id").collect()}
    b = {r.id for r in O.sample_k(table.repartition(3), 16, 5, "id").collect()}
    assert a == b and len(a) == 16


def test_take_per_group(table):
    got = O.take_per_group(table, "grp", {"a": 100, "b": 10**6}, ["v", "id"], bucket_rows=64)
    rows = table.collect()
    wanted = sorted((r for r in rows if r.grp == "a"), key=lambda r: (r.v, r.id))[:100]
    wanted += [r for r in rows if r.grp != "a"]
    assert sorted(got.collect()) == sorted(wanted)


@pytest.mark.parametrize("a,b,zoom,sizes", [(3, 10, 2, (3, 6)), (10, 3, 2, (3, 3)), (3, 4, 2, (3, 4))])
def test_balance_two(spark, a, b, zoom, sizes):
    x, y = O.balance_two(spark.range(a), spark.range(b), "id", zoom)
    assert (x.count(), y.count()) == sizes
    assert {r[0] for r in y.collect()} == set(range(sizes[1]))


def test_balance(table):
    got = O.balance(table, "grp", "id", ratio=1.5).groupBy("grp").count().collect()
    counts = {r[0]: r[1] for r in table.groupBy("grp").count().collect()}
    quota = int(min(counts.values()) * 1.5)
    assert {r[0]: r[1] for r in got} == {g: min(n, quota) for g, n in counts.items()}


def test_carve_validation(table):
    got = O.carve_validation(table, "id", 10).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in got} == {"train": 1113, "validation": 124}


@pytest.mark.parametrize("bucket_rows", [30, 100_000])
def test_quantiles(spark, bucket_rows):
    values = np.random.default_rng(0).normal(size=501).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r[0]: r[1] for r in O.exact_quantiles(df, "x", qs, bucket_rows=bucket_rows).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(values, q))


def test_string_and_null_free_bounds(spark, narrow):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abc中😀", k=5)) for _ in range(600)})
    df = spark.createDataFrame([(n,) for n in names], "s string").repartition(7)
    got = O.exact_rank(df, "s", bucket_rows=25).collect()
    wanted = {n: i for i, n in enumerate(sorted(names, key=lambda s: s.encode()), 1)}
    assert {r.s: r["rank"] for r in got} == wanted


@pytest.mark.parametrize("bucket_rows", [40, 100_000])
def test_cut_between_equal_keys_is_an_error(spark, bucket_rows):
    hot = spark.range(300).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("k"), "id")
    with pytest.raises(ValueError, match="not unique"):
        O.head_n(hot, 50, "k", bucket_rows=bucket_rows)
    assert O.head_n(hot, 100, "k", bucket_rows=bucket_rows).count() == 100
    assert O.head_n(hot, 50, ["k", "id"], bucket_rows=bucket_rows).count() == 50
    ranked = O.exact_rank(hot, ["k", "id"], bucket_rows=bucket_rows).where("k = 7")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 101))


def test_aligned_positions_need_unique_keys(spark, narrow):
    hot = spark.range(300).select(F.lit(7).alias("k"), "id")
    with pytest.raises(ValueError, match="not unique"):
        O.positions(hot, "k", align=10, bucket_rows=40)
    pos = O.positions(hot, ["k", "id"], align=10, bucket_rows=40)
    assert sorted(r.pos for r in pos.collect()) == list(range(300))


@pytest.mark.parametrize("rows", [10, 100, 3000])
def test_null_keys_come_first_and_are_kept(spark, rows):
    df = spark.range(rows).select(F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    order = sorted(((r.a is not None, r.a or 0, r.b) for r in df.collect()))
    for n in (3, rows // 2, rows - 1):
        got = O.head_n(df, n, ["a", "b"], bucket_rows=50).collect()
        assert sorted((r.a is not None, r.a or 0, r.b) for r in got) == order[:n]
    sizes = {r[0]: r[1] for r in O.split_exact(df, ["a", "b"], bucket_rows=50).groupBy("split").count().collect()}
    assert sizes == {s: n for s, n in O.split_counts(rows) if n}
    ranks = O.exact_rank(df, ["a", "b"], bucket_rows=50).collect()
    assert [r.rank for r in sorted(ranks, key=lambda r: (r.a is not None, r.a or 0, r.b))] == list(range(1, rows + 1))


@pytest.mark.parametrize("bucket_rows", [40, 10**6])
def test_ties_are_an_error_at_any_size(spark, bucket_rows):
    df = spark.range(200).select((F.col("id") % 50).alias("k"), "id")
    with pytest.raises(Exception, match="not unique"):
        O.exact_rank(df, "k", bucket_rows=bucket_rows).collect()
    for n in (6, 22, 70):
        with pytest.raises(ValueError, match="not unique"):
            O.head_n(df, n, "k", bucket_rows=bucket_rows)
        assert O.head_n(df, n // 4 * 4, "k", bucket_rows=bucket_rows).count() == n // 4 * 4


def test_balance_counts_null_as_a_class(spark):
    sizes = {None: 40, "a": 15, "b": 5}
    df = spark.createDataFrame([(c, i) for c, n in sizes.items() for i in range(n)], "cls string, id long")
    got = O.balance(df, "cls", "id")
    assert {r[0]: r[1] for r in got.groupBy("cls").count().collect()} == {None: 5, "a": 5, "b": 5}
    assert {r.id for r in got.collect()} == set(range(5))


def test_balance_runs_as_many_jobs_for_many_classes(spark):
    def jobs(classes):
        group = f"balance-{classes}"
        spark.sparkContext.setJobGroup(group, group)
        df = spark.range(2 * classes).select((F.col("id") % classes).alias("cls"), "id")
        assert O.balance(df, "cls", "id", 0.5).count() == 0 if classes == 0 else True
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(400) <= jobs(10) + 2


def test_take_per_group_with_a_null_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(9)] + [("a", i) for i in range(4)], "cls string, id long")
    got = O.take_per_group(df, "cls", {None: 3}, "id")
    assert {r[0]: r[1] for r in got.groupBy("cls").count().collect()} == {None: 3, "a": 4}


def test_a_heavy_key_is_refused_before_it_is_sorted(spark, monkeypatch):
    monkeypatch.setattr(O, "NARROW_BUCKET_ROWS", 50)
    even = spark.range(600).select("id")
    assert sorted(r.pos for r in O.positions(even, "id").collect()) == list(range(600))
    heavy = even.unionByName(spark.range(900).select(F.lit(300).cast("long").alias("id")))
    with pytest.raises(ValueError, match="901 times"):
        O.positions(heavy, "id")


def test_cuts_beside_a_heavy_key(spark, monkeypatch):
    monkeypatch.setattr(O, "SORT_LIMIT", 0)
    df = spark.range(100).unionByName(spark.range(500).select(F.lit(40).cast("long").alias("id")))
    got = [r.id for r in O.head_n(df, 40, "id", bucket_rows=20).collect()]
    assert sorted(got) == list(range(40))
    assert O.head_n(df, 541, "id", bucket_rows=20).count() == 541
    with pytest.raises(ValueError, match="not unique around position 300"):
        O.head_n(df, 300, "id", bucket_rows=20)
