import random

import pytest
from pyspark.sql import functions as F, types as T

from riskmart.operators import keys as K


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unique_key(spark):
    good = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    K.assert_unique_key(good, "k", "good")
    bad = spark.createDataFrame([(1,), (1,), (None,), (None,), (None,)], "k int")
    with pytest.raises(ValueError, match="bad is not unique on k: 3 duplicate keys"):
        K.assert_unique_key(bad, "k", "bad")
    assert K.surplus_rows(good.where("k > 9"), "k").first()[0] == 0


def test_left_one_to_one(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "SK_ID_CURR int, A int")
    feat = spark.createDataFrame([(1, 100), (2, 200)], "SK_ID_CURR int, B int")
    out = K.left_one_to_one(base, feat)
    assert out.columns == ["SK_ID_CURR", "A", "B"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 10, 100), (2, 20, 200), (3, 30, None)]
    with pytest.raises(ValueError, match="duplicate keys"):
        K.left_one_to_one(base, feat.unionAll(feat))
    with pytest.raises(ValueError, match="base is not unique"):
        K.left_one_to_one(base.unionAll(base), feat)


def test_parent_keys_collapse_repeats_and_reject_two_parents(spark):
    again = spark.createDataFrame([(7, 1), (7, 1), (8, 2)], "SK_ID_PREV long, SK_ID_CURR long")
    assert rows(K.parent_keys(again)) == [(7, 1), (8, 2)]
    for second in (2, None):
        two = spark.createDataFrame([(7, 1), (7, second)], "SK_ID_PREV long, SK_ID_CURR long")
        with pytest.raises(Exception, match="SK_ID_PREV is not unique among parents: 7"):
            K.parent_keys(two).collect()


CHILD = "SK_ID_PREV long, v int"


def test_many_to_one_inner_drops_orphans(spark):
    parents = spark.createDataFrame([(7, 1), (8, 2)], "SK_ID_PREV long, SK_ID_CURR long")
    child = spark.createDataFrame([(7, 1), (7, 2), (9, 3), (None, 4)], CHILD)
    out = K.many_to_one_inner(child, parents)
    assert rows(out.select("SK_ID_PREV", "v", "SK_ID_CURR")) == [(7, 1, 1), (7, 2, 1)]


def test_salted_join_equals_plain(spark):
    child = spark.range(2000).selectExpr("if(id % 3 = 0, 5, id % 40) as SK_ID_PREV", "cast(id as int) as v")
    parents = spark.range(40).selectExpr("id as SK_ID_PREV", "id * 10 as SK_ID_CURR")
    hot = K.frequent_values(child, "SK_ID_PREV", parts=2)
    assert hot == [5]
    plain = K.many_to_one_inner(child, parents, hot=())
    salted = K.many_to_one_inner(child, parents, hot=hot)
    assert rows(plain.select("v", "SK_ID_CURR")) == rows(salted.select("v", "SK_ID_CURR"))
    left = K.join_many_to_one(child, parents.where("SK_ID_PREV > 20"), "SK_ID_PREV", "left", hot=hot)
    assert left.count() == 2000


def test_frequent_values_are_bounded(spark):
    df = spark.range(1000).selectExpr("if(id < 500, -1, id) as k")
    assert K.frequent_values(df, "k", parts=8) == [-1]
    assert K.frequent_values(spark.range(100).selectExpr("id % 50 as k"), "k", parts=8) == []


def test_no_frequent_value_is_missed(spark):
    """Sizes just above the share, among many small ones, in every order of arrival."""
    sizes = {f"hot {i}": 340 + i for i in range(7)}
    sizes.update({f"rare {i}": 1 + i % 3 for i in range(9000)})
    rows = [(k,) for k, n in sizes.items() for _ in range(n)]
    total = len(rows)
    for parts in (2, 16):
        want = [k for k, n in sizes.items() if n > total / (K.HOT_SHARE * parts)]
        for order in (rows, rows[::-1], random.Random(1).sample(rows, total)):
            found = K.frequent_values(spark.createDataFrame(order, "k string").repartition(5), "k", parts)
            assert set(want) <= set(found) and len(found) <= 2 * K.HOT_SHARE * parts
    assert K.frequent_values(spark.createDataFrame([], "k string"), "k") == []


def test_equal_rows_of_a_hot_key_are_spread(spark):
    child = spark.range(20_000).selectExpr("cast(7 as long) as SK_ID_PREV", "map('a', 1) as m")
    parents = spark.createDataFrame([(7, 1)], "SK_ID_PREV long, SK_ID_CURR long")
    joined = K.join_many_to_one(child.repartition(4), parents, "SK_ID_PREV", hot=[7], salts=8)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    spark.conf.set("spark.sql.adaptive.enabled", True)
    assert sum(sizes) == 20_000 and max(sizes) < 15_000


def test_key_checks_survive_pruning(spark):
    parents = spark.createDataFrame([(7, 1), (7, 2)], "SK_ID_PREV long, SK_ID_CURR long")
    child = spark.createDataFrame([(7, 1)], CHILD)
    carried = spark.createDataFrame([(7, 5, 1)], "SK_ID_PREV long, SK_ID_CURR long, v int")
    for read in (lambda df: df.count(), lambda df: df.select("v").collect()):
        with pytest.raises(Exception, match="is not unique among parents"):
            read(K.many_to_one_inner(child, parents))
        with pytest.raises(Exception, match="differs from their parent"):
            read(K.many_to_one_inner(carried, parents.limit(1)))


def test_carried_key(spark):
    parents = spark.createDataFrame([(7, 1), (8, 2)], "SK_ID_PREV long, SK_ID_CURR long")
    schema = "SK_ID_PREV long, SK_ID_CURR long, v int"
    good = spark.createDataFrame([(7, 1, 1), (8, 2, 2)], schema)
    assert rows(K.many_to_one_inner(good, parents).select("SK_ID_CURR", "v")) == [(1, 1), (2, 2)]
    for wrong in (2, None):
        bad = spark.createDataFrame([(7, 1, 1), (7, wrong, 2)], schema)
        with pytest.raises(Exception, match="differs from their parent"):
            K.many_to_one_inner(bad, parents).collect()
        counts = K.key_conflicts(bad, parents).first()
        assert tuple(counts) == (2, 1)


def test_prefix_and_align(spark):
    df = spark.createDataFrame([(1, 2)], "SK_ID_CURR int, val_a int")
    assert K.prefix_columns(df, "test").columns == ["SK_ID_CURR", "TEST_VAL_A"]
    out = K.align_columns(df, {"new": T.StringType(), "val_a": T.IntegerType()})
    assert out.columns == ["new", "val_a"] and tuple(out.first()) == (None, 2)
