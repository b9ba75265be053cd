import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import credit
from riskmart import schema as S
from riskmart.operators import encoding as EN, features as FE, keys as K

COLUMNS = ["a", "b"]


def values(spark, n=3000):
    return spark.range(n).selectExpr(
        "id", "case when id % 3 = 0 then 'Same' when id % 3 = 1 then concat('v', id % 40) end as a",
        "if(id % 2 = 0, 'X', 'x') as b",
    )


@pytest.fixture(params=["broadcast", "shuffled"])
def side(request, monkeypatch):
    """Both ways to the same result: a small dictionary travels, a large one is shuffled."""
    if request.param == "shuffled":
        monkeypatch.setattr(EN, "BROADCAST_BYTES", -1)
    return request.param


def test_indexes(spark, side):
    df = values(spark)
    d = EN.fit_dictionary(df, COLUMNS, min_count=30)
    entries = [(r["column"], r["value"], r["index"]) for r in d.orderBy("index").collect()]
    kept = sorted({f"v{i % 40}" for i in range(3000) if i % 3 == 1 and sum(1 for k in range(1, 3000, 3) if k % 40 == i % 40) >= 30})
    expected = sorted(["MISSING", "Same", *kept] + (["OTHER"] if len(kept) < 40 else []))
    assert entries == [("a", v, i) for i, v in enumerate(expected)] + [("b", "X", len(expected)), ("b", "x", len(expected) + 1)]
    place = {(c, v): i for c, v, i in entries}
    rows = EN.encode(df.unionByName(df.limit(1).selectExpr("-1L as id", "'new' as a", "'new' as b")), d, COLUMNS).collect()
    assert len(rows) == 3001
    for r in rows:
        assert r["a_INDEX"] == place.get(("a", r["a"] or "MISSING"), place.get(("a", "OTHER")))
        assert r["b_INDEX"] == place.get(("b", r["b"]))


def test_shuffled_join_spreads_a_frequent_value(spark, monkeypatch):
    monkeypatch.setattr(EN, "BROADCAST_BYTES", -1)
    hot = []
    joined = K.join_many_to_one
    monkeypatch.setattr(EN, "join_many_to_one", lambda *a, **k: hot.append(sorted(k["hot"])) or joined(*a, **k))
    df = values(spark)
    EN.encode(df, EN.fit_dictionary(df, COLUMNS, min_count=1), COLUMNS)
    assert hot == [["MISSING", "Same"], ["X", "x"]]


def test_sparse_vectors_of_many_categories(spark, tmp_path):
    """20,000 places, a few of them set in each row; saved and loaded."""
    df = spark.range(20_000).selectExpr("id", "concat('c', id) as c", "if(id % 4 = 0, null, id * 1.0D) as x")
    built = EN.SparseBuilder.fit(df, ["x"], ["c"], min_count=1)
    built.save(str(tmp_path / "builder"))
    loaded = EN.SparseBuilder.load(spark, str(tmp_path / "builder"))
    for b in (built, loaded):
        rows = b.transform(df.where("id in (8, 9)").unionByName(spark.sql("select 7L as id, 'new' as c, 1.0D as x")), for_linear=True).collect()
        by_id = {r["id"]: r["features"] for r in rows}
        assert {v.size for v in by_id.values()} == {2 + 20_000}
        assert [by_id[i].numNonzeros() for i in (7, 8, 9)] == [1, 3, 2]
        assert by_id[8][1] == 1.0 and by_id[8][0] == pytest.approx(b.imputers["x"] / b.scales["x"])
    plain = loaded.transform(df.where("id = 8")).first()["features"]
    assert plain[0] != plain[0]


def test_dense_builder_keeps_values_that_differ_in_case(spark):
    app = credit.applications(
        spark, 30, OCCUPATION_TYPE=lambda i: ("Welder", "WELDER", "welder")[i % 3], NAME_CONTRACT_TYPE=lambda i: ("OTHER", "Other", "x")[min(i % 15, 2)]
    )
    model = FE.fit_reduced_builder(app, minCount=2).setFeaturesCol("features")
    names = model.encoded_columns
    assert {f"OCCUPATION_TYPE_{v}" for v in ("Welder", "WELDER", "welder")} <= set(names)
    rows = FE.build_reduced(app, model).select("SK_ID_CURR", vector_to_array("features").alias("v")).collect()
    given = {r["SK_ID_CURR"]: r for r in app.collect()}
    for r in rows:
        cells = dict(zip(names, r["v"]))
        for v in ("Welder", "WELDER", "welder"):
            assert cells[f"OCCUPATION_TYPE_{v}"] == float(given[r["SK_ID_CURR"]]["OCCUPATION_TYPE"] == v)
        assert sum(v for c, v in cells.items() if c.startswith("NAME_CONTRACT_TYPE_")) == 1.0
    assert len(FE.build_reduced(app, model).columns) == len(names) + 2


def test_dense_and_sparse_builders_agree(spark):
    app = credit.applications(
        spark, 40, OWN_CAR_AGE=lambda i: None if i % 2 else float(i), OCCUPATION_TYPE=lambda i: None if i < 9 else f"o{i % 4}",
    )
    frame = FE.pre_model_frame(app, "REDUCED")
    dense = FE.fit_builder(frame, "REDUCED", minCount=9).setFeaturesCol("features")
    sparse = EN.SparseBuilder.fit(frame, FE.numeric_inputs("REDUCED"), S.CATEGORICAL_COLS, min_count=9)
    for linear in (True, False):
        a = dense.copy({dense.forLinear: linear}).transform(frame).select("SK_ID_CURR", vector_to_array("features").alias("v"))
        b = sparse.transform(frame, linear).select("SK_ID_CURR", vector_to_array("features").alias("v"))
        a, b = ({r[0]: r[1] for r in x.collect()} for x in (a, b))
        for k in a:
            assert b[k] == pytest.approx(a[k], nan_ok=True)
