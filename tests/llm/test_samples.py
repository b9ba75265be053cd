from pyspark.sql import functions as F

from riskmart.llm import samples


def test_smallest_hashes_of_each_class(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 10 = 0, 'few', 'many') as label")
    df = df.unionAll(df.where("id < 100")).unionAll(spark.sql("select null, 'many'")).unionAll(spark.sql("select 9L, null"))
    got = samples.per_class(df, "id", "label", 700).collect()
    hashed = {r["id"]: r["h"] for r in spark.range(5000).withColumn("h", F.xxhash64("id")).collect()}
    for label, ids, rows in (("few", range(0, 5000, 10), 510), ("many", [i for i in range(5000) if i % 10], 4590)):
        want = sorted(ids, key=lambda i: (hashed[i], i))[:700]
        mine = [r for r in got if r["label"] == label]
        assert sorted(r["id"] for r in mine) == sorted(want)
        assert abs(sum(r["weight"] for r in mine) - rows) < 1e-6


def test_only_a_few_ids_are_ranked(spark, monkeypatch):
    """What reaches the ranking of a class is bounded by the limit, not by the class."""
    frames = []
    stored = samples.kept
    monkeypatch.setattr(samples, "kept", lambda d: frames.append(d) or stored(d))
    got = samples.per_class(spark.range(200_000).selectExpr("id", "'one' as label"), "id", "label", 100)
    assert got.count() == 100
    plan = frames[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [") < plan.index("<= cut")
    cut = -(2.0**63) + 2.0**64 * (100 + 70 + 50) / 200_000
    assert 100 < spark.range(200_000).where(F.xxhash64("id").cast("double") <= cut).count() < 300


def test_one_row_per_sampled_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "c")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], "id long, label int, weight double")
    got = sorted(tuple(r) for r in samples.with_sample(docs, sample, "doc_id", "text").select("id", "label", "text", "weight").collect())
    assert got == [(1, 0, "a", 1.0), (2, 1, None, 2.0)]
