from driftframe.llm.sampling import smallest


def test_bound_does_not_change_the_sample(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as g", "case when id < 10 then null else id end as x").repartition(5)
    rows = df.selectExpr("*", "xxhash64(id, 7) as h").collect()
    want = sorted(r["id"] for r in sorted(rows, key=lambda r: r["h"])[:100])
    assert sorted(r["id"] for r in smallest(df, 100, ["id"], 7).collect()) == want
    for g in range(3):
        own = sorted(r["id"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["h"])[:50])
        assert sorted(r["id"] for r in smallest(df, 50, ["id"], 7, each="g").filter(f"g = {g}").collect()) == own
    assert smallest(df, 9000, ["id"], 7).count() == 5000 and smallest(df.limit(0), 5, ["id"], 7).count() == 0
