from driftframe.api import diff


def test_hundreds_of_fields_and_a_filter_on_the_result(spark):
    n = 120
    left = spark.range(50).selectExpr("id AS key", *[f"id % {i + 2} AS c{i}" for i in range(n)])
    right = spark.range(50).selectExpr("id AS key", *[f"CASE WHEN id = {i % 50} THEN NULL ELSE id % {i + 2} END AS c{i}" for i in range(n)])
    got = diff(left, right, {"keys": ["key"]}).counts().filter("category = 'left_only' AND field LIKE 'c%'").collect()
    assert len(got) == n and all(r["n"] == 1 for r in got)
