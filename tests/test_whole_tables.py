from tracewell.queries import lineage


def test_collisions_compare_all_parts(spark, tmp_path):
    rows = [(1, "TIN"), (2, "tin"), (2001, "TIN"), (30000, "Tin"), (30001, "BRASS"), (30002, "BRASS")]
    spark.createDataFrame(rows, "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["key"]: (r["owner"], r["uids"]) for r in lineage.QUERIES["collisions"](spark, str(tmp_path)).collect()}
    assert found == {
        "DB.S.TIN": ("m00000001", "m00000001,m00000002,m00002001,m00030000"),
        "DB.S.BRASS": ("m00030001", "m00030001,m00030002"),
    }
