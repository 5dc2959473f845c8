import pytest

from slotweave.plans.views import view

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


@pytest.mark.parametrize("first, kind", [(149_990, "bigint"), (54_000_000, "decimal(25,0)")])
def test_numbers_of_placements_hold_any_order(spark, tmp_path, first, kind):
    lines = [(first + k, 1 + k % 7, 7_199_990 + k, 359_990 + k, 10.0, 2.0) for k in range(4)]
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7_199_990 + k, "red steel", "Brand#1", "ECONOMY", 3) for k in range(4)], PART).write.parquet(f"{tmp_path}/part.parquet")
    rows = view(spark, str(tmp_path), "placement").select("src_ord")
    assert rows.schema["src_ord"].dataType.simpleString() == kind
    assert sorted(int(r.src_ord) for r in rows.collect()) == [((o * 8 + n) * 1000000 + p) * 100000 + s for o, n, p, s, *_ in lines]
