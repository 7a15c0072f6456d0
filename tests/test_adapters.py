from matchloom.sources.adapters import load


def test_adapters_cover_all_rows(spark, small):
    orders, lines, customer = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("orders", "lineitem", "customer"))
    n = orders.count()
    assert load(spark, small, "rates").select("match_id").distinct().count() == n
    assert load(spark, small, "odds").groupBy("outcome").count().where(f"count = {n}").count() == 11
    played = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    assert load(spark, small, "lineups").count() == played.selectExpr("cast(o_orderdate as date)", "c_nationkey", "l_suppkey").distinct().count()
