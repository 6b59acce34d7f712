"""SRC-16..19 listing, detail, preview, search; SQL-5 preview; CTE reads allowed."""
from sluice.operators import sql as S
from sluice.sources.catalog import search, source_listing, table_detail, table_preview


def test_catalog_operators(spark):
    spark.range(120).selectExpr("id", "cast(id % 7 as string) as tag").write.mode("overwrite").saveAsTable("cat_items")
    spark.range(3).write.mode("overwrite").saveAsTable("_internal_state")
    listing = source_listing(spark)
    rows = {r.name: r.row_count for r in listing.collect()}
    assert rows["cat_items"] == 120 and "_internal_state" not in rows
    assert [r.name for r in search(listing, "CAT_").collect()] == ["cat_items"]
    d = table_detail(spark, "cat_items")
    assert [c["name"] for c in d["columns"]] == ["id", "tag"] and "CREATE TABLE" in d["ddl"].upper()
    assert len(d["preview"]["rows"]) == 100
    p = table_preview(spark, "cat_items")
    assert len(p["rows"]) == 50 and p["total"] == 120 and p["rows"][0][1] in {str(i) for i in range(7)}
    cols, rows = S.preview(spark.sql("select * from cat_items order by id"))
    assert cols == ["id", "tag"] and len(rows) == 20 and rows[0] == ["0", "0"]
    _, rows, _ = S.read_only_query(spark, "with q as (select max(id) as m from cat_items) select m from q")
    assert rows == [["119"]]
    _, rows, _ = S.read_only_query(spark, "explain select * from cat_items")
    assert rows
