from pyspark.sql import functions as F

from tablewarden.functions import names
from tablewarden.operators import metadata
from tablewarden.operators.metadata import infer_metadata, mismatched_links
from tablewarden.operators.profile import distinct_counts, profile_plan, profile_tables
from tablewarden.schemas import TableMeta


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_name_rules(spark):
    assert apply(spark, names.norm, ["Order-Date 1", "", "a_b"]) == ["orderdate1", "", "ab"]
    assert apply(spark, names.key_stem, ["customer_id", " Customer_SK ", "x_KEY", "id", "note"]) == [
        "customer", "Customer", "x", None, None]
    assert apply(spark, names.key_suffix, ["customer_id", "Customer_SK", "note"]) == ["_id", "_sk", None]
    assert apply(spark, names.singular, ["sales", "categories", "classes", "houses", "stores", "class", "s", "ies"]) == [
        "sales", "category", "class", "house", "store", "class", "s", "ie"]
    assert apply(spark, names.table_entity, ["dim_customers", "fact_sales_normalized", "dim_", "orders", "Fact_Injected_items"]) == [
        "customer", "sales", "", "order", "item"]
    assert apply(spark, names.key_entity, ["customer_sk", "sales_id", "_id", "weekday"]) == ["customer", "sales", None, None]
    assert apply(spark, names.table_role, ["FACT_x", "artifact", "dim_a"]) == ["fact", "fact", "dimension"]
    assert apply(spark, names.is_date_name, ["weekday", "start_date_sk", "amount"]) == [True, True, False]
    assert apply(spark, names.is_promo_name, ["Promo", "campaign_sk", "price"]) == [True, True, False]


def test_roles_keys_and_links(make):
    tables = {
        "fact_sales": make("sales_sk long, customer_sk long, product_id string, sale_date string, amount double, flag boolean, discount double",
                           [(i, i % 5, f"p{i % 3}", "2024-01-01", 1.0, True, 0.1) for i in range(30)]),
        "dim_customers": make("customer_sk long, customer_id string, name string", [(i, f"c{i}", "n") for i in range(5)]),
        "dim_products": make("product_sk long, product_id string", [(i, f"p{i}") for i in range(3)]),
    }
    meta = infer_metadata(tables)
    fact = meta["fact_sales"]
    assert fact.role == "fact" and fact.primary_keys == ("sales_sk",)
    # the text key goes to the equally named unique column, not to the surrogate key
    assert fact.foreign_keys == {"customer_sk": ("dim_customers", "customer_sk"),
                                 "product_id": ("dim_products", "product_id")}
    assert fact.date_cols == ("sale_date",) and fact.promo_cols == ("discount",)
    assert fact.numeric_cols == ("amount", "discount")
    assert meta["dim_customers"].primary_keys == ("customer_sk",)
    assert mismatched_links(tables, meta) == []


def test_key_with_gaps_and_repeats(make):
    repeated = list(range(1, 951)) + list(range(1, 31)) + [None] * 20
    fact = make("sales_sk long, amount double", [(k, 1.0) for k in repeated])
    dim = make("store_sk long, store_name string", [(1, "a"), (1, "b")])
    meta = infer_metadata({"fact_sales": fact, "dim_stores": dim})
    assert meta["fact_sales"].primary_keys == ()
    assert meta["dim_stores"].primary_keys == ("store_sk",)       # a dimension keeps its first candidate


def test_override_and_last_dimension_wins(make):
    fact = make("store_id long, amount double", [(1, 2.0)] * 3)
    a, b = (make("store_id long", [(1,), (2,)]) for _ in range(2))
    meta = infer_metadata({"fact_x": fact, "dim_store": a, "dim_stores": b})
    assert meta["fact_x"].foreign_keys == {"store_id": ("dim_stores", "store_id")}
    given = TableMeta("fact", primary_keys=("amount",))
    assert infer_metadata({"fact_x": fact, "dim_store": a}, override={"fact_x": given})["fact_x"] is given


def test_profile_counts_nan_as_missing(make):
    df = make("x double, d string", [(float("nan"), "2024-01-01"), (None, None), (2.0, "x"), (4.0, "y")])
    rows = {r["column"]: r for r in profile_tables({"t": df}).collect()}
    assert (rows["x"]["n_rows"], rows["x"]["n_null"], rows["x"]["mean"], rows["x"]["max"]) == (4, 2, 3.0, 4.0)
    assert rows["d"]["n_null"] == 1 and rows["d"]["min"] is None


def test_sketch_rules_out_clear_non_keys(make, monkeypatch):
    """No exact distinct count of a column that is far from unique; one that is nearly unique is still counted exactly."""
    rows = [(i, f"c{i % 40}", i // 2 * 3 if i < 20 else i * 3) for i in range(2000)]
    tables = {"fact_sale": make("sale_key long, code_id string, near_id long", rows)}
    profile = profile_tables(tables, measures=("missing", "range"), about=metadata.key_columns(tables))
    about = {r["column"]: r["n_about"] for r in profile.collect()}
    assert abs(about["code_id"] - 40) <= 4 and about["sale_key"] > 1800
    counted = []
    monkeypatch.setattr(metadata, "distinct_counts", lambda t, asked: counted.append(asked) or distinct_counts(t, asked))
    found = metadata.unique_columns(tables, profile, {"fact_sale": ["sale_key", "code_id", "near_id"]})
    assert found == {("fact_sale", "sale_key")} and counted == [{"fact_sale": ["sale_key", "near_id"]}]


def test_profile_holds_only_what_is_asked(spark):
    lines = {"t": spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")}
    text = lambda **more: profile_plan(lines, **more)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]        # noqa: E731
    sizes, missing, everything = text(measures=()), text(measures=("missing",)), text()
    assert "ReadSchema: struct<>" in sizes
    assert "stddev" not in missing and "max(" not in missing and "l_tax" in missing and "stddev" in everything
    row = profile_plan(lines, measures=("missing",)).where("column = 'l_tax'").first()
    assert row["n_rows"] > 0 and row["n_null"] == 0 and row["mean"] is None and row["min"] is None
