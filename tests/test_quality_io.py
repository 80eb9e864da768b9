"""Data-quality jobs, CSV ingest, sinks, streaming landing and the summary document."""

from __future__ import annotations

import glob
import json
import os

from builders import build_model, customer, frame, item, order, review
from orderscope.operators import quality
from orderscope.sources import sinks
from orderscope.sources.csv import ingest_csv_dir, read_csv_table
from orderscope.sources.tables import load_tables
from orderscope.streaming.ingest import land_table


def test_invalid_scores_ignore_null(spark):
    reviews = frame(
        spark,
        "order_reviews",
        [review("a", "o", 0), review("b", "o", 6), review("c", "o", None), review("d", "o", 3)],
    )
    assert quality.dq_invalid_scores(reviews).collect()[0]["invalid_review_scores"] == 2


def test_duplicate_rows_with_nulls_count_once(spark):
    rows = [
        {"seller_id": "s1", "seller_city": None, "seller_state": None},
        {"seller_id": "s1", "seller_city": None, "seller_state": None},
        {"seller_id": "s2", "seller_city": None, "seller_state": "SP"},
    ]
    audit = quality.dq_file_audit({"sellers": frame(spark, "sellers", rows)})
    got = {(r["metric"], r["column_name"]): r["value"] for r in audit.collect()}
    assert got[("rows", None)] == 3
    assert got[("duplicate_rows", None)] == 1
    assert got[("nulls", "seller_city")] == 3
    assert got[("nulls", "seller_state")] == 2
    assert ("nulls", "seller_id") not in got
    assert got[("columns", None)] == 4
    assert got[("column", "seller_state")] == 4


def test_duplicate_keys_and_not_null(spark):
    m = build_model(
        spark,
        orders=[order("o1"), order("o2")],
        items=[item("o1", 1), item("o1", 1), item("o2", 1), item(None, 2)],
    )
    dup = {(r["table_name"], r["key_columns"]): r["duplicate_keys"] for r in m.dq_duplicate_keys().collect()}
    assert dup[("order_items", "order_id,order_item_id")] == 1
    assert dup[("orders", "order_id")] == 0
    assert dup[("orders", "customer_id")] == 0
    nn = {(r["table_name"], r["column_name"]): r["null_rows"] for r in m.dq_not_null().collect()}
    assert nn[("order_items", "order_id")] == 1
    assert nn[("orders", "customer_id")] == 0
    counts = {r["table_name"]: r["rows_loaded"] for r in m.dq_row_counts().collect()}
    assert counts["order_items"] == 4 and counts["orders"] == 2


CSV_REVIEWS = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,o1,5,,"line one\nline two",2018-01-01 00:00:00,2018-01-02 10:00:00\n'
    'r2,o2,4,"say ""hi""",NA,2018-01-01 00:00:00,not a date\n'
    'r3,o3,1,"",plain,2018-01-01 00:00:00,2018-01-03 00:00:00\n'
)

CSV_PRODUCTS = (
    "product_id,product_category_name,product_name_lenght,product_description_lenght,"
    "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
    "p1,beleza,40,287,1,225,16,10,14\n"
    "p2,,,,,,,,\n"
)


def test_csv_reader_quotes_nulls_bad_dates_and_positional_header(spark, tmp_dir):
    path = os.path.join(tmp_dir, "reviews.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(CSV_REVIEWS)
    rows = {r["review_id"]: r for r in read_csv_table(spark, path, "order_reviews").collect()}
    assert len(rows) == 3
    assert rows["r1"]["review_comment_message"] == "line one\nline two"
    assert rows["r1"]["review_comment_title"] is None
    assert rows["r2"]["review_comment_title"] == 'say "hi"'
    assert rows["r2"]["review_comment_message"] == "NA"
    assert rows["r2"]["review_answer_timestamp"] is None
    assert rows["r2"]["review_score"] == 4
    assert rows["r3"]["review_comment_title"] is None
    assert str(rows["r1"]["review_answer_timestamp"]) == "2018-01-02 10:00:00"

    ppath = os.path.join(tmp_dir, "products.csv")
    with open(ppath, "w", encoding="utf-8") as fh:
        fh.write(CSV_PRODUCTS)
    products = read_csv_table(spark, ppath, "products", multi_line=False)
    assert "product_name_length" in products.columns
    prow = {r["product_id"]: r for r in products.collect()}
    assert prow["p1"]["product_name_length"] == 40
    assert prow["p2"]["product_category_name"] is None and prow["p2"]["product_weight_g"] is None


def test_csv_ingest_round_trip(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    with open(os.path.join(raw, "order_reviews.csv"), "w", encoding="utf-8") as fh:
        fh.write(CSV_REVIEWS)
    with open(os.path.join(raw, "products.csv"), "w", encoding="utf-8") as fh:
        fh.write(CSV_PRODUCTS)
    out = os.path.join(tmp_dir, "landed")
    names = ("order_reviews", "products")
    assert ingest_csv_dir(spark, raw, out, names) == list(names)
    tables = load_tables(spark, out, names)
    assert tables["order_reviews"].count() == 3
    assert tables["products"].schema == read_csv_table(
        spark, os.path.join(raw, "products.csv"), "products"
    ).schema


def test_json_sink_keeps_null_fields_and_never_nan(spark, tmp_dir):
    df = spark.createDataFrame([("s1", None, float("nan")), ("s2", 2.5, 1.0)], "id string, score double, rate double")
    path = os.path.join(tmp_dir, "json")
    sinks.write_json_lines(df, path, single_file=True)
    lines = [json.loads(x) for f in glob.glob(os.path.join(path, "*.json")) for x in open(f)]
    s1 = next(x for x in lines if x["id"] == "s1")
    assert "score" in s1 and s1["score"] is None and s1["rate"] is None


def test_summary_document_is_bounded_json(spark):
    orders = [order(f"o{i}", delivered="2018-01-20 00:00:00" if i % 3 == 0 else "2018-01-05 00:00:00") for i in range(12)]
    reviews = [review(f"r{i}", f"o{i}", 1 + i % 5) for i in range(12)]
    m = build_model(spark, orders=orders, reviews=reviews)
    doc = m.summary_document().collect()
    assert len(doc) == 1
    parsed = json.loads(doc[0]["summary_json"])
    assert set(parsed) == {"kpis", "findings"}
    assert parsed["kpis"]["delivered_orders"] == 12
    f = parsed["findings"]
    assert set(f) >= {"priority_categories", "high_freight_states", "seller_risk", "priority_sellers"}
    assert len(f["priority_categories"]) <= 8 and len(f["high_freight_states"]) <= 8
    assert len(f["priority_sellers"]) <= 10
    assert f["seller_risk"]["minimum_orders"] == 100


def test_write_outputs(spark, tmp_dir):
    m = build_model(spark, orders=[order("o1"), order("o2")], reviews=[review("a", "o1", 2)])
    written = sinks.write_outputs(m, tmp_dir)
    assert os.path.isdir(written["delay_impact"]) and os.path.isdir(written["payload/seller_performance"])
    text = "".join(open(f).read() for f in glob.glob(os.path.join(written["analysis_summary"], "part-*")))
    assert json.loads(text)["kpis"]["delivered_orders"] == 2


def test_streaming_landing_appends_new_files_once(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    out = os.path.join(tmp_dir, "out")
    ckpt = os.path.join(tmp_dir, "ckpt")
    with open(os.path.join(landing, "a.csv"), "w", encoding="utf-8") as fh:
        fh.write(CSV_REVIEWS)
    land_table(spark, landing, out, ckpt, "order_reviews").awaitTermination()
    assert spark.read.parquet(out).count() == 3
    with open(os.path.join(landing, "b.csv"), "w", encoding="utf-8") as fh:
        fh.write(CSV_REVIEWS.replace("r1,", "r9,"))
    land_table(spark, landing, out, ckpt, "order_reviews").awaitTermination()
    landed = spark.read.parquet(out)
    assert landed.count() == 6
    assert landed.where("review_id = 'r9'").collect()[0]["review_comment_message"] == "line one\nline two"


def test_landed_text_columns_are_coerced(spark, tmp_dir):
    root = os.path.join(tmp_dir, "landed")
    spark.createDataFrame(
        [("o1", "c1", "delivered", "2018-01-01 10:00:00", None, None, "2018-01-03 10:00:00", "oops")],
        "order_id string, customer_id string, order_status string, order_purchase_timestamp string, "
        "order_approved_at string, order_delivered_carrier_date string, "
        "order_delivered_customer_date string, order_estimated_delivery_date string",
    ).write.parquet(os.path.join(root, "orders"))
    row = load_tables(spark, root, ("orders",))["orders"].collect()[0]
    assert str(row["order_purchase_timestamp"]) == "2018-01-01 10:00:00"
    assert row["order_estimated_delivery_date"] is None


def test_orphans_count_null_keys(spark):
    from builders import build_tables

    t = build_tables(spark, orders=[order("o1")], items=[item("o1"), item(None, 2), item(None, 3), item("zz")])
    got = quality.dq_orphan_items(t["order_items"], t["orders"]).collect()[0]["items_without_orders"]
    assert got == 3


def test_integrity_gate_lists_failures(spark):
    import pytest as _pytest
    from builders import build_tables

    clean = build_tables(spark, orders=[order("o1"), order("o2")])
    quality.check_integrity(clean)
    dirty = build_tables(
        spark,
        orders=[order("o1"), order("o1")],
        items=[item("o1"), item("ghost")],
        reviews=[review("r1", "o1", 9)],
    )
    with _pytest.raises(quality.IntegrityError) as err:
        quality.check_integrity(dirty)
    text = str(err.value)
    assert "duplicate_keys orders.order_id=1" in text
    assert "orphan_items order_items.order_id=1" in text
    assert "invalid_scores order_reviews.review_score=1" in text


def test_duplicate_keys_report_every_check_on_empty_tables(spark):
    empty = {"orders": frame(spark, "orders", []), "sellers": frame(spark, "sellers", [])}
    got = {(r["table_name"], r["key_columns"]): r["duplicate_keys"] for r in quality.dq_duplicate_keys(empty).collect()}
    assert got == {("orders", "order_id"): 0, ("orders", "customer_id"): 0, ("sellers", "seller_id"): 0}


def test_numbers_that_cannot_be_read_are_counted_not_guessed(spark, tmp_dir):
    from decimal import Decimal

    import pytest as _pytest
    from orderscope.plans.jobs import run_build
    from orderscope.sources.csv import read_csv_fields, typed_rows
    from test_jobs import RAW

    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    for name, text in RAW.items():
        with open(os.path.join(raw, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    rows = ["abc,1", '"10,00",2', "99999999999.00,3", "1.005,", ",4", "12.50,bad", "+7,1e3"]
    with open(os.path.join(raw, "order_items.csv"), "w", encoding="utf-8") as fh:
        fh.write("order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n")
        fh.writelines(f"o1,{i},p1,s1,not a date,{r}\n" for i, r in enumerate(rows, start=1))
    path = os.path.join(raw, "order_items.csv")
    typed = read_csv_table(spark, path, "order_items").orderBy("order_item_id").collect()
    assert [r["price"] for r in typed] == [None, None, None, None, None, Decimal("12.50"), Decimal("7.00")]
    assert [r["freight_value"] for r in typed] == [1, 2, 3, None, 4, None, None]
    assert {r["shipping_limit_date"] for r in typed} == {None}
    fields = read_csv_fields(spark, path, "order_items")
    bad = {(r["metric"], r["column_name"]): r["unparsed_rows"] for r in quality.dq_unparsed({"order_items": fields}).collect()}
    assert bad == {
        ("row", None): 0,
        ("number", "order_item_id"): 0,
        ("number", "price"): 4,
        ("number", "freight_value"): 2,
        ("timestamp", "shipping_limit_date"): 7,
    }
    with _pytest.raises(Exception, match="cannot read"):
        typed_rows(fields, "order_items", fail=True).collect()
    with _pytest.raises(quality.IntegrityError, match="unparsed order_items.price=4"):
        run_build(spark, raw, os.path.join(tmp_dir, "landed"), os.path.join(tmp_dir, "out"), strict=True)


def test_duplicate_join_keys_raise_before_anything_is_written(spark):
    import pytest as _pytest
    from builders import build_tables

    tables = build_tables(spark, orders=[order("o1")], translation=[
        {"product_category_name": "x", "product_category_name_english": "a"},
        {"product_category_name": "x", "product_category_name_english": "b"},
    ])
    from orderscope.plans.commerce import CommerceModel

    with _pytest.raises(quality.IntegrityError, match="category_translation.product_category_name=x"):
        CommerceModel(tables).materialize()


def test_audit_of_an_empty_folder(spark, tmp_dir):
    from orderscope.plans.jobs import run_file_audit

    raw = os.path.join(tmp_dir, "none")
    os.makedirs(raw)
    assert quality.dq_file_audit({}).count() == 0
    run_file_audit(spark, raw, os.path.join(tmp_dir, "out"))


def test_all_statuses_and_null_freight(spark):
    """An order without a customer still counts, and NULL freight leaves the GMV in the burden."""
    model = build_model(
        spark,
        orders=[order("o1"), order("o2"), order("o3")],
        customers=[customer("c_o1"), customer("c_o2")],
        items=[item("o1", price="10.00", freight="2.00"), item("o2", price="30.00", freight=None), item("o3")],
    )
    assert model.kpi_extended().first()["orders_all_statuses"] == 3
    assert abs(model.state_performance().first()["freight_burden"] - 2 / 42) < 1e-12


def write_files(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
            fh.write(text)


PAYMENTS = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"


def test_malformed_rows_are_counted_kept_apart_and_never_typed(spark, tmp_dir):
    from decimal import Decimal

    import pytest as _pytest
    from orderscope.plans.jobs import run_build
    from orderscope.sources.csv import land_csv_dir, read_csv_fields, rejected_rows, typed_rows
    from test_jobs import RAW

    raw = os.path.join(tmp_dir, "raw")
    rows = ["a,1,ca,1", "b,1,ca,1,10,00", "c,1,ca,rd,1,10.00", "d,1,ca,1,12.50", "", "e,1,ca,1,"]
    write_files(raw, RAW | {"order_payments.csv": PAYMENTS + "\n".join(rows) + "\n"})
    path = os.path.join(raw, "order_payments.csv")
    for multi_line in (None, False, True):
        fields = read_csv_fields(spark, path, "order_payments", multi_line)
        typed = {r["order_id"]: r["payment_value"] for r in typed_rows(fields, "order_payments").collect()}
        assert typed == {"d": Decimal("12.50"), "e": None}
        assert typed_rows(fields, "order_payments").count() == 2  # no column of the file is asked for
        kept = {tuple(r) for r in rejected_rows(fields, "order_payments").collect()}
        assert kept == {("order_payments", r) for r in rows[:3]}
        found = {(r["metric"], r["column_name"]): r["unparsed_rows"] for r in quality.dq_unparsed({"order_payments": fields}).collect()}
        assert found[("row", None)] == 3 and found[("number", "payment_value")] == 0
    with _pytest.raises(Exception, match="wrong number of fields"):
        typed_rows(fields, "order_payments", fail=True).collect()
    landed = {t.table: t for t in land_csv_dir(spark, raw, os.path.join(tmp_dir, "landed"), ("order_payments", "orders", "category_translation"))}
    assert (landed["order_payments"].rows, landed["order_payments"].malformed) == (2, 3)
    assert landed["orders"].malformed == 0 and landed["orders"].rows == 2
    assert landed["orders"].nulls == {"order_id": 0, "customer_id": 0}
    assert spark.read.parquet(os.path.join(tmp_dir, "landed", "_rejected", "order_payments")).count() == 3
    out = os.path.join(tmp_dir, "out")
    with _pytest.raises(quality.IntegrityError, match="malformed order_payments=3"):
        run_build(spark, raw, os.path.join(tmp_dir, "strict"), out, strict=True)
    report = spark.read.option("header", True).csv(os.path.join(out, "quality", "dq_unparsed"))
    assert report.where("metric = 'row' and table_name = 'order_payments'").first()["unparsed_rows"] == "3"
    run_build(spark, raw, os.path.join(tmp_dir, "lenient"), out)


def test_null_keys_are_counted_by_the_landing_write(spark, tmp_dir):
    import pytest as _pytest
    from orderscope.plans.jobs import run_build
    from test_jobs import RAW

    raw = os.path.join(tmp_dir, "raw")
    write_files(raw, RAW | {"sellers.csv": RAW["sellers.csv"] + ",1,x,SP\n"})
    with _pytest.raises(quality.IntegrityError, match="not_null sellers.seller_id=1"):
        run_build(spark, raw, os.path.join(tmp_dir, "landed"), os.path.join(tmp_dir, "out"), strict=True)


def test_malformed_rows_stop_the_stream(spark, tmp_dir):
    import pytest as _pytest

    write_files(os.path.join(tmp_dir, "landing"), {"a.csv": PAYMENTS + "a,1,ca,1,1.00\nb,1,ca,1\n"})
    with _pytest.raises(Exception, match="wrong number of fields"):
        land_table(spark, os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), "order_payments").awaitTermination()


def test_files_without_quoted_newlines_keep_their_splits(spark, tmp_dir):
    from orderscope.sources.csv import read_csv_fields, rejected_rows

    head, *rows = CSV_REVIEWS.split("\n", 1)
    plain = head + "\n" + "".join(f'r{i},o{i},5,,"one, ""line"" only",2018-01-01 00:00:00,2018-01-02 10:00:00\n' for i in range(3000))
    write_files(os.path.join(tmp_dir, "plain"), {"a.csv": plain})
    write_files(os.path.join(tmp_dir, "both"), {"a.csv": plain, "b c.csv": CSV_REVIEWS})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        plain = read_csv_fields(spark, os.path.join(tmp_dir, "plain"), "order_reviews")
        assert plain.rdd.getNumPartitions() > 5 and plain.count() == 3000
        both = read_csv_fields(spark, os.path.join(tmp_dir, "both"), "order_reviews")
        assert both.count() == 3003 and rejected_rows(both, "order_reviews").count() == 0
        assert both.where("review_id = 'r1' and review_comment_message like '%two'").count() == 1
        whole = read_csv_fields(spark, os.path.join(tmp_dir, "both", "b c.csv"), "order_reviews")
        assert whole.rdd.getNumPartitions() == 1 and whole.count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_audit_of_many_files_is_one_plan(spark, tmp_dir):
    from orderscope.sources.csv import read_csv_dir
    from orderscope.testing.plans import plan_text

    folder = os.path.join(tmp_dir, "many")
    files = {f"f{i}.csv": f"a,b{i}\n1,\n1,\n,{i}\n" for i in range(150)}
    files["odd name+1.csv"] = 'x,"y, z",\n"two\nlines",,3\n"two\nlines",,3\n1,2,3,4\n'
    files["empty.csv"] = ""
    files["header.csv"] = "only,header"
    write_files(folder, files)
    audit = quality.dq_csv_audit(*read_csv_dir(spark, folder))
    assert plan_text(audit).count("Scan csv") <= 8  # with and without quoted newlines, totals and nulls, each printed twice
    got = {}
    for r in audit.collect():
        got.setdefault(r["table_name"], {})[(r["metric"], r["column_name"])] = r["value"]
    assert len(got) == 152 and "empty.csv" not in got
    for i in (0, 7, 149):
        assert got[f"f{i}.csv"] == {
            ("rows", None): 3, ("duplicate_rows", None): 1, ("columns", None): 2,
            ("column", "a"): 1, ("column", f"b{i}"): 2, ("nulls", "a"): 1, ("nulls", f"b{i}"): 2,
        }
    assert got["odd name+1.csv"] == {
        ("rows", None): 3, ("duplicate_rows", None): 1, ("columns", None): 3, ("wide_rows", None): 1,
        ("column", "x"): 1, ("column", "y, z"): 2, ("column", ""): 3, ("nulls", "y, z"): 2,
    }
    assert got["header.csv"][("rows", None)] == 0 and got["header.csv"][("column", "header")] == 2


def test_audit_of_columns_with_any_names(spark):
    rows = [(None, "a", "m"), ("a", None, "m"), ("a", None, "m")]
    df = spark.createDataFrame(rows, "n string, mask string, d1 string").withColumnRenamed("d1", "cell0")
    got = {(r["metric"], r["column_name"]): r["value"] for r in quality.dq_file_audit({"t": df}).collect()}
    assert got[("rows", None)] == 3 and got[("duplicate_rows", None)] == 1
    assert got[("nulls", "n")] == 1 and got[("nulls", "mask")] == 2 and ("nulls", "cell0") not in got


def test_strict_nulls_at_any_depth(spark, tmp_dir):
    schema = "id int, s struct<x: double, t: struct<y: float>>, a array<double>, m map<string, struct<z: double>>, k map<double, int>, `dotted.name` double"
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, (nan, (nan,)), [1.0, nan, None, inf], {"p": (nan,), "q": (2.0,)}, {nan: 1, 1.0: 2}, -inf),
        (2, None, None, None, None, 1.0),
        (3, (None, None), [], {}, {}, None),
    ]
    path = os.path.join(tmp_dir, "json")
    sinks.write_json_lines(spark.createDataFrame(rows, schema), path, single_file=True)

    def no_constant(name):
        raise AssertionError(name)

    text = "".join(open(f).read() for f in glob.glob(os.path.join(path, "*.json")))
    found = {r["id"]: r for r in (json.loads(x, parse_constant=no_constant) for x in text.splitlines())}
    assert found[1] == {
        "id": 1, "s": {"x": None, "t": {"y": None}}, "a": [1.0, None, None, None], "m": {"p": {"z": None}, "q": {"z": 2.0}},
        "k": {"1.0": 2}, "dotted.name": None,
    }
    assert found[2] == {"id": 2, "s": None, "a": None, "m": None, "k": None, "dotted.name": 1.0}
    assert found[3]["s"] == {"x": None, "t": None} and found[3]["a"] == [] and found[3]["m"] == {}


def test_readers_see_whole_builds_only(spark, tmp_dir, monkeypatch):
    import pytest as _pytest

    with _pytest.raises(FileNotFoundError):
        sinks.read_manifest(spark, tmp_dir)
    first = sinks.write_outputs(build_model(spark, orders=[order("o1")]), tmp_dir)
    assert sinks.read_manifest(spark, tmp_dir) == first
    broken = build_model(spark, orders=[order("o1"), order("o2")])
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_document", lambda *a, **k: 1 / 0)
        with _pytest.raises(ZeroDivisionError):
            sinks.write_outputs(broken, tmp_dir)
    assert sinks.read_manifest(spark, tmp_dir) == first  # the tables of the failed build are not seen
    second = sinks.write_outputs(broken, tmp_dir)
    assert sinks.read_manifest(spark, tmp_dir) == second and second["delay_impact"] != first["delay_impact"]
    assert set(second) >= {"analysis_summary", "payload/delay_impact", "order_fact"}
    assert sinks.remove_builds(spark, tmp_dir, keep=1) == [os.path.basename(os.path.dirname(first["order_fact"]))]
    assert not os.path.exists(first["order_fact"]) and os.path.exists(second["order_fact"])
