"""Cleaning quirks on a hand-written dirty table and a small CSV of our own."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cuadro.operators import clean
from cuadro.sources import csv as csv_src

DIRTY = [
    # order_id, Date, product, price, qty, note
    ("1", "17-03-2019", "  Lamp ", "8.25", "41.5", "Ada      Quill"),
    ("2", "18-03-2019", "\tDesk", "1d", "6", "x"),
    ("3", "30-06-2019", "Lamp", "inf", "1,000", None),
    ("4", "02-01-2020", None, "nan", "12", "  "),
]
COLS = "order_id string, Date string, product string, price string, qty string, note string"


def test_clean_table_types_and_values(spark):
    df = spark.createDataFrame(DIRTY, COLS)
    out = clean.clean_table(df)
    types = dict((f.name, f.dataType.simpleString()) for f in out.schema.fields)
    assert types == {"order_id": "bigint", "Date": "timestamp_ntz", "product": "string",
                     "price": "double", "qty": "double", "note": "string"}
    rows = {r["order_id"]: r for r in out.collect()}
    assert rows[1]["Date"] == dt.datetime(2019, 3, 17)          # day first
    assert rows[1]["product"] == "Lamp"                         # outer blanks and tabs stripped
    assert rows[2]["product"] == "Desk"
    assert rows[1]["note"] == "Ada      Quill"                 # inner runs kept
    assert rows[4]["note"] == ""
    assert rows[1]["price"] == 8.25
    assert rows[2]["price"] is None and rows[3]["price"] is None and rows[4]["price"] is None  # 1d, inf, nan
    assert rows[3]["qty"] is None and rows[2]["qty"] == 6.0    # '1,000' is not a number: lossy


def test_null_label(spark):
    df = spark.createDataFrame(DIRTY, COLS)
    out = clean.clean_table(df.select("order_id", "product"), null_label="nan")
    assert {r["product"] for r in out.collect()} == {"Lamp", "Desk", "nan"}


def test_dates_are_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "31-02-2022"), ("2", "07-11-2022")], "id string, Date string")
    out = clean.clean_table(df)
    assert out.schema["Date"].dataType.simpleString() == "string"   # one impossible date keeps the text
    iso = spark.createDataFrame([("1", "2022-11-07")], "id string, order_date string")
    assert clean.clean_table(iso).first()["order_date"] == dt.datetime(2022, 11, 7)   # ISO stays ISO


def test_numbers_named_date_are_not_dates(spark):
    df = spark.createDataFrame([(1, 5)], "update_count long, candidate long")
    assert clean.clean_table(df).schema == df.schema


def test_cascade(spark):
    df = spark.createDataFrame([("12-31-2022",), ("01-02-2022",)], "Date string")
    out = clean.cascade_dates(df)          # day-first fails on 12-31 → month-first for all
    assert sorted(r["Date"] for r in out.collect()) == [dt.datetime(2022, 1, 2), dt.datetime(2022, 12, 31)]
    mixed = spark.createDataFrame([("07-11-2022",), ("2022/11/08",)], "Date string")
    assert sorted(r["Date"] for r in clean.cascade_dates(mixed).collect()) == \
        [dt.datetime(2022, 11, 7), dt.datetime(2022, 11, 8)]


def test_min_ratio(spark):
    df = spark.createDataFrame([("1",), ("a",), ("b",)], "v string")
    assert clean.clean_table(df).schema["v"].dataType.simpleString() == "double"
    assert clean.clean_table(df, min_ratio=0.5).schema["v"].dataType.simpleString() == "string"


def test_row_total(spark):
    df = spark.createDataFrame([(8.253, 41.57), (None, 1.0)], "Price double, Quantity double")
    got = [r["total"] for r in clean.row_total(df).collect()]
    assert str(got[0]) == "343.08" and got[1] is None


CSV_TEXT = '''Order ID,Date,Product,Price,Quantity,Purchase Type,Payment Method,Manager,City
71,17-03-2019,Lamp,8.25,41.5,Phone , Voucher,       Ada Quill,Bergen
72,17-03-2019,Desk,120.0,3.0,Phone , Voucher,       Ada Quill,Bergen
73,18-03-2019,"Rug, round",15.75,2.25,Counter , Voucher,Bo    Reed,Turku
74,18-03-2019,Chair,NA,NA,Van ,Coins,"Cy ""C"" Moss",Ghent
'''


def test_csv_scan_and_load(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sales.csv")
    with open(path, "w") as f:
        f.write(CSV_TEXT)
    raw = csv_src.scan_csv(spark, path)
    assert raw.columns[:9] == ["Order ID", "Date", "Product", "Price", "Quantity", "Purchase Type",
                               "Payment Method", "Manager", "City"]
    df = csv_src.load_csv(spark, path).orderBy(*csv_src.ORDER_KEY)
    rows = df.collect()
    assert [r["Order ID"] for r in rows] == [71, 72, 73, 74]
    assert rows[0]["Payment Method"] == "Voucher" and rows[0]["Purchase Type"] == "Phone"
    assert rows[2]["Product"] == "Rug, round"
    assert rows[3]["Manager"] == 'Cy "C" Moss'
    assert rows[3]["Price"] is None                 # NA token
    assert rows[0]["Date"] == dt.datetime(2019, 3, 17)
    charts = csv_src.load_csv_for_charts(spark, path)
    assert charts.schema["Date"].dataType.simpleString() == "timestamp_ntz"
    assert charts.where(F.col("Order ID") == 71).first()["Payment Method"] == " Voucher"   # no strip


def test_resolve_source(spark, tmp_dir):
    raw_dir = os.path.join(tmp_dir, "raw")
    os.makedirs(raw_dir)
    assert csv_src.resolve_source(spark, store_name="ventas_data", raw_dir=raw_dir) is None
    with open(os.path.join(raw_dir, "Sales-Data-Analysis.csv"), "w") as f:
        f.write(CSV_TEXT)
    assert csv_src.resolve_source(spark, store_name="ventas_data", raw_dir=raw_dir).count() == 4
    with open(os.path.join(raw_dir, "ventas-Data-Analysis.csv"), "w") as f:
        f.write(CSV_TEXT.split("\n", 2)[0] + "\n" + CSV_TEXT.split("\n", 2)[1] + "\n")
    assert csv_src.resolve_source(spark, store_name="ventas_data", raw_dir=raw_dir).count() == 1


def test_short_and_long_csv_rows(spark, tmp_dir):
    import pytest
    path = os.path.join(tmp_dir, "ragged.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,2,3\n4,5\n\"x,y\",\"p\"\"q,\",z\n")
    rows = [tuple(r) for r in csv_src.scan_csv(spark, path, with_order=False).collect()]
    assert rows == [("1", "2", "3"), ("4", "5", None), ("x,y", 'p"q,', "z")]
    with open(path, "a") as f:
        f.write("6,7,8,9\n")                                     # too long: the load stops, also when only counted
    for mode in ("PERMISSIVE", "FAILFAST"):
        with pytest.raises(Exception):
            csv_src.scan_csv(spark, path, mode=mode, with_order=False).collect()
    with pytest.raises(Exception, match="more fields"):
        csv_src.scan_csv(spark, path, with_order=False).select("b").collect()


def test_truth_values_and_more_dates(spark):
    df = spark.createDataFrame([("True", "12-31-2022", "07/11/69", "7 nov 2022", "7/11/2022 1:05 pm", "true"),
                                ("False", "01-02-2023", "08/11/68", "8 DEC 2022", "8/11/2022 12:00 AM", None)],
                               "flag string, date1 string, date2 string, date3 string, date4 string, gap string")
    out = clean.clean_table(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["boolean"] + ["timestamp_ntz"] * 4 + ["string"]
    a, b = out.collect()
    assert (a.flag, b.flag) == (True, False)
    assert (a.date1, b.date1) == (dt.datetime(2022, 12, 31), dt.datetime(2023, 1, 2))      # month first, whole column
    assert (a.date2, b.date2) == (dt.datetime(1969, 11, 7), dt.datetime(2068, 11, 8))
    assert (a.date3, b.date3) == (dt.datetime(2022, 11, 7), dt.datetime(2022, 12, 8))
    assert (a.date4, b.date4) == (dt.datetime(2022, 11, 7, 13, 5), dt.datetime(2022, 11, 8))


def test_a_value_that_is_no_date_stops_the_chart_loader(spark):
    import pytest
    df = spark.createDataFrame([("07-11-2022",), ("someday",)], "Date string")
    with pytest.raises(ValueError, match="someday"):
        clean.cascade_dates(df)


def test_one_date_format_for_a_column(spark):
    df = spark.createDataFrame([("03/04/2022",), ("04/25/2022",)], "d string")
    assert clean.column_date_formats(df, ["d"]) == {"d": "M/d/yyyy"}
    assert [r.d for r in clean.parse_dates_like(df, "d").collect()] == [dt.datetime(2022, 3, 4), dt.datetime(2022, 4, 25)]
    mixed = spark.createDataFrame([("25/04/2022",), ("04/25/2022",)], "d string")
    assert clean.column_date_formats(mixed, ["d"]) == {}


def test_row_total_multiplies_first(spark):
    df = spark.createDataFrame([(3.495, 100.0), (0.004, 1000.0)], "Price double, Quantity double")
    assert [r["total"] for r in clean.row_total(df).collect()] == [349.5, 4.0]


def test_awkward_column_names(spark):
    from cuadro.operators import profile
    df = spark.createDataFrame([("1", 2.0), ("x", 3.0)], "`it's a col` string, `price ($)` double")
    assert [tuple(r) for r in clean.numeric_profile(df).collect()] == [("it's a col", 2, 1)]
    r = profile.numeric_summary(df).first()
    assert (r["column"], r["min"], r["max"], r["mean"], r["total"]) == ("price ($)", 2.0, 3.0, 2.5, 5.0)


def test_formats_are_chosen_by_layout(spark):
    import datetime as dt
    import re
    formats = list(dict.fromkeys(clean.DAYFIRST_FORMATS + clean.MONTHFIRST_FORMATS + clean.INFERRED_FORMATS))
    times = [dt.datetime(2024, 3, 7, 4, 5, 6), dt.datetime(1999, 11, 28, 23, 59, 58, 120000)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    for fmt in formats:
        written = fmt.replace("[.SSSSSS]", ".SSSSSS")
        texts = df.select(F.date_format("t", written).alias("s"))
        layouts = clean.found_layouts(texts, {"s": F.col("s")}, formats)["s"]
        assert "" not in layouts and fmt in clean.formats_that_fit(formats, layouts), fmt
        assert all(re.search(clean.format_shape(fmt), r["s"]) for r in texts.collect()), fmt
        assert set(clean.formats_that_fit(formats, layouts)) <= set(clean.formats_that_occur(formats, layouts))


def test_only_formats_of_the_layout_are_parsed(spark, monkeypatch):
    tried = []
    parse = clean.parse_timestamp
    monkeypatch.setattr(clean, "parse_timestamp", lambda c, fmt: tried.append(fmt) or parse(c, fmt))
    df = spark.createDataFrame([("2024-03-07",), ("2024-12-31",)], "o_date string")
    assert clean.profile_table(df).date_format == {"o_date": "yyyy-M-d"} and tried == ["yyyy-M-d"]
    tried.clear()
    free = spark.createDataFrame([("a long note about nothing",), ("2024-12-31",)], "update_note string")
    assert clean.profile_table(free).date_format == {} and tried == []


def test_offsets_become_utc(spark):
    import datetime as dt
    df = spark.createDataFrame([("2022-11-07T10:00:00+02:00", "2022-11-07 10:00:00-0530"), ("2022-01-01T00:30:00.250Z", "2022-01-01 00:30:00Z")],
                               "a_date string, b_date string")
    rows = clean.clean_table(df).collect()
    assert [r["a_date"] for r in rows] == [dt.datetime(2022, 11, 7, 8), dt.datetime(2022, 1, 1, 0, 30, 0, 250000)]
    assert [r["b_date"] for r in rows] == [dt.datetime(2022, 11, 7, 15, 30), dt.datetime(2022, 1, 1, 0, 30)]
    assert dict(clean.clean_table(df).dtypes)["a_date"] == "timestamp_ntz"


def test_cascade_over_layouts(spark):
    mixed = spark.createDataFrame([("07-03-2024",), ("2024/03/08",), (None,)], "Date string")
    assert [str(r[0]) for r in clean.cascade_dates(mixed).collect()] == ["2024-03-07 00:00:00", "2024-03-08 00:00:00", "None"]
    with pytest.raises(ValueError, match="soon"):
        clean.cascade_dates(spark.createDataFrame([("07-03-2024",), ("soon",)], "Date string"))
    assert clean.cascade_dates(spark.createDataFrame([(None,)], "Date string")).dtypes == [("Date", "timestamp_ntz")]
