"""Column roles decided from the schema (and question) only."""

import pytest
from pyspark.sql import types as T

from cuadro.functions import roles
from cuadro.session import read_table
from tests.conftest import SF_SMALL

NO_HINT = "Haz un gráfico"


@pytest.mark.parametrize("table,bar,line,pie,scatter", [
    ("customer", ("c_name", "sum", "c_custkey"), (None, "c_custkey"), "c_name", ("c_custkey", "c_nationkey")),
    ("part", ("p_name", "sum", "p_partkey"), (None, "p_partkey"), "p_type", ("p_retailprice", "p_size")),
    ("orders", ("o_orderstatus", "sum", "o_totalprice"), ("o_orderdate", "o_totalprice"), "o_orderstatus",
     ("o_totalprice", "o_totalprice")),
    ("lineitem", ("l_returnflag", "sum", "l_quantity"), ("l_shipdate", "l_extendedprice"), "l_returnflag",
     ("l_extendedprice", "l_quantity")),
    ("events", ("event_type", "count", "event_id"), (None, "event_id"), "event_type", ("event_id", "user_id")),
])
def test_roles_on_driver_tables(spark, table, bar, line, pie, scatter):
    schema = read_table(spark, SF_SMALL, table).schema
    b = roles.resolve_bar(schema, NO_HINT)
    assert (b.target, b.mode, b.value) == bar
    ln = roles.resolve_line(schema)
    assert (ln.date, ln.value) == line
    assert roles.resolve_pie(schema, NO_HINT) == pie
    s = roles.resolve_scatter(schema)
    assert (s.x, s.y) == scatter
    if s.x == s.y:
        assert s.warning


def _schema(spec):
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "b": T.BooleanType(),
             "t": T.TimestampNTZType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in spec])


def test_sample_sales_roles():
    schema = _schema([("Order ID", "l"), ("Date", "t"), ("Product", "s"), ("Price", "d"), ("Quantity", "d"),
                      ("Purchase Type", "s"), ("Payment Method", "s"), ("Manager", "s"), ("City", "s")])
    b = roles.resolve_bar(schema, "Muestra un gráfico de ventas por ciudad")
    # 'ciudad' does not name the column 'City': the first text column is charted
    assert b.target == "Product" and b.value == "Quantity" and b.mode == "sum"
    assert roles.resolve_bar(schema, "ventas por city").target == "City"
    assert roles.resolve_pie(schema, "gráfico circular") == "Purchase Type"
    s = roles.resolve_scatter(schema)
    assert (s.x, s.y) == ("Price", "Quantity")
    ln = roles.resolve_line(schema)
    assert (ln.date, ln.value) == ("Date", "Price")


def test_name_hazards_are_kept():
    schema = _schema([("region", "s"), ("country", "d"), ("discount", "d"), ("total_price", "d")])
    b = roles.resolve_bar(schema, "x")
    assert b.value == "country"            # 'count' inside 'country'
    sc = roles.resolve_scatter(schema)
    assert sc.x == "total_price" and sc.y == "total_price" and sc.warning
    schema2 = _schema([("Sussex", "s"), ("sentiment", "s"), ("n", "d")])
    assert roles.resolve_bar(schema2, "x").target == "Sussex"   # 'sex' inside 'Sussex'
    assert roles.line_date_candidates(schema2) == ["sentiment"]  # 'time' inside 'sentiment'


def test_missing_roles_raise():
    with pytest.raises(roles.RoleError):
        roles.resolve_bar(_schema([("a", "d"), ("flag", "b")]), "x")
    with pytest.raises(roles.RoleError):
        roles.resolve_scatter(_schema([("a", "d"), ("b", "s")]))
    with pytest.raises(roles.RoleError):
        roles.resolve_line(_schema([("a", "s")]))
    # booleans are neither categorical nor numeric
    assert roles.numeric_columns(_schema([("flag", "b"), ("x", "d")])) == ["x"]


def test_optional_synonyms():
    schema = _schema([("Product", "s"), ("City", "s"), ("Quantity", "d")])
    q = "Muestra un gráfico de ventas por ciudad"
    assert roles.resolve_bar(schema, q).target == "Product"                       # literal names
    assert roles.resolve_bar(schema, q, {"ciudad": "City"}).target == "City"      # opt-in map
    assert roles.resolve_pie(schema, "gráfico circular por ciudad", {"ciudad": "City"}) == "City"


def test_optional_whole_word_hints():
    schema = _schema([("region", "s"), ("country", "d"), ("unit_count", "d")])
    assert roles.resolve_bar(schema, "x").value == "country"                       # substring rule
    assert roles.resolve_bar(schema, "x", whole_words=True).value == "unit_count"  # word rule
    assert roles.has_hint("Sussex", ["sex"]) and not roles.has_hint("Sussex", ["sex"], whole_words=True)
