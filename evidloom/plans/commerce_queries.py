"""Registered queries on parts, orders, line items and events: catalog, carts, listings, parsing."""
from __future__ import annotations

from pyspark.sql import functions as F

from evidloom import fixed_values as fv
from evidloom.bounds import local_table
from evidloom.functions import scalars as sc
from evidloom.operators import commerce as cm
from evidloom.operators.lookup import catalog_image as add_image
from evidloom.plans.sql import lit
from evidloom.sources.tables import table

EXTRA_ITEMS = ["water bottle", "wood comb", "yoga mat", "red widget", "incense sticks"]
IMAGE_RULES = [("widgets", ["widget", "gizmo"]), ("parts", ["gear", "bolt", "rod"])]
FILE_TYPES = ["red_widget", "hot_gear"]


def distinct_names(spark, folder):
    return cm.distinct_names(table(spark, folder, "part").select(F.concat(F.lit(" "), "p_name").alias("n")), "n")


def catalog_union(spark, folder):
    names = cm.distinct_names(table(spark, folder, "part"), "p_name")
    return cm.catalog_union(names, local_table(spark, [(x,) for x in EXTRA_ITEMS], "name string"))


def catalog_image(spark, folder):
    """Images of all parts; a file exists for the slugs of the names that a supplier city would hold."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("name"))
    files = parts.where(sc.slug(F.col("name")).isin(*FILE_TYPES)).select(
        sc.slug(F.col("name")).alias("slug")).distinct().withColumn("path", F.concat(
            F.lit("/images/"), "slug", F.lit(".jpg")))
    return add_image(parts, files, IMAGE_RULES, fv.IMAGE_ELSE).select("p_partkey", "name", "slug", "image")


def slug(spark, folder):
    name = F.concat_ws("/ ", "p_name", "p_type")
    return table(spark, folder, "part").select("p_partkey", sc.slug(name).alias("slug"))


def _price():
    k = F.col("p_partkey")
    return F.when(k % 50 == 0, F.lit(None).cast("string")).when(k % 50 == 1, "free").otherwise(
        F.concat(F.lit("₹"), F.col("p_retailprice").cast("decimal(10,2)").cast("string")))


def price_parse(spark, folder):
    return table(spark, folder, "part").select("p_partkey", sc.price_parse(_price()).alias("price"))


def _cart(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("long").alias("qty"))


def cart_lines(spark, folder):
    return cm.cart_lines(_cart(spark, folder))


def cart_totals(spark, folder):
    products = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), _price().alias("price"))
    return cm.cart_totals(_cart(spark, folder), products)


def cart_adjust(spark, folder):
    steps = table(spark, folder, "events").select(
        "user_id", "event_type", "ts", "event_id",
        F.when(F.col("value") >= 40, 1).otherwise(-1).cast("long").alias("delta"))
    return cm.cart_adjust(steps, ["user_id", "event_type"], ["ts", "event_id"], F.date_trunc("day", "ts"))


def orders_listing(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return cm.listing(rows, "o_orderdate", ["o_orderkey"])


def logs_listing(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    return cm.listing(rows, "ts", ["event_id"])


def minor_units(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", sc.minor_units(F.floor("o_totalprice")).alias("minor"))


PROPS = "k int"


def json_salvage(spark, folder):
    text = F.when(F.col("event_id") % 10 == 0, "no braces here").when(
        F.col("event_id") % 10 == 1, "broken { k } end").otherwise(
        F.concat(F.lit("reply: "), "props", F.lit(" end")))
    default = F.struct(F.lit(-1).alias("k"))
    return table(spark, folder, "events").select("event_id", sc.json_salvage(text, PROPS, default)["k"].alias("k"))


def lenient_number(spark, folder):
    text = F.concat(F.lit("  "), F.regexp_replace("p_brand", "Brand#", ""), F.lit("."), F.col("p_size"), F.lit("abc"))
    bad = F.when(F.col("p_partkey") % 9 == 0, F.lit("n/a")).otherwise(text)
    return table(spark, folder, "part").select(
        "p_partkey", sc.lenient_int(bad).alias("as_int"), sc.lenient_float(bad).alias("as_float"))


def display_values(spark, folder):
    """Impact bar widths, percentages and image classes of all customers."""
    impact = (F.col("c_acctbal") - 4000) / 5000
    return table(spark, folder, "customer").select(
        "c_custkey", F.round(sc.bar_width(impact), 6).alias("width"), sc.pct(F.col("c_custkey") % 97 / 97.0)
        .alias("pct"),
        sc.keyword_class(F.col("c_mktsegment"), [("a", ["house", "mach"]), ("b", ["furn"])], "c").alias("image"),
        sc.join_or(F.when(F.col("c_custkey") % 2 == 0, F.split("c_name", "#")), "none").alias("listed"))


_PRICE = ("CASE p_partkey % 50 WHEN 0 THEN NULL WHEN 1 THEN 'free' ELSE '₹' || p_retailprice::DECIMAL(10,2)::VARCHAR "
          "END")
_UNIT = f"coalesce(TRY_CAST(regexp_replace({_PRICE}, '[^0-9]', '', 'g') AS BIGINT), 0)"
_SLUG = "lower(replace(replace(p_name, ' ', '_'), '/', ''))"
_NUMBER = ("CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE '  ' || replace(p_brand, 'Brand#', '') || '.' || p_size || 'abc' "
           "END")

QUERIES = {
    "distinct_names": distinct_names,
    "catalog_union": catalog_union,
    "catalog_image": catalog_image,
    "slug": slug,
    "price_parse": price_parse,
    "cart_lines": cart_lines,
    "cart_totals": cart_totals,
    "cart_adjust": cart_adjust,
    "orders_listing": orders_listing,
    "logs_listing": logs_listing,
    "minor_units": minor_units,
    "json_salvage": json_salvage,
    "lenient_number": lenient_number,
    "display_values": display_values,
}
ORACLE = {
    "distinct_names": "SELECT DISTINCT trim(p_name) AS name FROM part WHERE trim(p_name) <> '' ORDER BY name",
    "catalog_union": "SELECT DISTINCT trim(p_name) AS name, 0 AS part FROM part UNION ALL SELECT unnest(["
                     + ", ".join(lit(x) for x in EXTRA_ITEMS) + "]), 1",
    "catalog_image": (
        f"SELECT p_partkey, p_name AS name, {_SLUG} AS slug, CASE WHEN {_SLUG} IN ("
        + ", ".join(lit(x) for x in FILE_TYPES) + f") THEN '/images/' || {_SLUG} || '.jpg' "
        "WHEN contains(p_name, 'widget') OR contains(p_name, 'gizmo') THEN 'widgets' WHEN contains(p_name, 'gear') OR "
        "contains(p_name, 'bolt') OR contains(p_name, 'rod') THEN 'parts' ELSE 'other' END AS image FROM part"),
    "slug": "SELECT p_partkey, lower(replace(replace(p_name || '/ ' || p_type, ' ', '_'), '/', '')) AS slug FROM part",
    "price_parse": f"SELECT p_partkey, {_UNIT} AS price FROM part",
    "cart_lines": "SELECT l_orderkey AS cart_id, l_partkey AS product_id, sum(l_quantity)::BIGINT AS qty FROM lineitem "
                  "GROUP BY 1, 2",
    "cart_totals": f"WITH priced AS (SELECT p_partkey, {_UNIT} AS unit FROM part) SELECT l_orderkey AS cart_id, "
                   "sum(coalesce(unit, 0) * l_quantity::BIGINT)::BIGINT AS cart_total, sum(l_quantity)::BIGINT AS "
                   "cart_count FROM lineitem LEFT JOIN priced ON p_partkey = l_partkey GROUP BY 1",
    "cart_adjust": "SELECT * FROM (SELECT user_id, event_type, list_reduce(list_prepend(0::BIGINT, list(CASE WHEN value "
                   ">= 40 THEN 1 ELSE -1 END::BIGINT ORDER BY ts, event_id)), lambda q, d: greatest(0, q + d)) AS qty "
                   "FROM events GROUP BY 1, 2) WHERE qty > 0",
    "orders_listing": "SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS "
                      "o_orderdate FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey",
    "logs_listing": "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM events "
                    "ORDER BY events.ts DESC, event_id",
    "minor_units": "SELECT o_orderkey, floor(o_totalprice)::BIGINT * 100 AS minor FROM orders",
    "json_salvage": "SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN -1 ELSE "
                    "CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events",
    "lenient_number": (
        f"WITH t AS (SELECT p_partkey, {_NUMBER} AS s FROM part) SELECT p_partkey, "
        "coalesce(TRY_CAST(regexp_extract(s, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS as_int, "
        "coalesce(TRY_CAST(regexp_extract(s, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1) AS DOUBLE), 0.0) AS as_float FROM t"),
    "display_values": (
        "SELECT c_custkey, round(least(abs((c_acctbal - 4000) / 5000) * 90, 100), 6) AS width, "
        "round((c_custkey % 97 / 97.0::DOUBLE) * 100, 2) AS pct, CASE WHEN contains(lower(c_mktsegment), 'house') OR "
        "contains(lower(c_mktsegment), 'mach') THEN 'a' WHEN contains(lower(c_mktsegment), 'furn') THEN 'b' ELSE 'c' END "
        "AS image, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', ', ') ELSE 'none' END AS listed FROM customer"),
}
