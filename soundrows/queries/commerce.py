"""Profiles of the given commerce tables, as plain data."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundrows.fixed_values import WARNING
from soundrows.plans.profile import Registry, profile_from


def charged_above_list_price(cells):
    price, discount = cells.number("l_extendedprice"), cells.number("l_discount")
    charged = price * (F.lit(1.0) - discount) + price * cells.number("l_tax")
    return charged > price + 0.01


def _key(column):
    return [
        ("unique", "unique.id", f"{column} must be unique", dict(columns=column)),
        ("integer", "int.id", f"{column} must be an integer", dict(column=column)),
    ]


def _link(name, column, parent, parent_column):
    return ("foreign_key", f"fk.{name}", f"{column} links to {parent}",
            dict(column=column, parent_table=parent, parent_column=parent_column))


TABLES = {
    "region": dict(
        title="Region", id_column="r_regionkey", detect=["r_regionkey", "r_name"],
        required=["r_regionkey", "r_name"],
        rules=[
            *_key("r_regionkey"),
            ("allowed_values", "enum.name", "r_name is a continent",
             dict(column="r_name", allowed=["AFRICA", "AMERICA", "ASIA", "EUROPE"],
                  severity=WARNING)),
        ],
    ),
    "nation": dict(
        title="Nation", id_column="n_nationkey",
        detect=["n_nationkey", "n_name", "n_regionkey"], parents=["region"],
        required=["n_nationkey", "n_name", "n_regionkey"],
        rules=[*_key("n_nationkey"), _link("region", "n_regionkey", "region", "r_regionkey")],
    ),
    "customer": dict(
        title="Customer", id_column="c_custkey",
        detect=["c_custkey", "c_name", "c_nationkey"], parents=["nation"],
        required=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        rules=[
            *_key("c_custkey"),
            ("number", "num.balance", "c_acctbal is between 0 and 9000",
             dict(column="c_acctbal", min_value=0, max_value=9000)),
            ("allowed_values", "enum.segment", "c_mktsegment is served",
             dict(column="c_mktsegment", severity=WARNING, case_sensitive=False,
                  allowed=["Building", "Automobile", "Household", "Furniture"])),
            ("regex", "regex.name", "c_name is a customer number",
             dict(column="c_name", pattern=r"^Customer#[0-9]{8}[0-4]$")),
            _link("nation", "c_nationkey", "nation", "n_nationkey"),
        ],
    ),
    "supplier": dict(
        title="Supplier", id_column="s_suppkey",
        detect=["s_suppkey", "s_name", "s_nationkey"], parents=["nation"],
        required=["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
        rules=[
            *_key("s_suppkey"),
            ("number", "num.balance", "s_acctbal must be >= 0",
             dict(column="s_acctbal", min_value=0)),
            _link("nation", "s_nationkey", "nation", "n_nationkey"),
        ],
    ),
    "part": dict(
        title="Part", id_column="p_partkey", detect=["p_partkey", "p_name", "p_brand"],
        required=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        rules=[
            *_key("p_partkey"),
            ("regex", "regex.brand", "p_brand is a one-digit brand",
             dict(column="p_brand", pattern=r"^Brand#[0-9]$", severity=WARNING)),
            ("integer", "int.price", "p_retailprice is whole",
             dict(column="p_retailprice", severity=WARNING)),
            ("number", "num.size", "p_size is at most 48",
             dict(column="p_size", max_value=48)),
        ],
    ),
    "orders": dict(
        title="Orders", id_column="o_orderkey",
        detect=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"],
        parents=["customer"],
        required=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                  "o_orderpriority"],
        rules=[
            *_key("o_orderkey"),
            ("allowed_values", "enum.status", "o_orderstatus is open or finished",
             dict(column="o_orderstatus", allowed=["O", "F"])),
            ("boolean", "bool.status", "o_orderstatus reads as a truth word",
             dict(column="o_orderstatus", severity=WARNING)),
            ("number", "num.total", "o_totalprice must be >= 1000",
             dict(column="o_totalprice", min_value=1000)),
            ("date", "date.order", "o_orderdate is a plausible date",
             dict(column="o_orderdate", min_date="1995-06-01")),
            _link("customer", "o_custkey", "customer", "c_custkey"),
            ("not_null", "not_null.clerk", "o_clerk is required", dict(column="o_clerk")),
        ],
    ),
    "lineitem": dict(
        title="Line items", id_column="l_orderkey",
        detect=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        parents=["orders", "part", "supplier"],
        required=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_shipdate"],
        rules=[
            ("unique", "unique.id", "order line must be unique",
             dict(columns=["l_orderkey", "l_linenumber"])),
            ("integer", "int.quantity", "l_quantity is whole", dict(column="l_quantity")),
            ("number", "num.quantity", "l_quantity is at most 45",
             dict(column="l_quantity", max_value=45, severity=WARNING)),
            ("date", "date.ship", "l_shipdate is a plausible date",
             dict(column="l_shipdate", severity=WARNING)),
            ("allowed_values", "enum.flag", "l_returnflag is known",
             dict(column="l_returnflag", allowed=["A", "N"], severity=WARNING)),
            ("consistency", "consistency.charge", "charge must not exceed the list price",
             dict(violation=charged_above_list_price, severity=WARNING,
                  columns=["l_extendedprice", "l_discount", "l_tax"])),
            _link("order", "l_orderkey", "orders", "o_orderkey"),
            _link("part", "l_partkey", "part", "p_partkey"),
            _link("supplier", "l_suppkey", "supplier", "s_suppkey"),
        ],
    ),
}


def commerce_registry() -> Registry:
    return Registry(profile_from(key, spec) for key, spec in TABLES.items())
