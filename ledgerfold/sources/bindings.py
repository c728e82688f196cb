"""Present the driver's test tables as the reference's inputs.

``actions``: one row per "modification" = a lineitem; piid = order key. Only
the dimension tables whose columns are asked for are joined, so a query that
needs just the supply code never touches orders/customer/supplier.

Scale notes: lineitem ⋈ orders is a big-big equi-join on the order key
(sort-merge/shuffle-hash chosen by Catalyst, AQE splits skewed keys). part,
supplier and customer grow with the data, so they are never force-broadcast
here; AQE converts a join to broadcast only when runtime stats prove a side
small. nation/region are the only fixed-size tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.sources.tables import table

# semantic column -> (required table, expression over that table's columns)
# (expressions are built lazily: Column objects need a live session)
_ACTION_COLUMNS: dict[str, tuple[str, object]] = {}


def _def(name: str, tab: str, expr) -> None:
    _ACTION_COLUMNS[name] = (tab, expr)


_def("piid", "lineitem", lambda: F.col("l_orderkey"))
_def("mod_number", "lineitem", lambda: F.col("l_linenumber").cast("string"))
_def("action_id", "lineitem", lambda: F.col("l_partkey"))
_def("current_completion_date", "lineitem", lambda: F.col("l_shipdate").cast("timestamp"))
_def("ultimate_completion_date", "lineitem", lambda: F.timestamp_add("DAY", F.col("l_quantity").cast("int"), F.col("l_shipdate")).cast("timestamp"))
_def("base_all_options", "lineitem", lambda: F.col("l_extendedprice"))
_def("base_exercised_options", "lineitem", lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
_def("obligated_amount", "lineitem", lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")))
_def("num_offers", "lineitem", lambda: F.when(F.col("l_linenumber") == 7, F.lit("None")).otherwise(F.col("l_quantity").cast("string")))
_def("reason_for_mod", "lineitem", lambda: F.when(F.col("l_returnflag") == "R", "TERMINATE FOR DEFAULT")
      .when(F.col("l_returnflag") == "A", "ADDITIONAL WORK"))
_def("effective_date", "orders", lambda: F.col("o_orderdate").cast("timestamp"))
_def("signed_date", "orders", lambda: F.col("o_orderdate").cast("timestamp"))
_def("contract_type", "orders", lambda: F.col("o_orderpriority"))
_def("extent_competed", "customer", lambda: F.col("c_mktsegment"))
_def("agency_id", "customer", lambda: F.col("c_nationkey").cast("string"))
_def("vendor_name", "supplier", lambda: F.col("s_name"))
_def("state_code", "supplier", lambda: F.col("s_nationkey").cast("string"))
def _size2():
    return F.lpad(F.col("p_size").cast("string"), 2, "0")
_def("psc", "part", lambda: F.when(F.col("p_type").startswith("PROMO"), "Y1AA")
      .when(F.col("p_type").startswith("SMALL"), "z2aa")
      .when(F.col("p_type").startswith("ECONOMY"), "R425")
      .when(F.col("p_type").startswith("MEDIUM"), _size2())
      .otherwise(F.concat(_size2(), F.lit("20"))))
_def("description", "part", lambda: F.col("p_name"))
_def("naics", "part", lambda: F.col("p_brand"))

ACTION_COLUMNS = tuple(_ACTION_COLUMNS)

_LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]


def actions(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The action view with only the requested semantic columns.

    ``piid``, ``mod_number`` and ``action_id`` (tie-break) are always present.
    """
    want = list(dict.fromkeys(["piid", "mod_number", "action_id"] + list(columns or ACTION_COLUMNS)))
    need = {_ACTION_COLUMNS[c][0] for c in want}
    li = table(spark, sf_dir, "lineitem")
    df = li
    if need & {"orders", "customer"}:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        df = df.join(o, df.l_orderkey == o.o_orderkey, "inner")
        if "customer" in need:
            c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
            df = df.join(c, df.o_custkey == c.c_custkey, "inner")
    if "part" in need:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_name", "p_brand")
        df = df.join(p, df.l_partkey == p.p_partkey, "inner")
    if "supplier" in need:
        s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        df = df.join(s, df.l_suppkey == s.s_suppkey, "inner")
    return df.select([_ACTION_COLUMNS[c][1]().alias(c) for c in want])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text corpus: description = document text; key doc_id."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"),
                                                    "lang", "source", "n_chars")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the two binary targets (quality, toxic)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "inner")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors (id, vector array<double>, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
                    "label")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program records: name = benchmark passage text, keyed by item id."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("program_id"), F.col("text").alias("program_name"))
