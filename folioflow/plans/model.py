"""The star schema's tables in the roles of the domain, and the same as SQL for the oracle.

An official is a customer, a transaction a line item, its filing the order that it belongs to; price times
quantity, taken twelvefold for first lines, falls into the brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import brackets
from folioflow.session import in_pieces, spread

TODAY = "2001-12-31"
FLOOR = "1996-01-01"
AXIS_START = "1995-06-01"
LATE_DAYS = 60
#: Tables whose scans feed heavy work, and the keys that small ones are dealt out by.
LARGE = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """A table, or columns of its rows that are worked out before the rows are dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df, LARGE[name]) if name in LARGE else df


def officials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as officials; some aren't parsed yet and some are out of office."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    named = c.join(n, c.c_nationkey == n.n_nationkey)
    return named.select(
        F.col("c_custkey").alias("official_id"),
        F.col("c_name").alias("official"),
        F.col("c_mktsegment").alias("level"),
        F.col("n_name").alias("agency"),
        F.when(F.col("c_custkey") % 13 == 0, "metadata-only").otherwise("parsed").alias("data_status"),
        (F.col("c_custkey") % 17 == 0).alias("former"),
    )


def in_roster() -> Column:
    return (F.col("data_status") == "parsed") & ~F.coalesce("former", F.lit(False))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return officials(spark, sf_dir).filter(in_roster())


def all_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transactions(spark, sf_dir, _orders(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered"))


def _transactions(spark: SparkSession, sf_dir: str, orders: DataFrame, *more: str) -> DataFrame:
    """The transactions of some orders, with more of the orders' columns.

    Lines are shuffled by order and by part, so all that a join doesn't need for itself is worked out before it: the place of a
    bracket, days and a flag are shorter than a price, a quantity and times.
    """
    part = table(spark, sf_dir, "part")
    value = F.col("l_extendedprice") * F.col("l_quantity") * F.when(F.col("l_linenumber") == 1, 12).otherwise(1)
    kind = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 7, "Sale (Partial)").when(F.col("l_linenumber") == 5, "Sale (Full)").otherwise("Sale")).when(F.col("l_returnflag") == "A", "Purchase").otherwise("Exchange")
    open_ended = (F.col("l_linenumber") == 6) & (value >= 1_000_001)
    place = F.when(open_ended, F.lit(brackets.OPEN_PLACE).cast("byte")).otherwise(brackets.place_of(value))
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("date").alias("shipped"), place.alias("place"))
    line, orders = in_pieces(line, "l_orderkey", orders, "o_orderkey")
    filed = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("late", F.datediff("shipped", "ordered") > LATE_DAYS)
    return filed.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("official_id"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("ticker"),
        kind.alias("type"),
        F.col("shipped").alias("date"),
        brackets.bracket_at(F.col("place")).alias("amount"),
        "late",
        F.col("o_orderkey").alias("filing"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        *more,
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of the roster, with what is known of their officials.

    Orders meet the roster before the lines do: there are fewer of them, and lines aren't shuffled by official for it.
    """
    known = ("official", "level", "agency")
    of_roster = _orders(spark, sf_dir).join(roster(spark, sf_dir).select("official_id", *known), F.col("o_custkey") == F.col("official_id")).drop("official_id")
    return _transactions(spark, sf_dir, of_roster, *known)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings; one in seven has no link and one in eleven no label."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("official_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("ordinal"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("https://filings.example/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).alias("url"),
        F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("Report "), F.col("o_orderkey").cast("string"))).alias("label"),
        F.col("o_orderstatus").alias("status"),
    )


_VALUE = "l_extendedprice * l_quantity * CASE WHEN l_linenumber = 1 THEN 12 ELSE 1 END"
OFFICIALS_SQL = """officials AS (
  SELECT c_custkey AS official_id, c_name AS official, c_mktsegment AS level, n_name AS agency,
         CASE WHEN c_custkey % 13 = 0 THEN 'metadata-only' ELSE 'parsed' END AS data_status, c_custkey % 17 = 0 AS former
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
roster AS (SELECT * FROM officials WHERE data_status = 'parsed' AND NOT former)"""
TX_SQL = f"""{OFFICIALS_SQL},
all_tx AS (
  SELECT o_custkey AS official_id, p_name AS description, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS ticker,
         CASE l_returnflag WHEN 'R' THEN CASE l_linenumber WHEN 7 THEN 'Sale (Partial)' WHEN 5 THEN 'Sale (Full)' ELSE 'Sale' END
              WHEN 'A' THEN 'Purchase' ELSE 'Exchange' END AS type,
         CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_linenumber = 6 AND {_VALUE} >= 1000001 THEN 'Over $1,000,000' ELSE {brackets.sql_bracket_of(_VALUE)} END AS amount,
         date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > {LATE_DAYS} AS late,
         o_orderkey AS filing, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
tx AS (
  SELECT t.*, official, level, agency, {brackets.sql_case("amount", 2)} AS mid, {brackets.sql_case("amount", 2, export=True)} AS export_mid,
         type IN ('Sale', 'Sale (Partial)', 'Sale (Full)') AS is_sale, type = 'Purchase' AS is_buy
  FROM all_tx t JOIN roster USING (official_id))"""
FILINGS_SQL = """filings AS (
  SELECT o_custkey AS official_id, CAST(o_orderdate AS DATE) AS date, o_orderkey AS ordinal,
         CASE WHEN o_orderkey % 7 <> 0 THEN 'https://filings.example/' || o_orderkey || '.pdf' END AS url,
         CASE WHEN o_orderkey % 11 <> 0 THEN 'Report ' || o_orderkey END AS label, o_orderstatus AS status FROM orders)"""
