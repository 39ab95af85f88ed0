"""The report queries over the sales schema: revenue, ranking, geography, customers, products.

Revenue is the fixed-point net price. Where a measure is summed over a join, the fact table
is first summed per join key: the sum combines before its shuffle, the join reuses that
partitioning, and a key that holds very many rows enters the join as one row. Join
strategies are left to the optimizer and to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillon.functions.scalars import divide, money
from quillon.operators.measures import Measure, kpi, measures
from quillon.operators.percentiles import quantile_table
from quillon.operators.visuals import pivot_visual, visual
from quillon.session import load

# The return flags of the line items, and the steps of cohorts and spend.
RETURN_FLAGS = ("A", "N", "R")
COHORT_MONTHS = 12
CLV_BUCKETS = 10


def revenue() -> Column:
    return money(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def number(col: Column) -> Column:
    """A fixed-point sum as a plain number for reports."""
    return col.cast("double")


def revenue_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(revenue()).alias("revenue"), F.sum(money(F.col("l_quantity"))).alias("units"))


def orders_with_revenue(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Orders that have line items, with their revenue and units."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", *columns)
    return orders.join(revenue_per_order(spark, sf_dir), "o_orderkey")


def month_of(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def monthly_revenue_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", revenue().alias("revenue"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", month_of("o_orderdate").alias("month"))
    return (line.join(part, line.l_partkey == part.p_partkey)
            .join(orders, F.col("l_orderkey") == orders.o_orderkey)
            .groupBy("month", "p_type").agg(number(F.sum("revenue")).alias("revenue")))


def star_join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_part = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(revenue()).alias("revenue"), F.count("*").alias("line_count"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (per_part.join(part, per_part.l_partkey == part.p_partkey, "left").groupBy("p_brand")
            .agg(number(F.sum("revenue")).alias("revenue"), F.sum("line_count").alias("line_count")))


def visual_line_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_with_revenue(spark, sf_dir, "o_orderdate")
    return visual(df, "line", ["o_orderdate"], [
        Measure(F.col("revenue"), "SUM", "revenue"), Measure("o_orderkey", "COUNT", "order_count")],
    ).withColumn("revenue", number(F.col("revenue")))


def per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and units per part, with the part's type and brand."""
    per_part = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(revenue()).alias("revenue"), F.sum(money(F.col("l_quantity"))).alias("units"))
    return per_part.join(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey")


def sales_measures() -> list[Measure]:
    return [Measure(F.col("revenue"), "SUM", "revenue"), Measure(F.col("units"), "SUM", "units")]


def visual_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = visual(per_type(spark, sf_dir), "column", ["p_type"], sales_measures())
    return df.select("p_type", number(F.col("revenue")).alias("revenue"), number(F.col("units")).alias("units"))


def visual_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = visual(per_type(spark, sf_dir), "pie", ["p_type"], sales_measures())
    return df.select("p_type", number(F.col("revenue")).alias("revenue"), F.round("share", 6).alias("share"))


def _by_nation(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """Order revenue with the customer's nation and region, summed per customer first."""
    df = orders_with_revenue(spark, sf_dir, "o_custkey", "o_orderdate")
    per_customer = df.groupBy("o_custkey", *extra).agg(F.sum("revenue").alias("revenue"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return (per_customer.join(customer, per_customer.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .join(region, F.col("n_regionkey") == region.r_regionkey))


def visual_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_nation(spark, sf_dir).groupBy("r_name", "n_name").agg(
        number(F.sum("revenue")).alias("revenue"), F.count("*").alias("customer_count"))


def quarterly_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).cast("date").alias("quarter")
    return _by_nation(spark, sf_dir, quarter).groupBy("quarter", "r_name").agg(
        number(F.sum("revenue")).alias("revenue"))


def visual_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    # orders first: a customer's revenue is one row before the distinct count
    per_customer = orders_with_revenue(spark, sf_dir, "o_custkey").groupBy("o_custkey").agg(
        F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.count("*").alias("orders"))
    total = visual(per_customer, "card", [], [
        Measure(F.col("revenue"), "SUM", "revenue"), Measure(F.col("units"), "SUM", "units"),
        Measure(F.col("orders"), "SUM", "order_count"), Measure("o_custkey", "COUNT", "customer_count")])
    return total.select(
        number(F.col("revenue")).alias("revenue"), number(F.col("units")).alias("units"), "order_count",
        "customer_count",
        F.round(divide(number(F.col("revenue")), F.col("order_count").cast("double")), 4).alias("average_order_value"))


def visual_matrix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = visual(per_type(spark, sf_dir), "matrix", ["p_type", "p_brand"], sales_measures())
    return df.select("p_type", "p_brand", F.col("level").cast("bigint").alias("level"),
                     number(F.col("revenue")).alias("revenue"), number(F.col("units")).alias("units"))


def visual_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(revenue()).alias("revenue"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = per.join(part, per.l_partkey == part.p_partkey)
    wide = pivot_visual(joined, ["p_type"], "l_returnflag", RETURN_FLAGS, Measure(F.col("revenue"), "SUM"))
    return wide.select("p_type", *[number(F.col(f)).alias(f"revenue_{f.lower()}") for f in RETURN_FLAGS])


def top5_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_part = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(revenue()).alias("revenue"))
    best = per_part.orderBy(F.desc("revenue"), "l_partkey").limit(5)
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return best.join(part, best.l_partkey == part.p_partkey).select(
        "p_partkey", "p_name", "p_type", number(F.col("revenue")).alias("revenue"))


def top10_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_customer = orders_with_revenue(spark, sf_dir, "o_custkey").groupBy("o_custkey").agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("order_count"))
    best = per_customer.orderBy(F.desc("revenue"), "o_custkey").limit(10)
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return best.join(customer, best.o_custkey == customer.c_custkey).select(
        "c_custkey", "c_name", "c_mktsegment", number(F.col("revenue")).alias("revenue"), "order_count")


def product_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sale, months with a sale, and revenue per part."""
    day = F.col("l_shipdate").cast("date")
    monthly = load(spark, sf_dir, "lineitem").groupBy("l_partkey", F.trunc(day, "month").alias("month")).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.sum(revenue()).alias("revenue"))
    return monthly.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min("first_day").alias("first_sale"), F.max("last_day").alias("last_sale"),
        F.count("*").alias("active_months"), number(F.sum("revenue")).alias("revenue"))


def price_vs_net_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average list price and average net price per unit, per part."""
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.round(F.avg(unit), 4).alias("average_price"),
        F.round(F.avg(unit * (1 - F.col("l_discount"))), 4).alias("average_net"), F.count("*").alias("line_count"))


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last order day, orders and spend per customer that ever ordered."""
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max(F.col("o_orderdate").cast("date")).alias("last_day"), F.count("*").alias("frequency"),
        F.sum(money(F.col("o_totalprice"))).alias("spend"))


def _quartile(value: str, cuts: Column, descending: bool = False) -> Column:
    above = sum(((F.col(value) > cuts[f"q{i}"]).cast("bigint") for i in (1, 2, 3)), F.lit(1).cast("bigint"))
    return 5 - above if descending else above


def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by quartile of recency, frequency and spend; 4 is best.

    Cuts are exact quartiles, so equal customers always share a segment and no global
    sort numbers the customers.
    """
    last = load(spark, sf_dir, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("d")).scalar()
    facts = customer_facts(spark, sf_dir).select(
        F.datediff(last, "last_day").alias("recency"), "frequency", F.col("spend").cast("double").alias("spend"))
    names = ("recency", "frequency", "spend")
    cuts = quantile_table(facts, list(names), {"q1": 0.25, "q2": 0.5, "q3": 0.75}).agg(F.struct(*[
        F.max(F.when(F.col("column") == n, F.struct("q1", "q2", "q3"))).alias(n) for n in names]).alias("cuts"))
    facts = facts.withColumn("cuts", cuts.scalar())
    scored = facts.select(
        _quartile("recency", F.col("cuts.recency"), True).alias("r"),
        _quartile("frequency", F.col("cuts.frequency")).alias("f"),
        _quartile("spend", F.col("cuts.spend")).alias("m"), "spend")
    label = (F.when((F.col("r") >= 3) & (F.col("f") >= 3) & (F.col("m") >= 3), "best")
             .when(F.col("f") >= 3, "loyal").when(F.col("r") >= 3, "recent").otherwise("at risk"))
    return scored.groupBy("r", "f", "m", label.alias("segment")).agg(
        F.count("*").alias("customer_count"), number(F.sum(money(F.col("spend")))).alias("spend"))


def customer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and month with an order, with the customer's first such month."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
    active = load(spark, sf_dir, "orders").groupBy("o_custkey", month).agg(F.count("*").alias("order_count"))
    # a customer has one row per month here, however many orders
    return active.withColumn("first_month", F.min("month").over(Window.partitionBy("o_custkey")))


def acquisition_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.col("month") == F.col("first_month")
    return customer_months(spark, sf_dir).groupBy("month").agg(
        F.count_if(fresh).alias("new_customers"), F.count_if(~fresh).alias("returning_customers"),
        F.sum("order_count").alias("order_count"))


def cohort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers active per month since their first order, in the first twelve months."""
    age = ((F.year("month") - F.year("first_month")) * 12 + F.month("month") - F.month("first_month"))
    rows = customer_months(spark, sf_dir).select(F.date_format("first_month", "yyyy-MM").alias("cohort"),
                                                 age.alias("age"))
    return rows.groupBy("cohort").agg(
        *[F.count_if(F.col("age") == i).alias(f"m{i}") for i in range(COHORT_MONTHS)],
        F.count_if(F.col("age") >= COHORT_MONTHS).alias("later"))


def clv_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and spend in ten equal steps between the smallest and the largest spend."""
    facts = customer_facts(spark, sf_dir).select(F.col("spend").cast("double").alias("spend"))
    span = facts.agg(F.struct(F.min("spend").alias("lo"), F.max("spend").alias("hi")).alias("span")).scalar()
    placed = facts.withColumn("span", span)
    lo, hi = F.col("span.lo"), F.col("span.hi")
    step = F.floor(F.try_divide(F.col("spend") - lo, hi - lo) * CLV_BUCKETS) + 1
    bucket = F.least(F.coalesce(step, F.lit(1)), F.lit(CLV_BUCKETS)).cast("bigint")
    return placed.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("customer_count"), number(F.sum(money(F.col("spend")))).alias("spend"),
        F.min("spend").alias("smallest"), F.max("spend").alias("largest"))


def sales_by_type_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", revenue().alias("revenue"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    # few types per order: the order join sees at most one row per order and type
    per_order = (line.join(part, line.l_partkey == part.p_partkey)
                 .groupBy("l_orderkey", "p_type").agg(F.sum("revenue").alias("revenue")))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_customer = (per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
                    .groupBy("o_custkey", "p_type").agg(F.sum("revenue").alias("revenue")))
    return (per_customer.join(customer, per_customer.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .groupBy("p_type", "n_name").agg(number(F.sum("revenue")).alias("revenue")))


def kpi_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly order value per market segment against the year before plus five percent."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum(money(F.col("o_totalprice"))).alias("value"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("measure"))
    yearly = measures(orders.join(customer, orders.o_custkey == customer.c_custkey),
                      [Measure(F.col("value"), "SUM", "actual")], ["measure", "year"])
    yearly = yearly.withColumn("actual", number(F.col("actual")))
    targets = yearly.select("measure", (F.col("year") + 1).alias("year"), (F.col("actual") * 1.05).alias("target"))
    return kpi(yearly, targets, ("measure", "year")).select(
        "measure", F.col("year").cast("bigint").alias("year"), "actual", F.round("target", 4).alias("target"),
        F.round("variance", 4).alias("variance"), F.round("variance_pct", 6).alias("variance_pct"), "status")
