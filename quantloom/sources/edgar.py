"""Company-facts documents: facts -> taxonomy -> tag -> units -> unit -> rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.valuation import FACTS

ROW = "struct<end:string,val:double,fy:int,fp:string,form:string,filed:string,accn:string>"
SCHEMA = f"struct<entityName:string,facts:struct<`us-gaap`:map<string,struct<units:map<string,array<{ROW}>>>>>>"
#: The tags of each line item, the first that a company reports wins, and its unit.
REVENUE = ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet")
ITEMS: dict[str, tuple[tuple[str, ...], str]] = {
    "revenue": (REVENUE, "USD"),
    "net_income": (("NetIncomeLoss",), "USD"),
    "gross": (("GrossProfit",), "USD"),
    "eps": (("EarningsPerShareDiluted", "EarningsPerShareBasic"), "USD/shares"),
    "shares": (("WeightedAverageNumberOfDilutedSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic"), "shares"),
    "operating_cash": (("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"), "USD"),
    "capex": (("PaymentsToAcquirePropertyPlantAndEquipment",), "USD"),
    "assets": (("Assets",), "USD"),
    "current_assets": (("AssetsCurrent",), "USD"),
    "current_liabilities": (("LiabilitiesCurrent",), "USD"),
    "debt": (("LongTermDebtNoncurrent", "LongTermDebt"), "USD"),
    "cogs": (("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"), "USD"),
    "retained": (("RetainedEarningsAccumulatedDeficit",), "USD"),
    "equity": (("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), "USD"),
}


def line_items(documents: DataFrame, items: dict[str, tuple[tuple[str, ...], str]] = ITEMS) -> DataFrame:
    """(symbol, item, fy, value, period_end, form, accession) of ``documents(json)``, whose symbol is a column of theirs, else the name in the document.

    Fiscal-year 10-K rows in the item's unit, of the first tag that has any; the latest filing of
    a year wins. One exchange by symbol and item serves both windows.
    """
    known = [F.struct(F.lit(item).alias("item"), F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), F.lit(k).alias("rank")) for item, (tags, unit) in items.items() for k, tag in enumerate(tags)]
    wanted = F.create_map(*[x for k in known for x in (k.getField("tag"), k)])
    symbol = F.col("symbol") if "symbol" in documents.columns else F.col("d.entityName")
    parsed = documents.withColumn("d", F.from_json("json", SCHEMA)).select(symbol.alias("symbol"), F.explode("d.facts.us-gaap").alias("tag", "fact"))
    rows = (
        parsed.withColumn("w", wanted[F.col("tag")]).where("w IS NOT NULL")
        .select("symbol", "w.item", "w.rank", F.explode(F.try_element_at("fact.units", F.col("w.unit"))).alias("r"))
        .select("symbol", "item", "rank", "r.*").where("fp = 'FY' AND form LIKE '10-K%'")
    )
    first = Window.partitionBy("symbol", "item")
    latest = Window.partitionBy("symbol", "item", "fy").orderBy(F.desc("filed"), F.desc("accn"), F.desc("val"))
    return (
        rows.withColumn("least", F.min("rank").over(first)).where("rank = least").withColumn("k", F.row_number().over(latest)).where("k = 1")
        .select("symbol", "item", "fy", F.col("val").alias("value"), F.col("end").alias("period_end"), "form", F.col("accn").alias("accession"))
    )


def annual_facts(documents: DataFrame, tags: tuple[str, ...] = REVENUE, unit: str = "USD") -> DataFrame:
    """(symbol, fy, value) of one line item."""
    return line_items(documents, {"item": (tags, unit)}).select("symbol", "fy", "value")


def history(documents: DataFrame) -> DataFrame:
    """One row per symbol and fiscal year with a revenue; an item that is not reported is null.

    Free cash flow needs both of its parts; a gross profit that is not reported is revenue less cost.
    """
    wide = line_items(documents).groupBy("symbol", "fy").agg(
        *[F.max(F.when(F.col("item") == k, F.col("value"))).alias(k) for k in ITEMS],
        *[F.max(F.when(F.col("item") == "revenue", F.col(k))).alias(k) for k in ("period_end", "form", "accession")],
    )
    return wide.where("revenue IS NOT NULL").withColumns({"gross": F.expr("coalesce(gross, revenue - cogs)"), "free_cash": F.expr("operating_cash - capex")})


def snapshot(documents: DataFrame) -> DataFrame:
    """The latest fiscal year of each symbol: growth on the year reported before, margins, filing."""
    w = Window.partitionBy("symbol").orderBy("fy")
    return (
        history(documents).withColumns({"prior": F.lag("revenue").over(w), "back": F.row_number().over(w.orderBy(F.desc("fy")))}).where("back = 1")
        .selectExpr("symbol", "fy", "form", "accession", "revenue", "CASE WHEN prior <> 0 THEN (revenue - prior) / abs(prior) END AS growth",
            "CASE WHEN revenue <> 0 THEN gross / revenue END AS gross_margin", "CASE WHEN revenue <> 0 THEN net_income / revenue END AS net_margin", "eps")
    )


#: The fields of the file that lists companies.
TICKERS = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, cik, title) of the file of companies, an object of numbered entries; upper-cased, of equal symbols the first."""
    each = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TICKERS)).alias("nth", "c"))
    first = F.min_by(F.struct(F.col("c.cik_str").alias("cik"), F.col("c.title").alias("title")), F.col("nth").cast("long")).alias("c")
    return each.where("c.ticker IS NOT NULL AND c.cik_str IS NOT NULL").groupBy(F.upper(F.trim("c.ticker")).alias("symbol")).agg(first).select("symbol", "c.*")


def company_facts(spark: SparkSession, folder: str, companies: DataFrame) -> DataFrame:
    """(symbol, json) of a folder with a company-facts document a company, named by its number (CIK0000000001.json), for ``companies(symbol, cik)``.

    A company without a file has no row, a file that no company asks for is not parsed. Share classes of one company share its document.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^CIK0*(\d+)\.json$", 1).try_cast("long")
    files = spark.read.text(folder, wholetext=True).select(number.alias("cik"), F.col("value").alias("json")).where("cik IS NOT NULL")
    return files.join(companies.select("symbol", "cik"), "cik").select("symbol", "json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of the annual facts, each year with a restatement and a quarterly row to ignore."""
    row = lambda val, fp, form, filed: F.struct(F.lit("x").alias("end"), val.cast("double").alias("val"), F.col("fy"), F.lit(fp).alias("fp"), F.lit(form).alias("form"), F.concat("fy", F.lit(filed)).alias("filed"), F.concat(F.lit("a"), F.col("fy")).alias("accn"))
    rows = lambda v: F.flatten(F.collect_list(F.array(row(v * 2, "FY", "10-K", "-12-31"), row(v, "FY", "10-K/A", "-12-32"), row(v * 9, "Q1", "10-Q", "-12-33"))))
    made = {"Revenues": "revenue", "NetIncomeLoss": "income", "CostOfRevenue": "cogs", "NetCashProvidedByUsedInOperatingActivities": "cash_flow", "PaymentsToAcquirePropertyPlantAndEquipment": "debt",
        "Assets": "assets", "Other": "revenue", "WeightedAverageNumberOfDilutedSharesOutstanding": "shares"}
    units = {"WeightedAverageNumberOfDilutedSharesOutstanding": "shares"}
    facts = FACTS.frame(spark, sf_dir).groupBy("symbol").agg(*[rows(F.col(c)).alias(tag) for tag, c in made.items()])
    tags = F.create_map(*[x for tag in made for x in (F.lit(tag), F.struct(F.create_map(F.lit(units.get(tag, "USD")), F.col(tag)).alias("units")))])
    tree = F.struct(F.col("symbol").alias("entityName"), F.struct(tags.alias("us-gaap")).alias("facts"))
    return facts.select(F.to_json(tree).alias("json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    exact = lambda *names: [F.round(n, 5).alias(n) for n in names]  # noqa: E731  # beyond the last digit that a sum can have: no ties
    return {
        "edgar_annual_facts": lambda spark, sf_dir: annual_facts(documents(spark, sf_dir)).select("symbol", "fy", *exact("value")),
        "edgar_history": lambda spark, sf_dir: history(documents(spark, sf_dir)).select("symbol", "fy", "accession", *exact("revenue", "net_income", "gross", "free_cash", "assets", "equity", "shares")),
        "edgar_snapshot": lambda spark, sf_dir: snapshot(documents(spark, sf_dir)).select("symbol", "fy", "form", *[F.round(n, 6).alias(n) for n in ("growth", "gross_margin", "net_margin")]),
    }


def oracle_sql() -> dict[str, str]:
    before = "lag(revenue) OVER (PARTITION BY symbol ORDER BY fy)"
    return {
        "edgar_annual_facts": f"SELECT symbol, fy, round(revenue, 5) AS value FROM {FACTS.sql}",
        "edgar_history": f"""SELECT symbol, fy, 'a' || fy AS accession, round(revenue, 5) AS revenue, round(income, 5) AS net_income, round(revenue - cogs, 5) AS gross,
            round(cash_flow - debt, 5) AS free_cash, round(assets, 5) AS assets, CAST(NULL AS DOUBLE) AS equity, CAST(shares AS DOUBLE) AS shares FROM {FACTS.sql}""",
        "edgar_snapshot": f"""SELECT symbol, fy, '10-K/A' AS form, round((revenue - prior) / abs(prior), 6) AS growth, round((revenue - cogs) / revenue, 6) AS gross_margin, round(income / revenue, 6) AS net_margin
            FROM (SELECT *, {before} AS prior, row_number() OVER (PARTITION BY symbol ORDER BY fy DESC) AS back FROM {FACTS.sql}) WHERE back = 1""",
    }
