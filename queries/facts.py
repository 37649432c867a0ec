"""Queries over reported facts: summary, growth, quality and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions.text import split_sentences
from ledgerspark.operators import annual, growth, quality, reshape
from ledgerspark.plans.annual_report import build_annual_summary
from ledgerspark.sources import company_facts, filings as filing_source
from queries import views as V

METRICS = list(C.SUMMARY_METRICS)
CONCEPTS = list(C.CONCEPT_COLUMNS.values())
UNITS = ["USD", "EUR", "shares"]


def _annual(spark: SparkSession, sf: str) -> DataFrame:
    return annual.annual_facts(V.facts(spark, sf), V.ANNUAL_FORM, V.ANNUAL_PERIOD)


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return build_annual_summary(V.facts(spark, sf), V.ANNUAL_FORM, V.ANNUAL_PERIOD)


def _text_end(df: DataFrame) -> DataFrame:
    return df.withColumn("end", F.col("end").cast("string"))


def annual_summary(spark, sf):
    return _text_end(summary(spark, sf))


def annual_summary_joins(spark, sf):
    return _text_end(annual.annual_summary_by_joins(_annual(spark, sf)))


def facts_latest_filing(spark, sf):
    latest = annual.latest_facts(_annual(spark, sf))
    return latest.select(
        "entity",
        "concept",
        *[F.col(c).cast("string").alias(c) for c in ("end", "start", "filed")],
        "accn",
        "val",
    )


def annual_metric(spark, sf):
    concept = C.CONCEPT_COLUMNS["revenue_billions"]
    return _text_end(annual.scaled_metric(_annual(spark, sf), concept, "revenue_billions"))


def _company_documents(spark, sf) -> DataFrame:
    """(entity, json): one nested document per company, with its concepts, units and records.

    Every tenth document breaks off, and one concept of every seventh isn't an object.
    """
    record = F.struct(
        F.col("start").cast("string").alias("start"),
        F.col("end").cast("string").alias("end"),
        "val",
        "accn",
        "fp",
        "form",
        F.col("filed").cast("string").alias("filed"),
    )
    unit = F.get(F.array(*map(F.lit, UNITS)), (F.col("accn").cast("bigint") % len(UNITS)).cast("int"))
    records = V.facts(spark, sf).groupBy("entity", "concept", unit.alias("unit")).agg(F.collect_list(record).alias("records"))
    units = F.map_from_entries(F.collect_list(F.struct("unit", "records")))
    bodies = records.groupBy("entity", "concept").agg(F.to_json(F.struct(units.alias("units"))).alias("body"))
    broken_concept = (F.col("entity") % 7 == 2) & (F.col("concept") == CONCEPTS[1])
    body = F.when(broken_concept, F.lit("7")).otherwise(F.col("body"))
    member = F.concat(F.lit('"'), "concept", F.lit('":'), body)
    documents = bodies.groupBy("entity").agg(F.array_join(F.collect_list(member), ",").alias("members"))
    whole = F.concat(F.lit('{"cik":"'), F.col("entity").cast("string"), F.lit('","facts":{"us-gaap":{'), F.col("members"), F.lit("}}}"))
    broken = F.col("entity") % 10 == 3
    return documents.select("entity", F.when(broken, F.expr("left(members, 50)")).otherwise(whole).alias("json"))


def _parsed_documents(spark, sf) -> DataFrame:
    return company_facts.parse_company_facts(_company_documents(spark, sf), document=F.col("entity"))


def facts_from_json(spark, sf):
    """Facts written as nested company documents, then read back through the document schema."""
    flat = company_facts.flatten_facts(_parsed_documents(spark, sf))
    per_concept = flat.groupBy("entity", "concept", "unit").agg(
        F.count("*").alias("facts"),
        F.max("val").alias("largest"),
        F.min("filed").cast("string").alias("first_filed"),
        F.max("accn").alias("last_accn"),
    )
    return per_concept.withColumn("entity", F.col("entity").cast("bigint"))


def facts_quarantine(spark, sf):
    """Documents and concepts that can't be read, none of which ends the job."""
    found = company_facts.quarantined_documents(_parsed_documents(spark, sf))
    return found.select(F.col("document").cast("bigint").alias("entity"), "concept", "reason")


def latest_n_periods(spark, sf):
    return _text_end(growth.latest_periods(summary(spark, sf), 3)).select("entity", "end", "fiscal_year", *METRICS)


def growth_yoy(spark, sf):
    grown = growth.add_growth(growth.latest_periods(summary(spark, sf)))
    return grown.select(
        "entity", "fiscal_year", "revenue_growth_pct", "cash_flow_growth_pct", "operating_margin_change_pp"
    )


def cagr(spark, sf):
    out = growth.revenue_cagr(growth.latest_periods(summary(spark, sf)))
    return out.withColumn("revenue_cagr_pct", F.round("revenue_cagr_pct", 6))


def takeaways(spark, sf):
    out = growth.takeaways(growth.latest_periods(summary(spark, sf)))
    return out.withColumn("revenue_cagr_pct", F.round("revenue_cagr_pct", 6))


def kpi_snapshot(spark, sf):
    out = growth.kpi_snapshot(growth.latest_periods(summary(spark, sf)))
    return _text_end(out)


def kpi_year(spark, sf):
    """The cards of one chosen year; growth still sees the year before."""
    out = growth.kpi_snapshot(growth.latest_periods(summary(spark, sf)), fiscal_year=2023)
    return _text_end(out)


def dq_missing_columns(spark, sf):
    """A summary that lacks two required columns is reported by name, before anything is counted."""
    return quality.quality_report(summary(spark, sf).drop("net_income_billions", "operating_margin_pct"))


def dq_report(spark, sf):
    return quality.quality_report(summary(spark, sf))


def dq_report_raw(spark, sf):
    """Unfiltered facts as a summary-shaped table with repeats, to make most checks fire."""
    wide = V.facts(spark, sf).select(
        "entity",
        "end",
        *[
            F.when(F.col("concept") == concept, F.col("val") / 1e9 - 20).alias(column)
            for column, concept in C.CONCEPT_COLUMNS.items()
        ],
    )
    return quality.quality_report(annual.add_margins(wide))


def overall_change(spark, sf):
    return growth.overall_change(growth.latest_periods(summary(spark, sf)), METRICS)


def best_worst_year(spark, sf):
    return growth.best_worst_year(summary(spark, sf), METRICS)


def interval_changes(spark, sf):
    out = growth.interval_changes(summary(spark, sf), METRICS)
    return out.withColumn("largest_change", F.round("largest_change", 4))


def series_long(spark, sf):
    return _text_end(reshape.series_long(summary(spark, sf)))


def years_descending(spark, sf):
    return reshape.years_descending(summary(spark, sf)).select("entity", F.array_join("years", ",").alias("years"))


def transpose_years(spark, sf):
    return reshape.transpose_years(summary(spark, sf), V.YEARS)


def display_table(spark, sf):
    return reshape.display_table(growth.add_growth(growth.latest_periods(summary(spark, sf))))


def missing_years(spark, sf):
    """Years in which a company filed anything but has no complete annual row."""
    requests = V.facts(spark, sf).select("entity", F.year("end").alias("fiscal_year")).distinct()
    return annual.missing_years(requests, summary(spark, sf))


def filing_index_latest(spark, sf):
    """A filing index per document: its sentences play the filings, in parallel arrays."""
    parts = F.transform(split_sentences(F.col("text")), lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i")))
    number = F.lpad(F.col("doc_id").cast("string"), 10, "0")

    def column(build):
        return F.transform("parts", build)

    form = column(
        lambda p: F.when(p["n"] % 3 == 0, F.lit("10-K")).when(p["n"] % 3 == 1, F.lit("10-Q")).otherwise(F.lit("8-K"))
    )
    recent = F.struct(
        form.alias("form"),
        column(lambda p: F.concat(number, F.lit("-24-"), F.lpad(p["i"].cast("string"), 6, "0"))).alias("accessionNumber"),
        column(lambda p: F.concat(F.lit("doc"), p["n"].cast("string"), F.lit(".htm"))).alias("primaryDocument"),
        column(lambda p: F.date_sub(F.lit("2025-10-31").cast("date"), p["i"]).cast("string")).alias("filingDate"),
        column(lambda p: F.date_sub(F.lit("2025-09-27").cast("date"), p["i"]).cast("string")).alias("reportDate"),
    )
    submissions = (
        V.table(spark, sf, "documents")
        .select(number.alias("cik"), "doc_id", parts.alias("parts"))
        .select("cik", F.struct(recent.alias("recent")).alias("filings"))
    )
    return filing_source.latest_filing(filing_source.filing_index(submissions))


def json_props(spark, sf):
    events = V.table(spark, sf, "events").select("event_type", F.from_json("props", "k BIGINT").alias("p"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("largest"))


def latest_per_user(spark, sf):
    """First matching entry per key, newest first: each user's last purchase."""
    events = V.table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    return events.groupBy("user_id").agg(
        F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e")
    ).select("user_id", "e.*")


QUERIES = {
    f.__name__: f
    for f in (
        annual_summary,
        annual_summary_joins,
        facts_latest_filing,
        annual_metric,
        facts_from_json,
        facts_quarantine,
        latest_n_periods,
        growth_yoy,
        cagr,
        takeaways,
        kpi_snapshot,
        kpi_year,
        dq_missing_columns,
        dq_report,
        dq_report_raw,
        overall_change,
        best_worst_year,
        interval_changes,
        series_long,
        transpose_years,
        years_descending,
        display_table,
        missing_years,
        filing_index_latest,
        json_props,
        latest_per_user,
    )
}

_BASE = V.ctes(*V.SUMMARY_CTES)
_FIVE = """five AS (SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY entity ORDER BY "end" DESC) <= 5)"""
_GROWN = """grown AS (SELECT *, (revenue_billions / lag(revenue_billions) OVER w - 1) * 100 AS revenue_growth_pct,
    (operating_cash_flow_billions / lag(operating_cash_flow_billions) OVER w - 1) * 100 AS cash_flow_growth_pct,
    operating_margin_pct - lag(operating_margin_pct) OVER w AS operating_margin_change_pp
  FROM five WINDOW w AS (PARTITION BY entity ORDER BY "end"))"""
_SUMMARY = (
    _BASE
    + """SELECT entity, CAST("end" AS VARCHAR) AS "end", """
    + ", ".join(METRICS)
    + ", fiscal_year FROM summary"
)
_CAGR = """CASE WHEN count(*) > 1 THEN
    round((power(arg_max(revenue_billions, "end") / arg_min(revenue_billions, "end"), 1.0 / (count(*) - 1)) - 1) * 100, 6) END"""


def _quality_sql(source: str) -> str:
    columns = ["entity", '"end"', *METRICS]
    null_row = " OR ".join(f"{c} IS NULL" for c in columns)
    checks = [
        ("Financial data is empty.", f"CASE WHEN (SELECT count(*) FROM {source}) = 0 THEN 1 ELSE 0 END"),
        ("Financial data contains missing values.", f"(SELECT count(*) FROM {source} WHERE {null_row})"),
        (
            "Financial data contains duplicate fiscal years.",
            f"""(SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT entity, "end" FROM {source}))""",
        ),
        ("Revenue must be positive.", f"(SELECT count(*) FROM {source} WHERE revenue_billions <= 0)"),
        *[(f"{c} must be positive.", f"(SELECT count(*) FROM {source} WHERE {c} <= 0)") for c in C.POSITIVE_COLUMNS],
        (
            "Operating margin is outside the expected range.",
            f"""(SELECT count(*) FROM {source} WHERE operating_margin_pct IS NULL
                OR operating_margin_pct < 0 OR operating_margin_pct > 100)""",
        ),
    ]
    rows = " UNION ALL ".join(
        f"""SELECT {i} AS position, '{name}' AS "check", CAST({count} AS BIGINT) AS failed_rows"""
        for i, (name, count) in enumerate(checks, start=1)
    )
    return f"SELECT position, \"check\", failed_rows, failed_rows = 0 AS passed FROM ({rows})"


_RAW = (
    """raw AS (SELECT *, operating_income_billions / nullif(revenue_billions, 0) * 100 AS operating_margin_pct,
    net_income_billions / nullif(revenue_billions, 0) * 100 AS net_profit_margin_pct FROM (SELECT entity, "end", """
    + ", ".join(
        f"CASE WHEN concept = '{concept}' THEN val / 1e9 - 20 END AS {column}"
        for column, concept in C.CONCEPT_COLUMNS.items()
    )
    + " FROM facts))"
)
_MONEY = "concat('$', printf('%.2f', round({0}, 2)), 'B')"
_NOTE = """CASE WHEN {0} IS NULL THEN 'First year in range'
    ELSE concat(printf('%+.2f', round({0}, 2)), '% year-over-year') END"""
_CARDS = [
    (1, "Revenue", "revenue_billions", _NOTE.format("revenue_growth_pct")),
    (2, "Operating Income", "operating_income_billions", "concat(printf('%.2f', round(operating_margin_pct, 2)), '% operating margin')"),
    (3, "Net Income", "net_income_billions", "concat(printf('%.2f', round(net_profit_margin_pct, 2)), '% net margin')"),
    (4, "Operating Cash Flow", "operating_cash_flow_billions", _NOTE.format("cash_flow_growth_pct")),
]

_KPI = V.ctes(*V.SUMMARY_CTES, _FIVE, _GROWN) + " UNION ALL ".join(
    f"""SELECT entity, fiscal_year, CAST("end" AS VARCHAR) AS "end", {n} AS position, '{label}' AS label,
        {value} AS value, {_MONEY.format(value)} AS display, {note} AS note FROM grown"""
    for n, label, value, note in _CARDS
)

ORACLES = {
    "annual_summary": _SUMMARY,
    "annual_summary_joins": _SUMMARY,
    "facts_latest_filing": V.ctes(V.FACTS_SQL, V.LATEST_SQL)
    + """SELECT entity, concept, CAST("end" AS VARCHAR) AS "end", CAST("start" AS VARCHAR) AS "start",
      CAST(filed AS VARCHAR) AS filed, accn, val FROM latest""",
    "annual_metric": V.ctes(V.FACTS_SQL, V.LATEST_SQL)
    + f"""SELECT entity, CAST("end" AS VARCHAR) AS "end", val / 1e9 AS revenue_billions FROM latest
      WHERE concept = '{C.CONCEPT_COLUMNS["revenue_billions"]}'""",
    "facts_from_json": V.ctes(V.FACTS_SQL)
    + f"""SELECT entity, concept, ({V.sql_list(UNITS)})[CAST(accn AS BIGINT) % {len(UNITS)} + 1] AS unit, count(*) AS facts, max(val) AS largest,
      CAST(min(filed) AS VARCHAR) AS first_filed, max(accn) AS last_accn FROM facts
      WHERE entity % 10 <> 3 AND NOT (entity % 7 = 2 AND concept = '{CONCEPTS[1]}') GROUP BY ALL""",
    "facts_quarantine": V.ctes(V.FACTS_SQL)
    + f"""SELECT DISTINCT entity, CAST(NULL AS VARCHAR) AS concept, 'document is malformed' AS reason FROM facts WHERE entity % 10 = 3
      UNION ALL SELECT DISTINCT entity, concept, 'concept is malformed' FROM facts
      WHERE entity % 10 <> 3 AND entity % 7 = 2 AND concept = '{CONCEPTS[1]}'""",
    "latest_n_periods": _BASE
    + f"""SELECT entity, CAST("end" AS VARCHAR) AS "end", fiscal_year, {', '.join(METRICS)} FROM summary
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY summary."end" DESC) <= 3""",
    "growth_yoy": V.ctes(*V.SUMMARY_CTES, _FIVE, _GROWN)
    + "SELECT entity, fiscal_year, revenue_growth_pct, cash_flow_growth_pct, operating_margin_change_pp FROM grown",
    "cagr": V.ctes(*V.SUMMARY_CTES, _FIVE)
    + f"SELECT entity, count(*) AS periods, {_CAGR} AS revenue_cagr_pct FROM five GROUP BY entity",
    "takeaways": V.ctes(*V.SUMMARY_CTES, _FIVE, _GROWN)
    + f"""SELECT g.*, c.revenue_cagr_pct FROM
      (SELECT entity, fiscal_year AS latest_year, revenue_growth_pct, operating_margin_change_pp, cash_flow_growth_pct
       FROM grown QUALIFY row_number() OVER (PARTITION BY entity ORDER BY "end" DESC) = 1) g
      JOIN (SELECT entity, {_CAGR} AS revenue_cagr_pct FROM five GROUP BY entity) c USING (entity)""",
    "kpi_snapshot": _KPI,
    "kpi_year": f"SELECT * FROM ({_KPI}) WHERE fiscal_year = 2023",
    "dq_missing_columns": """SELECT 0 AS position, 'Missing columns: ' || string_agg(name, ', ' ORDER BY place) AS "check",
      count(*) AS failed_rows, count(*) = 0 AS passed FROM (SELECT unnest(names) AS name, generate_subscripts(names, 1) AS place FROM (SELECT """
    + V.sql_list(quality.REQUIRED_COLUMNS)
    + " AS names)) WHERE name IN ('net_income_billions', 'operating_margin_pct')",
    "dq_report": _BASE + _quality_sql("summary"),
    "dq_report_raw": V.ctes(V.FACTS_SQL, _RAW) + _quality_sql("raw"),
    "overall_change": V.ctes(*V.SUMMARY_CTES, _FIVE, V.LONG_SQL.replace("FROM summary", "FROM five"))
    + """SELECT *, last_value - first_value AS value_change, (last_value - first_value) / first_value * 100 AS growth_pct
      FROM (SELECT entity, metric, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year,
        arg_min(value, "end") AS first_value, arg_max(value, "end") AS last_value FROM series GROUP BY entity, metric)""",
    "best_worst_year": V.ctes(*V.SUMMARY_CTES, V.LONG_SQL)
    + """SELECT h.entity, h.metric, h.fiscal_year AS highest_year, l.fiscal_year AS lowest_year FROM
      (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY value DESC, fiscal_year) = 1) h
      JOIN (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY value, fiscal_year) = 1) l
      USING (entity, metric)""",
    "interval_changes": V.ctes(
        *V.SUMMARY_CTES,
        V.LONG_SQL,
        """steps AS (SELECT entity, metric, lag(fiscal_year) OVER w AS start_year, fiscal_year AS end_year,
          round(value, 2) - lag(round(value, 2)) OVER w AS change FROM series
          WINDOW w AS (PARTITION BY entity, metric ORDER BY "end"))""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, metric
          ORDER BY round(abs(change), 6) DESC, start_year) AS n FROM steps WHERE start_year IS NOT NULL)""",
    )
    + """SELECT entity, metric, count(*) AS intervals,
      max(CASE WHEN n = 1 THEN start_year END) AS largest_start, max(CASE WHEN n = 1 THEN end_year END) AS largest_end,
      round(max(CASE WHEN n = 1 THEN change END), 4) AS largest_change,
      bool_and(change >= 0) AS never_fell, bool_and(change <= 0) AS never_rose FROM ranked GROUP BY entity, metric""",
    "series_long": V.ctes(*V.SUMMARY_CTES, V.LONG_SQL)
    + """SELECT entity, CAST("end" AS VARCHAR) AS "end", fiscal_year, metric, value FROM series""",
    "years_descending": V.ctes(*V.SUMMARY_CTES)
    + """SELECT entity, string_agg(CAST(fiscal_year AS VARCHAR), ',' ORDER BY fiscal_year DESC) AS years
      FROM (SELECT DISTINCT entity, fiscal_year FROM summary) GROUP BY entity""",
    "transpose_years": V.ctes(*V.SUMMARY_CTES, V.LONG_SQL)
    + "SELECT entity, metric, "
    + ", ".join(f"max(CASE WHEN fiscal_year = {y} THEN value END) AS \"FY{y}\"" for y in V.YEARS)
    + " FROM series GROUP BY entity, metric",
    "display_table": V.ctes(*V.SUMMARY_CTES, _FIVE, _GROWN)
    + "SELECT entity, "
    + ", ".join(
        f'fiscal_year AS "{title}"' if name == "fiscal_year" else f'round({name}, 2) AS "{title}"'
        for name, title in C.DISPLAY_COLUMNS.items()
    )
    + " FROM grown",
    "missing_years": _BASE
    + """SELECT DISTINCT entity, CAST(year("end") AS INTEGER) AS fiscal_year FROM facts f WHERE NOT EXISTS
      (SELECT 1 FROM summary s WHERE s.entity = f.entity AND s.fiscal_year = year(f."end"))""",
    "filing_index_latest": V.ctes(
        V.SENTENCES_SQL,
        "entries AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS i FROM sentences)",
        """matching AS (SELECT doc_id, i, length(part) AS n FROM entries WHERE length(part) % 3 = 0
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)""",
        """named AS (SELECT *, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS cik,
        concat('24-', lpad(CAST(i AS VARCHAR), 6, '0')) AS tail FROM matching)""",
    )
    + """SELECT cik, '10-K' AS form, concat(cik, '-', tail) AS accession_number, concat('doc', n, '.htm') AS primary_document,
      CAST(DATE '2025-10-31' - CAST(i AS INTEGER) AS VARCHAR) AS filing_date,
      CAST(DATE '2025-09-27' - CAST(i AS INTEGER) AS VARCHAR) AS report_date,
      concat('https://www.sec.gov/Archives/edgar/data/', doc_id, '/', cik, replace(tail, '-', ''), '/doc', n, '.htm')
        AS source_url FROM named""",
    "json_props": """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
      max(CAST(json_extract(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY event_type""",
    "latest_per_user": """SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
}
