"""Stand-ins for filings data, derived row by row from the shared tables.

Each view exists twice: as a DataFrame and as SQL for the independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import constants as C

CONCEPTS = list(C.CONCEPT_COLUMNS.values())
# rows of these cost far more to work on than to move
SCAN_PARTITIONS = "spark.ledgerspark.scanPartitions"
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")
ANNUAL_FORM, ANNUAL_PERIOD = "A", "F"
YEARS = list(range(2019, 2026))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to as many partitions as the session asks for, as it may for tables in one small file.

    Without the setting scans stay as they are.
    """
    parts = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_rows(values) -> str:
    return ", ".join(f"({quoted(v)})" for v in values)


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# --- facts: every line item reports one concept of its supplier for the year it shipped ---------


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity = supplier, concept by line number, filing = order; years are moved to 2019-2025."""
    items = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate") + 24
    concepts = F.array(*[F.lit(c) for c in CONCEPTS])
    return items.select(
        F.col("l_suppkey").alias("entity"),
        F.element_at(concepts, F.col("l_linenumber")).alias("concept"),
        F.lit("USD").alias("unit"),
        F.when(F.col("l_quantity") >= 25, F.make_date(year - 1, F.lit(9), F.lit(28)))
        .otherwise(F.make_date(year, F.lit(6), F.lit(28)))
        .alias("start"),
        F.make_date(year, F.lit(9), F.lit(27)).alias("end"),
        (F.col("l_extendedprice") * 1000000.0).alias("val"),
        F.col("l_returnflag").alias("form"),
        F.col("l_linestatus").alias("fp"),
        F.add_months(F.col("l_shipdate").cast("date"), 288).alias("filed"),
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("accn"),
    )


FACTS_SQL = f"""facts AS (
  SELECT l_suppkey AS entity, ({sql_list(CONCEPTS)})[l_linenumber] AS concept, 'USD' AS unit,
    CASE WHEN l_quantity >= 25 THEN make_date(year(l_shipdate) + 23, 9, 28)
         ELSE make_date(year(l_shipdate) + 24, 6, 28) END AS "start",
    make_date(year(l_shipdate) + 24, 9, 27) AS "end",
    l_extendedprice * 1000000.0::DOUBLE AS val, l_returnflag AS form, l_linestatus AS fp,
    CAST(l_shipdate + INTERVAL 24 YEAR AS DATE) AS filed,
    lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS accn
  FROM lineitem)"""

LATEST_SQL = f"""latest AS (
  SELECT * FROM facts WHERE form = '{ANNUAL_FORM}' AND fp = '{ANNUAL_PERIOD}' AND unit = 'USD'
  QUALIFY row_number() OVER (PARTITION BY entity, concept, "end"
    ORDER BY filed DESC, "start" ASC, accn DESC, val DESC) = 1)"""

SUMMARY_SQL = (
    """wide AS (SELECT entity, "end", """
    + ", ".join(
        f"max(CASE WHEN concept = '{concept}' THEN val END) / 1e9 AS {column}"
        for column, concept in C.CONCEPT_COLUMNS.items()
    )
    + """ FROM latest GROUP BY entity, "end" HAVING count(*) = 7),
summary AS (SELECT *, operating_income_billions / revenue_billions * 100 AS operating_margin_pct,
    net_income_billions / revenue_billions * 100 AS net_profit_margin_pct,
    CAST(year("end") AS INTEGER) AS fiscal_year FROM wide)"""
)
SUMMARY_CTES = (FACTS_SQL, LATEST_SQL, SUMMARY_SQL)

LONG_SQL = (
    "series AS ("
    + " UNION ALL ".join(
        f"""SELECT entity, "end", fiscal_year, '{m}' AS metric, {m} AS value FROM summary"""
        for m in C.SUMMARY_METRICS
    )
    + ")"
)

# --- questions: every event asks one question about the company numbered like its user ----------

QUESTION_WORDS = ["thatin", "hehely", "orantion", "nicht", "mente", "outre", "ciónue", "thing"]
ALIASES = [a[0] for a in C.METRIC_ALIASES]


def _question_sql(pick, lowest_id: str = "event_id") -> str:
    """The question text as SQL; ``pick(values, index)`` is the engine's list access."""
    e = lowest_id
    first = pick(ALIASES, f"{e} % {len(ALIASES)}")
    second = pick(ALIASES, f"({e} * 7 + 3) % {len(ALIASES)}")
    risk = pick(list(C.RISK_KEYWORDS), f"{e} % {len(C.RISK_KEYWORDS)}")
    word = pick(QUESTION_WORDS, f"{e} % {len(QUESTION_WORDS)}")
    number = pick(["no", *C.NUMBER_WORDS], f"{e} % 11")
    y1, y2, y3 = (f"(2019 + ({e} * {a} + {b}) % 7)" for a, b in ((1, 0), (3, 1), (5, 2)))
    return f"""CASE {e} % 10
      WHEN 0 THEN concat('What was the company''s ', {first}, ' in ', {y1}, '?')
      WHEN 1 THEN concat('Compare ', {first}, ' and ', {second}, ' in ', {y1}, ', ', {y2}, ', and ', {y3}, '.')
      WHEN 2 THEN concat('Show the ', {first}, ' over the past ', {number}, ' years.')
      WHEN 3 THEN concat('Show the ', upper({first}), ' trend.')
      WHEN 4 THEN concat('Why did ', {first}, ' change in FY', {y1}, ' or ', {y2}, ', ', {word}, '?')
      WHEN 5 THEN concat('What ', {risk}, ' and ', {word}, ' exposure does the company disclose?')
      WHEN 6 THEN concat('What is the weather in Los Angeles in ', {y1}, '?')
      WHEN 7 THEN concat('How did ', {first}, ' and ', {second}, ' develop over the last ', {e} % 9, ' fiscal years?')
      WHEN 8 THEN concat('Explain ', {first}, ' and services in ', {y1}, ' due to ', {word}, ' and iPhone', {e} % 17, '.')
      ELSE concat('Compare ', {first}, ' in ', {y1}, ', ', {y1}, ' and ', {y2}, ' with 2031.') END"""


def _spark_pick(values, index):
    items = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return f"element_at(array({items}), CAST({index} AS INT) + 1)"


def _duck_pick(values, index):
    return f"({sql_list(values)})[{index} + 1]"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark reads a doubled quote inside a literal differently, so the apostrophe is escaped here.
    text = _question_sql(_spark_pick).replace("company''s ", "company\\'s ")
    # exploding a one-element array keeps the optimizer from repeating the long text expression in
    # every filter above it; stored questions would be a plain column
    return spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("question_id"),
        F.col("user_id").alias("entity"),
        F.explode(F.array(F.expr(text))).alias("text"),
    )


QUESTIONS_SQL = (
    f"questions AS (SELECT event_id AS question_id, user_id AS entity, {_question_sql(_duck_pick)} AS text FROM events)"
)

# --- filings: every page becomes a filing with a table of contents and two sections -------------

_CONTENTS = (
    "<p>😀📈 𝔸𝔹𝔻 🧾💶</p>"
    "<p>Item 1A.&nbsp;Risk Factors 5</p><p>Item 1B. Unresolved Staff Comments 17</p>"
    "<p>Item 7. Management&#8217;s Discussion and Analysis of Financial Condition and Results of Operations 21</p>"
    "<p>Item 7A. Quantitative and Qualitative Disclosures About Market Risk 27</p>"
)
_RISK = "<h2>Item&#160;1A. &nbsp;RISK FACTORS</h2><p>The following summarizes factors <b>resultsof</b> operations canbe seen in. "
_RISK_END = "<h2>Item 1B. Unresolved Staff Comments</h2><p>None.</p>"
_MDA = (
    "<h2>Item 7. Management&rsquo;s Discussion and Analysis of Financial Condition and Results of Operations</h2>"
    "<p>The following discussion should be read in conjunction with the statements. "
)
_MDA_END = "<h2>Item 7A. Quantitative and Qualitative Disclosures About Market Risk</h2>"

_FILING = """concat('{contents}', html, '{risk}', html,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE '{risk_end}' END,
  CASE WHEN page_id % 7 = 0 THEN '' ELSE concat('{mda}', html, '{mda_end}') END)""".format(
    contents=_CONTENTS, risk=_RISK, risk_end=_RISK_END, mda=_MDA, mda_end=_MDA_END
)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_FILING).alias("html"))


def text_sql(source: str, html: str = "html") -> str:
    """Markup to cleaned text in SQL, for the entities that occur here."""
    in_tag = """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
    raw = "|".join(rf"<{name}\b{in_tag}>.*?(?:</{name}\b[^>]*>|\z)" for name in ("script", "style", "template"))
    out = rf"regexp_replace({html}, '(?is)<!--.*?(?:-->|\z)|{raw}|<[/!?a-z]{in_tag}>|<[/!?a-z][^>]*>', ' ', 'g')"
    for entity, char in (
        ("&nbsp;", "chr(160)"),
        ("&#160;", "chr(160)"),
        ("&#8217;", "chr(8217)"),
        ("&rsquo;", "chr(8217)"),
        ("&middot;", "chr(183)"),
        ("&copy;", "chr(169)"),
        ("&quot;", "'\"'"),
        ("&rarr;", "chr(8594)"),
        ("&CounterClockwiseContourIntegral;", "chr(8755)"),
        ("&notit;", "concat(chr(172), 'it;')"),
        ("&copy 2", "concat(chr(169), ' 2')"),
        ("&amp;", "'&'"),
    ):
        out = f"replace({out}, '{entity}', {char})"
    out = f"regexp_replace({out}, '[\\s\\x{{00A0}}\\x{{2003}}\\x{{3000}}]+', ' ', 'g')"
    for wrong, right in C.FILING_SPACING_FIXES.items():
        out = f"regexp_replace({out}, '\\b{wrong}\\b', '{right}', 'gi')"
    return f"SELECT page_id, trim({out}) AS text FROM {source}"


# quoted attributes with >, rare and bare references, a script that never ends
_AWKWARD = """concat('<p title="a > b" class=x>Start &rarr; &CounterClockwiseContourIntegral; &notit; &copy 2024 &unknown;</p><!-- <p> -->',
  html, '<a href="?a=1>2" >end</a><script>if (a < b) { write("<p>x</p>") } ', html)"""


def awkward_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_AWKWARD).alias("html"))


AWKWARD_SQL = text_sql(f"(SELECT page_id, {_AWKWARD} AS html FROM pages)")


FILINGS_SQL = f"filings AS (SELECT page_id, {_FILING} AS html FROM pages)"

# --- shared text pieces ---------------------------------------------------------------------------

STOP_SQL = f"stop(word) AS (VALUES {sql_rows(C.STOP_WORDS)})"


def words_sql(name: str, source: str, key: str) -> str:
    """(key, words): the tokens of a text that are no stop words, as a list in text order."""
    return f"""{name} AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: NOT list_contains({sql_list(C.STOP_WORDS)}, w)) AS words FROM {source})"""


def counts_sql(name: str, words: str, key: str) -> str:
    """(key, term, tf) over words and neighbouring pairs."""
    return f"""{name} AS (SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(words, list_transform(range(1, len(words)),
      lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM {words}) GROUP BY ALL)"""


SENTENCES_SQL = """sentences AS (SELECT doc_id,
    string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)"""
