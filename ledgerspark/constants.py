"""Names, word lists, patterns and messages that decide results.

All of them are only defaults; every operator takes its tables as parameters.
"""

from __future__ import annotations

# --- Fixed values: reported concept behind each summary column ---------------------------------
CONCEPT_COLUMNS = {
    "revenue_billions": "RevenueFromContractWithCustomerExcludingAssessedTax",
    "operating_income_billions": "OperatingIncomeLoss",
    "net_income_billions": "NetIncomeLoss",
    "operating_cash_flow_billions": "NetCashProvidedByUsedInOperatingActivities",
    "total_assets_billions": "Assets",
    "total_liabilities_billions": "Liabilities",
    "cash_and_cash_equivalents_billions": "CashAndCashEquivalentsAtCarryingValue",
}
MARGIN_COLUMNS = ("operating_margin_pct", "net_profit_margin_pct")
SUMMARY_METRICS = (*CONCEPT_COLUMNS, *MARGIN_COLUMNS)
POSITIVE_COLUMNS = (
    "total_assets_billions",
    "total_liabilities_billions",
    "cash_and_cash_equivalents_billions",
)
UNIT_SCALE = 1_000_000_000
DISPLAY_COLUMNS = {
    "fiscal_year": "Fiscal Year",
    "revenue_billions": "Revenue ($B)",
    "operating_income_billions": "Operating Income ($B)",
    "net_income_billions": "Net Income ($B)",
    "operating_cash_flow_billions": "Operating Cash Flow ($B)",
    "total_assets_billions": "Total Assets ($B)",
    "total_liabilities_billions": "Total Liabilities ($B)",
    "cash_and_cash_equivalents_billions": "Cash ($B)",
    "operating_margin_pct": "Operating Margin (%)",
    "net_profit_margin_pct": "Net Margin (%)",
    "revenue_growth_pct": "Revenue Growth (%)",
}

# --- Fixed values: words in a question that name a metric, as (alias, column, label, unit) -----
METRIC_ALIASES = (
    ("cash and cash equivalents", "cash_and_cash_equivalents_billions", "Cash and Cash Equivalents", "$B"),
    ("cash position", "cash_and_cash_equivalents_billions", "Cash and Cash Equivalents", "$B"),
    ("total liabilities", "total_liabilities_billions", "Total Liabilities", "$B"),
    ("liabilities", "total_liabilities_billions", "Total Liabilities", "$B"),
    ("total assets", "total_assets_billions", "Total Assets", "$B"),
    ("assets", "total_assets_billions", "Total Assets", "$B"),
    ("cash", "cash_and_cash_equivalents_billions", "Cash and Cash Equivalents", "$B"),
    ("operating cash flow", "operating_cash_flow_billions", "Operating Cash Flow", "$B"),
    ("operating margin", "operating_margin_pct", "Operating Margin", "%"),
    ("net profit margin", "net_profit_margin_pct", "Net Profit Margin", "%"),
    ("net margin", "net_profit_margin_pct", "Net Profit Margin", "%"),
    ("operating income", "operating_income_billions", "Operating Income", "$B"),
    ("net income", "net_income_billions", "Net Income", "$B"),
    ("revenue", "revenue_billions", "Revenue", "$B"),
    ("net sales", "revenue_billions", "Revenue", "$B"),
)
# an alias is ignored in a question that also contains this text
ALIAS_BLOCKERS = {"cash": "cash flow"}
PLURAL_LABELS = ("Total Assets", "Total Liabilities", "Cash and Cash Equivalents")

# --- Fixed values: question routing -------------------------------------------------------------
RISK_KEYWORDS = (
    "risk",
    "cybersecurity",
    "privacy",
    "ransomware",
    "supply chain",
    "supplier",
    "manufacturing",
    "tariff",
    "foreign exchange",
    "currency",
    "competition",
    "regulation",
    "regulatory",
    "legal",
    "intellectual property",
)
EXPLANATION_TERMS = (
    "why",
    "reason",
    "driver",
    "driven",
    "cause",
    "contribute",
    "explain",
    "because",
    "due to",
    "attribut",
)
QUERY_EXPANSIONS = {
    "revenue": "net sales sales",
    "operating margin": "operating income net sales margin",
    "net margin": "net income net sales margin",
    "cash flow": "cash generated by operating activities liquidity",
    "iphone": "iPhone net sales",
    "services": "Services net sales",
}
NUMBER_WORDS = {
    "one": 1,
    "two": 2,
    "three": 3,
    "four": 4,
    "five": 5,
    "six": 6,
    "seven": 7,
    "eight": 8,
    "nine": 9,
    "ten": 10,
}
DEFAULT_TREND_YEARS = 5
YEAR_PATTERN = r"\b20\d{2}\b"
TREND_PATTERN = (
    r"(?:last|past|over the last|over)\s+"
    r"(\d+|one|two|three|four|five|six|seven|eight|nine|ten)"
    r"\s+(?:fiscal\s+)?years?"
)

# --- Fixed values: messages ----------------------------------------------------------------------
NO_METRIC_MESSAGE = "Please specify a supported financial metric."
NO_DATA_MESSAGE = "No matching financial data was found."
NO_EVIDENCE_MESSAGE = "No relevant Risk Factors evidence was found."
EVIDENCE_SOURCE_LINE = "Source: SEC Company Facts API via Spark"

# --- Fixed values: filing text -------------------------------------------------------------------
FILING_SPACING_FIXES = {
    "resultsof": "results of",
    "andthe": "and the",
    "canbe": "can be",
    "adverselyaffect": "adversely affect",
    "timeand": "time and",
}
# (section, heading pattern, phrase expected soon after the real heading, end pattern)
SECTION_SPECS = (
    (
        "Item 1A. Risk Factors",
        r"Item\s+1A\.\s+Risk Factors",
        "the following summarizes factors",
        r"Item\s+1B\.\s+Unresolved Staff Comments",
    ),
    (
        "Item 7. MD&A",
        r"Item\s+7\.\s+Management.s Discussion and Analysis of Financial Condition and Results of Operations",
        "the following discussion should be read in conjunction",
        r"Item\s+7A\.\s+Quantitative and Qualitative Disclosures About Market Risk",
    ),
)
MARKER_WINDOW = 500
CHUNK_CHARACTERS = 1500
OVERLAP_SENTENCES = 1
ABBREVIATIONS = ("U.S.", "D.C.", "Inc.", "No.")
PERIOD_TOKEN = "<PERIOD>"

# --- Fixed values: generated answers -------------------------------------------------------------
ANSWER_SPACING_FIXES = {
    "iPhoneup": "iPhone up",
    "andiPad": "and iPad",
    "growthat": "growth at",
    "orforce": "or force",
    "oncommercially": "on commercially",
    "andproduct": "and product",
    "riskscould": "risks could",
    "higherServices": "higher Services",
    "orlimited": "or limited",
}
TABLE_HEADER_CELLS = ("fiscal year", "year")
# white space of every kind: Unicode's and the four ASCII separators
SPACE = r"(?U:[\s\x1c-\x1f])"
ANSWER_SPACING_PATTERNS = (
    (r"(?<=[.!?])(?=[A-Z])", " "),
    (rf"(?<!{SPACE})(\[(?:F|M)?\d+\])", " $1"),
    (r"\b(up|down)(?=\d)", "$1 "),
    (r"(?<=\d)([BM])(?=[A-Za-z])", "$1 "),
    (r"(?<=%)(?=[A-Za-z])", " "),
)
TABLE_RULE = rf"^\|?(?:{SPACE}|[:|\-])+\|?$"
LINE_MARKS = r"^[# ]+"
CELL_BORDERS = r"^\|+|\|+$"

# --- Fixed values: lines of figures texts ------------------------------------------------------------
YEAR_HEADING = r"^FY(20\d{2})$"
CHANGE_HEADING = "Overall change"
SOURCE_HEADING = "Source:"
SINGLE_VALUE = r"(?md)^(.+?) in FY(20\d{2}): (.+)$"

# --- Fixed values: reference lists --------------------------------------------------------------------
STATEMENTS_TITLE = "Financial Statements"
MDA_TITLE = "Item 7. Management’s Discussion and Analysis"
REFERENCES_HEADING = "References:"

# --- Fixed values: risk topics -------------------------------------------------------------------
TOPIC_LABELS = {
    1: "Cybersecurity and Data Privacy",
    2: "Products and Competition",
    3: "Foreign Exchange",
    4: "Credit, Investment and Tax Risk",
    5: "Legal and Regulatory",
    6: "Trade and Supply Chain",
}
TOPIC_ANCHORS = {
    1: ("information", "attacks", "confidential", "unauthorized", "security"),
    2: ("products", "services", "competition", "software", "intellectual"),
    3: ("foreign", "dollar", "currency", "currencies", "denominated"),
    4: ("tax", "taxes", "receivables", "credit", "investment"),
    5: ("laws", "legal", "regulations", "investigations", "litigation"),
    6: ("tariffs", "trade", "supply", "imports", "partners"),
}
MIXED_TOPIC_LABEL = "Other / Mixed Risks"
LOW_CONFIDENCE_SHARE = 0.50
WORDS_PER_TOPIC = 8
EXCERPT_SENTENCES = 4
PREVIEW_CHARACTERS = 500

# --- Fixed values: default English stop words (the list Spark ML ships), minus the entries with
# --- an apostrophe, which a token of word characters can never equal --------------------------------
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now cannot could ought would
    """.split()
)
