"""Queries over questions: reading, figures, evidence, sentences and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.operators import answers, generated_text, questions
from ledgerspark.plans.question_answering import answer_questions
from queries import facts as facts_queries
from queries import text as text_queries
from queries import views as V


def _parsed(spark, sf) -> DataFrame:
    return questions.read_questions(V.questions(spark, sf))


def _selected(spark, sf) -> DataFrame:
    return questions.select_periods(_parsed(spark, sf), facts_queries.summary(spark, sf))


def question_route(spark, sf):
    return _parsed(spark, sf).select("question_id", "route", "explain")


def question_metrics(spark, sf):
    return _parsed(spark, sf).select("question_id", F.posexplode("metrics").alias("position", "m")).select(
        "question_id", "position", "m.column", "m.label", "m.unit"
    )


def question_years(spark, sf):
    return _parsed(spark, sf).select("question_id", F.posexplode("years").alias("position", "fiscal_year"))


def question_trend(spark, sf):
    return _parsed(spark, sf).select("question_id", "trend_years").filter(F.col("trend_years").isNotNull())


def conversation_routes(spark, sf):
    """The readers over real turns and documents, with word lists that occur in that text."""
    turns = V.table(spark, sf, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("id"), "text")
    docs = V.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    aliases = [(w, f"column_{w}", w.upper(), "%") for w in V.QUESTION_WORDS]
    parsed = questions.read_questions(
        turns.unionByName(docs), aliases, {"thing": "nothing"}, ["hehely", "enung"], ["ing", "eau"]
    )
    return parsed.select(
        "id", "route", "explain", F.array_join(F.transform("metrics", lambda m: m["label"]), ",").alias("labels")
    )


def question_figures(spark, sf):
    return questions.answer_figures(_selected(spark, sf))


def question_changes(spark, sf):
    return questions.question_changes(_selected(spark, sf)).select(
        "question_id", "metric_position", "label", "first_year", "last_year", "change", "growth", "highest_year", "lowest_year"
    )


def question_missing_years(spark, sf):
    asked = _selected(spark, sf).filter(F.col("route") == "financial")
    return asked.select("question_id", F.explode("missing_years").alias("fiscal_year"))


def evidence_texts(spark, sf):
    asked = _selected(spark, sf).filter(F.col("route") == "financial")
    return questions.evidence_text(asked).select("question_id", "evidence")


def change_sentences(spark, sf):
    return answers.change_sentences(_selected(spark, sf))


def evidence_parse(spark, sf):
    return generated_text.parse_evidence(evidence_texts(spark, sf))


def _metadata(spark, sf) -> DataFrame:
    # every seventh company has no filing on record
    return V.table(spark, sf, "supplier").filter("s_suppkey % 7 <> 0").select(
        F.col("s_suppkey").alias("entity"),
        F.concat("s_name", F.lit(" Inc.")).alias("company"),
        F.lit("10-K").alias("form"),
        F.lit("2025-10-31").alias("filing_date"),
        F.concat(F.lit("https://example.org/"), F.col("s_suppkey").cast("string")).alias("source_url"),
    )


def single_answers(spark, sf):
    """Written answers of the questions that come down to one value."""
    asked = _selected(spark, sf).filter(
        (F.col("route") == "financial") & (F.size("rows") == 1) & (F.size("metrics") == 1)
    )
    return answers.deterministic_answer(questions.evidence_text(asked), _metadata(spark, sf)).select("question_id", "answer")


def answer_texts(spark, sf):
    asked = _selected(spark, sf).filter(F.col("route") == "financial")
    return answers.deterministic_answer(questions.evidence_text(asked), _metadata(spark, sf)).select("question_id", "answer")


def routed_answers(spark, sf):
    """All three routes in one table: figures, evidence packs, out-of-scope messages."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic_label"), "text")
    index = text_queries._index(spark, sf)
    return answer_questions(
        V.questions(spark, sf),
        facts_queries.summary(spark, sf),
        _metadata(spark, sf),
        risk_chunks=docs,
        risk_index=index,
        mda_chunks=docs,
        mda_index=index,
    )


QUERIES = {
    f.__name__: f
    for f in (
        question_route,
        question_metrics,
        question_years,
        question_trend,
        conversation_routes,
        question_figures,
        question_changes,
        question_missing_years,
        evidence_texts,
        change_sentences,
        evidence_parse,
        single_answers,
        answer_texts,
        routed_answers,
    )
}

# --- SQL -------------------------------------------------------------------------------------------


def _any_sql(words, text="lower(text)") -> str:
    return "(" + " OR ".join(f"contains({text}, {V.quoted(w)})" for w in words) + ")"


_ALIAS_ROWS = ", ".join(
    f"({i}, {V.quoted(a)}, {V.quoted(c)}, {V.quoted(label)}, {V.quoted(u)})"
    for i, (a, c, label, u) in enumerate(C.METRIC_ALIASES)
)
_METRICS = (
    V.QUESTIONS_SQL,
    f"alias(ord, alias, col, label, unit) AS (VALUES {_ALIAS_ROWS})",
    """matched AS (SELECT question_id, ord, col, label, unit, instr(lower(text), alias) AS pos FROM questions, alias
      WHERE contains(lower(text), alias) AND NOT (alias = 'cash' AND contains(lower(text), 'cash flow')))""",
    """firsts AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY question_id, col ORDER BY pos, ord) = 1)""",
    """metrics AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pos, ord) - 1 AS INTEGER) AS position,
      col, label, unit FROM firsts)""",
)
_YEARS = (
    """mentions AS (SELECT question_id, unnest(y) AS fiscal_year, generate_subscripts(y, 1) AS i
      FROM (SELECT question_id, regexp_extract_all(text, '\\b20[0-9]{2}\\b') AS y FROM questions))""",
    """years AS (SELECT question_id, CAST(fiscal_year AS INTEGER) AS fiscal_year,
      CAST(row_number() OVER (PARTITION BY question_id ORDER BY min(i)) - 1 AS INTEGER) AS position
      FROM mentions GROUP BY question_id, fiscal_year)""",
)
_AMOUNT = f"regexp_extract(lower(text), '{C.TREND_PATTERN}', 1)"
_WORD_NUMBER = " ".join(f"WHEN '{w}' THEN {n}" for w, n in C.NUMBER_WORDS.items())
_TREND = (
    f"""trends AS (SELECT question_id, CAST(CASE WHEN regexp_full_match(amount, '[0-9]+') THEN CAST(amount AS INTEGER)
      WHEN amount <> '' THEN CASE amount {_WORD_NUMBER} END WHEN bare THEN {C.DEFAULT_TREND_YEARS} END AS INTEGER) AS trend_years
      FROM (SELECT question_id, {_AMOUNT} AS amount, contains(lower(text), 'trend') AS bare FROM questions))""",
)
_ROUTES = (
    f"""routes AS (SELECT question_id, entity, CASE WHEN {_any_sql(C.RISK_KEYWORDS)} THEN 'risk'
      WHEN question_id IN (SELECT question_id FROM metrics) THEN 'financial' ELSE 'unsupported' END AS route,
      {_any_sql(C.EXPLANATION_TERMS)} AS explain FROM questions)""",
)
_READ = (*_METRICS, *_YEARS, *_TREND, *_ROUTES)
# rows chosen for each financial question: named years, else the latest N, else the latest one
_CHOSEN = (
    *_READ,
    *V.SUMMARY_CTES,
    V.LONG_SQL,
    """chosen AS (SELECT question_id, r.entity, "end", fiscal_year,
        CAST(row_number() OVER (PARTITION BY question_id ORDER BY "end") - 1 AS INTEGER) AS row_position FROM (
      SELECT r.question_id, r.entity, s."end", s.fiscal_year FROM routes r JOIN summary s USING (entity)
        JOIN years y ON y.question_id = r.question_id AND y.fiscal_year = s.fiscal_year WHERE route = 'financial'
      UNION ALL
      SELECT question_id, entity, "end", fiscal_year FROM (
        SELECT r.question_id, r.entity, s."end", s.fiscal_year, coalesce(t.trend_years, 1) AS n,
          row_number() OVER (PARTITION BY r.question_id ORDER BY s."end" DESC) AS k
        FROM routes r JOIN summary s USING (entity) JOIN trends t ON t.question_id = r.question_id
        WHERE route = 'financial' AND r.question_id NOT IN (SELECT question_id FROM years)) WHERE k <= n) r)""",
    """figures AS (SELECT c.question_id, c.entity, c."end", c.row_position, m.position AS metric_position, c.fiscal_year,
        m.label, m.unit, s.value FROM chosen c JOIN metrics m USING (question_id)
      JOIN series s ON s.entity = c.entity AND s."end" = c."end" AND s.metric = m.col)""",
)
_CHANGES = (
    *_CHOSEN,
    """changes AS (SELECT question_id, metric_position, label, unit, first_year, last_year, last_value - first_value AS change,
        (last_value - first_value) / first_value * 100 AS growth, highest_year, lowest_year FROM (
      SELECT question_id, metric_position, any_value(label) AS label, any_value(unit) AS unit,
        arg_min(fiscal_year, row_position) AS first_year, arg_max(fiscal_year, row_position) AS last_year,
        arg_min(value, row_position) AS first_value, arg_max(value, row_position) AS last_value,
        first(fiscal_year ORDER BY value DESC, row_position) AS highest_year,
        first(fiscal_year ORDER BY value, row_position) AS lowest_year
      FROM figures GROUP BY question_id, metric_position HAVING count(*) > 1))""",
)


def _two(value: str) -> str:
    return f"printf('%.2f', round({value}, 2))"


def _shown(value: str) -> str:
    return f"CASE WHEN unit = '%' THEN {_two(value)} || '%' ELSE '$' || {_two(value)} || 'B' END"


_SIGN = "CASE WHEN {0} >= 0 THEN '+' ELSE '-' END"
_SIGNED = f"(CASE WHEN round({{0}}, 2) < 0 OR {{0}} < 0 THEN '-' ELSE '+' END || {_two('abs({0})')})"
_NL = "chr(10)"
_EVIDENCE = (
    *_CHANGES,
    """shape AS (SELECT r.question_id, (SELECT count(*) FROM chosen c WHERE c.question_id = r.question_id) AS n_rows,
      (SELECT count(*) FROM metrics m WHERE m.question_id = r.question_id) AS n_metrics FROM routes r WHERE route = 'financial')""",
    f"""blocks AS (SELECT question_id, row_position, concat('FY', any_value(fiscal_year), {_NL},
      string_agg(label || ': ' || {_shown('value')}, {_NL} ORDER BY metric_position)) AS block
      FROM figures GROUP BY question_id, row_position)""",
    f"""tables AS (SELECT question_id, 'Financial metrics by fiscal year:' || {_NL} || {_NL}
      || string_agg(block, {_NL} || {_NL} ORDER BY row_position) AS body FROM blocks GROUP BY question_id)""",
    f"""singles AS (SELECT question_id, concat(label, ' in FY', fiscal_year, ': ', {_shown('value')}) AS body FROM figures)""",
    f"""overall AS (SELECT question_id, concat({_NL}, {_NL}, 'Overall change from FY', any_value(first_year), ' to FY',
        any_value(last_year), ':', {_NL}, string_agg(CASE WHEN unit = '%'
          THEN concat(label, ': ', {_SIGNED.format('change')}, ' percentage points')
          ELSE concat(label, ': ', {_SIGN.format('change')}, '$', {_two('abs(change)')}, 'B', {_NL},
            label, ' growth: ', {_SIGNED.format('growth')}, '%') END, {_NL} ORDER BY metric_position)) AS overall
      FROM changes GROUP BY question_id)""",
    """ends AS (SELECT f.question_id, first(fiscal_year ORDER BY value DESC, row_position) AS hi,
      first(fiscal_year ORDER BY value, row_position) AS lo FROM figures f JOIN trends t USING (question_id)
      WHERE t.trend_years IS NOT NULL GROUP BY f.question_id)""",
    """missing AS (SELECT question_id, fiscal_year, position FROM years JOIN routes USING (question_id) WHERE route = 'financial'
      AND NOT EXISTS (SELECT 1 FROM summary s WHERE s.entity = routes.entity AND s.fiscal_year = years.fiscal_year))""",
    f"""absent AS (SELECT question_id, concat('No financial data was found for: ',
      string_agg('FY' || CAST(fiscal_year AS VARCHAR), ', ' ORDER BY position), {_NL}, {_NL}) AS line FROM missing GROUP BY question_id)""",
    f"""evidence AS (SELECT s.question_id, n_rows, n_metrics, CASE WHEN n_rows = 0 THEN '{C.NO_DATA_MESSAGE}' ELSE concat(
        coalesce(a.line, ''), CASE WHEN n_rows = 1 AND n_metrics = 1 THEN g.body ELSE t.body END, coalesce(o.overall, ''),
        CASE WHEN n_metrics = 1 AND e.hi IS NOT NULL THEN concat({_NL}, 'Highest year: FY', e.hi, {_NL}, 'Lowest year: FY', e.lo) ELSE '' END,
        {_NL}, {_NL}, '{C.EVIDENCE_SOURCE_LINE}') END AS evidence
      FROM shape s LEFT JOIN absent a USING (question_id) LEFT JOIN tables t USING (question_id)
      LEFT JOIN overall o USING (question_id) LEFT JOIN ends e USING (question_id)
      LEFT JOIN singles g ON g.question_id = s.question_id AND s.n_rows = 1 AND s.n_metrics = 1)""",
)
_INTERVALS = (
    *_CHANGES,
    """steps AS (SELECT question_id, metric_position, lag(fiscal_year) OVER w AS start_year, fiscal_year AS end_year,
      round(round(value, 2) - lag(round(value, 2)) OVER w, 6) AS step FROM figures
      WINDOW w AS (PARTITION BY question_id, metric_position ORDER BY row_position))""",
    """spans AS (SELECT question_id, metric_position, count(*) AS n, sum(step) AS total, bool_and(step >= 0) OR bool_and(step <= 0) AS steady,
      first(start_year ORDER BY abs(step) DESC, start_year) AS big_start, first(end_year ORDER BY abs(step) DESC, start_year) AS big_end,
      max(abs(step)) AS big, min(start_year) AS y1, max(end_year) AS y2
      FROM steps WHERE start_year IS NOT NULL GROUP BY question_id, metric_position)""",
    f"""worded AS (SELECT *, CASE WHEN unit = '%' THEN CASE WHEN round(total, 6) >= 0 THEN 'expanded' ELSE 'contracted' END
        ELSE CASE WHEN round(total, 6) >= 0 THEN 'increased' ELSE 'decreased' END END AS verb,
      CASE WHEN unit = '%' THEN {_two('abs(change)')} || ' percentage points'
        ELSE concat('$', {_two('abs(change)')}, 'B (', {_two('abs(growth)')}, '%)') END AS amount,
      concat('FY', big_start, '–FY', big_end, ' (', CASE WHEN unit = '%' THEN {_two('big')} || ' percentage points'
        ELSE concat('$', {_two('big')}, 'B') END, ')') AS span
      FROM changes JOIN spans USING (question_id, metric_position))""",
)
_CAP = "upper(verb[1]) || verb[2:]"
_SENTENCE = f"""'- ' || label || ': ' || CASE
      WHEN n = 1 THEN concat({_CAP}, ' by ', amount, ' from FY', y1, ' to FY', y2)
      WHEN steady THEN concat({_CAP}, ' in every reported interval, with an overall change of ', amount,
        '; the largest annual change was ', span)
      ELSE concat('Varied across the reported intervals, but ', verb, ' by ', amount, ' overall; the largest annual change was ', span)
      END"""
_PLURAL = ", ".join(V.quoted(x) for x in C.PLURAL_LABELS)
_ANSWERS = (
    *_EVIDENCE,
    *_INTERVALS[len(_CHANGES) :],
    "known AS (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0)",
    f"""one AS (SELECT question_id, concat(coalesce(s_name, 'The company'), '’s ', lower(label), ' in FY', fiscal_year,
        CASE WHEN label IN ({_PLURAL}) THEN ' were ' ELSE ' was ' END, {_shown('value')}, ' [F1].') AS body
      FROM figures JOIN shape USING (question_id) LEFT JOIN known ON s_suppkey = entity WHERE n_rows = 1 AND n_metrics = 1)""",
    f"""yearly AS (SELECT question_id, row_position, concat('FY', any_value(fiscal_year), ':', {_NL},
        string_agg('- ' || label || ': ' || {_shown('value')}, {_NL} ORDER BY metric_position)) AS part
      FROM figures GROUP BY question_id, row_position)""",
    f"""listed AS (SELECT question_id, string_agg(part, {_NL} || {_NL} ORDER BY row_position) AS parts FROM yearly GROUP BY question_id)""",
    f"""compared AS (SELECT question_id, concat({_NL}, {_NL}, 'Overall:', {_NL},
        string_agg({_SENTENCE}, {_NL} ORDER BY metric_position)) AS part FROM worded GROUP BY question_id)""",
    f"""answers AS (SELECT question_id, n_rows, n_metrics, evidence, CASE WHEN n_rows = 0 OR n_metrics = 0 THEN evidence ELSE concat(
        coalesce(o.body, concat('Financial results [F1]:', {_NL}, {_NL}, l.parts, c.part)),
        {_NL} || {_NL} || 'References:' || {_NL} || '[F1] ' || s_name || ' Inc. 10-K — Financial Statements, filed 2025-10-31'
          || {_NL} || 'https://example.org/' || entity) END AS answer
      FROM evidence JOIN (SELECT question_id, entity FROM routes WHERE route = 'financial') USING (question_id)
      LEFT JOIN one o USING (question_id) LEFT JOIN listed l USING (question_id) LEFT JOIN compared c USING (question_id)
      LEFT JOIN known ON s_suppkey = entity)""",
)
# questions that need text: explained figures search with expanded wording, risks as they are
_PACKS = (
    f"""sought AS (SELECT question_id, route, CASE WHEN route = 'risk' THEN text ELSE {text_queries._expansion_sql(C.QUERY_EXPANSIONS)} END AS text
      FROM questions JOIN routes USING (question_id) WHERE route = 'risk' OR (route = 'financial' AND explain))""",
    *text_queries._hits_sql("sought"),
    "ends_of AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 6)",
    """filled AS (SELECT question_id, doc_id, retrieval_score, row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id DESC) AS rank
      FROM (SELECT question_id, doc_id, retrieval_score, rank FROM hits
        UNION ALL SELECT question_id, doc_id, 0.0::DOUBLE, 4 FROM sought, ends_of WHERE NOT EXISTS
          (SELECT 1 FROM hits h WHERE h.question_id = sought.question_id AND h.doc_id = ends_of.doc_id))
      QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id DESC) <= 3)""",
    f"""packs AS (SELECT question_id,
        string_agg(concat('[M', rank, '] Item 7. MD&A, retrieved chunk ', doc_id, {_NL}, d.text), {_NL} || {_NL} ORDER BY rank)
          FILTER (route = 'financial') AS context,
        string_agg(concat('[', rank, '] Topic: ', d.source, {_NL}, 'Chunk ID: ', doc_id, {_NL}, 'SEC excerpt:', {_NL}, d.text),
          {_NL} || {_NL} ORDER BY rank) FILTER (route = 'risk') AS evidence
      FROM filled JOIN documents d USING (doc_id) JOIN sought USING (question_id)
      GROUP BY question_id HAVING max(retrieval_score) > 0)""",
)

ORACLES = {
    "question_route": V.ctes(*_READ) + "SELECT question_id, route, explain FROM routes",
    "question_metrics": V.ctes(*_METRICS) + 'SELECT question_id, position, col AS "column", label, unit FROM metrics',
    "question_years": V.ctes(V.QUESTIONS_SQL, *_YEARS) + "SELECT question_id, position, fiscal_year FROM years",
    "question_trend": V.ctes(V.QUESTIONS_SQL, *_TREND) + "SELECT * FROM trends WHERE trend_years IS NOT NULL",
    "conversation_routes": V.ctes(
        """texts AS (SELECT concat(conv_id, ':', turn) AS id, text FROM conversations
          UNION ALL SELECT concat('d', doc_id) AS id, text FROM documents)""",
        f"alias(word) AS (VALUES {V.sql_rows(V.QUESTION_WORDS)})",
        """found AS (SELECT id, string_agg(upper(word), ',' ORDER BY instr(lower(text), word)) AS labels FROM texts, alias
          WHERE contains(lower(text), word) AND NOT (word = 'thing' AND contains(lower(text), 'nothing')) GROUP BY id)""",
    )
    + f"""SELECT id, CASE WHEN {_any_sql(['hehely', 'enung'])} THEN 'risk' WHEN labels IS NOT NULL THEN 'financial'
      ELSE 'unsupported' END AS route, {_any_sql(['ing', 'eau'])} AS explain, coalesce(labels, '') AS labels
      FROM texts LEFT JOIN found USING (id)""",
    "question_figures": V.ctes(*_CHOSEN)
    + "SELECT question_id, entity, row_position, metric_position, fiscal_year, label, unit, value FROM figures",
    "question_changes": V.ctes(*_CHANGES)
    + """SELECT question_id, metric_position, label, first_year, last_year, change, growth, highest_year, lowest_year FROM changes""",
    "question_missing_years": V.ctes(*_EVIDENCE) + "SELECT question_id, fiscal_year FROM missing",
    "evidence_texts": V.ctes(*_EVIDENCE) + "SELECT question_id, evidence FROM evidence",
    "change_sentences": V.ctes(*_INTERVALS)
    + f"SELECT question_id, metric_position, label, {_SENTENCE} AS sentence FROM worded",
    "evidence_parse": V.ctes(*_EVIDENCE)
    + f"""SELECT question_id, kind, fiscal_year, label, value,
        coalesce(TRY_CAST(regexp_extract(replace(value, ',', ''), '-?[0-9]+(\\.[0-9]+)?') AS DOUBLE), 0) AS number FROM (
      SELECT question_id, CASE WHEN n_rows = 1 AND n_metrics = 1 THEN 'single' ELSE 'year' END AS kind, fiscal_year, label,
        {_shown('value')} AS value FROM figures JOIN shape USING (question_id)
      UNION ALL SELECT question_id, 'overall', NULL, label, CASE WHEN unit = '%' THEN {_SIGNED.format('change')} || ' percentage points'
        ELSE concat({_SIGN.format('change')}, '$', {_two('abs(change)')}, 'B') END FROM changes
      UNION ALL SELECT question_id, 'overall', NULL, label || ' growth', {_SIGNED.format('growth')} || '%' FROM changes WHERE unit <> '%'
      UNION ALL SELECT question_id, 'overall', NULL, 'Highest year', 'FY' || CAST(hi AS VARCHAR) FROM ends JOIN shape USING (question_id)
        WHERE n_metrics = 1 AND n_rows > 1
      UNION ALL SELECT question_id, 'overall', NULL, 'Lowest year', 'FY' || CAST(lo AS VARCHAR) FROM ends JOIN shape USING (question_id)
        WHERE n_metrics = 1 AND n_rows > 1)""",
    "single_answers": V.ctes(*_ANSWERS)
    + "SELECT question_id, answer FROM answers WHERE n_rows = 1 AND n_metrics = 1",
    "answer_texts": V.ctes(*_ANSWERS) + "SELECT question_id, answer FROM answers",
    "routed_answers": V.ctes(*_ANSWERS, *_PACKS)
    + f"""SELECT question_id, 'financial' AS route, CASE WHEN context IS NULL THEN answer END AS answer, evidence, context
      FROM (SELECT a.*, CASE WHEN n_rows > 0 THEN p.context END AS context FROM answers a LEFT JOIN packs p USING (question_id))
      UNION ALL SELECT question_id, route, CASE WHEN p.evidence IS NULL THEN {V.quoted(C.NO_EVIDENCE_MESSAGE)} END, p.evidence, NULL
      FROM routes LEFT JOIN packs p USING (question_id) WHERE route = 'risk'
      UNION ALL SELECT question_id, route, concat('This question is outside the scope of ', coalesce(s_name, 'company'),
        ' financial and 10-K risk analysis.'), NULL, NULL
      FROM routes LEFT JOIN known ON s_suppkey = entity WHERE route = 'unsupported'""",
}
