"""Queries over filing text: markup, sections, sentences, chunks, TF-IDF and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions import text as X
from ledgerspark.operators import chunking, generated_text, retrieval, sections, tfidf
from ledgerspark.operators.index import StoredIndex, open_index, store_index
from queries import views as V


def html_text(spark, sf):
    return sections.filing_text(V.table(spark, sf, "pages").select("page_id", "html"))


def html_text_awkward(spark, sf):
    return sections.filing_text(V.awkward_pages(spark, sf))


def _sections(spark, sf) -> DataFrame:
    return sections.extract_sections(sections.filing_text(V.filings(spark, sf)))


def section_extract(spark, sf):
    found = sections.found_sections(_sections(spark, sf))
    return found.select("page_id", "section", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def section_quarantine(spark, sf):
    return sections.quarantined_sections(_sections(spark, sf))


def sentences(spark, sf):
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("position", "sentence"))


def sentences_abbrev(spark, sf):
    """Sentences after a name with full stops is spliced behind every comma."""
    docs = V.table(spark, sf, "documents")
    text = F.replace("text", F.lit(","), F.lit(", Acme Inc. of the U.S. No. 1"))
    return docs.select("doc_id", F.posexplode(X.split_sentences_keeping(text)).alias("position", "sentence"))


def chunks(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_text(docs, overlap=0)


def chunks_overlap(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_text(docs)


def _fit(spark, sf, **options) -> tfidf.TfidfIndex:
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    return tfidf.fit_tfidf(docs, tfidf.TfidfSpec(**options))


_STORED: dict[tuple[str, str], str] = {}


def _index(spark, sf) -> StoredIndex:
    """The documents' index, fitted and stored once per application and folder."""
    key = spark.sparkContext.applicationId, sf
    if key not in _STORED:
        _STORED[key] = store_index(_fit(spark, sf)).path
    return open_index(spark, _STORED[key])


def term_stats(spark, sf):
    index = _fit(spark, sf, min_df=2, max_df=0.95)
    return index.vocabulary.withColumn("idf", F.round("idf", 6))


def tfidf_vectors(spark, sf):
    """Shape of every document vector: terms, largest and total weight, squared length."""
    w = F.col("weight")
    return _index(spark, sf).weights.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"),
        F.round(F.max(w), 6).alias("largest"),
        F.round(F.sum(w), 6).alias("total"),
        F.round(F.sum(w * w), 6).alias("squared"),
    )


def tfidf_by_source(spark, sf):
    """Separate corpora per source: frequencies are taken within each of them."""
    docs = V.table(spark, sf, "documents").select("source", "doc_id", "text")
    index = tfidf.fit_tfidf(docs, tfidf.TfidfSpec(scope=("source",)))
    return index.weights.groupBy("source", "doc_id").agg(
        F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("largest")
    )


def retrieve_topk(spark, sf):
    queries = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return retrieval.retrieve(queries, _index(spark, sf))


def retrieve_conversations(spark, sf):
    """Every user turn of every conversation as a question."""
    turns = V.table(spark, sf, "conversations").filter(F.col("role") == "user")
    queries = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    return retrieval.retrieve(queries, _index(spark, sf))


def query_expansion(spark, sf):
    return V.questions(spark, sf).select("question_id", retrieval.expand_query(F.col("text")).alias("expanded"))


EXPANSIONS = {"thatin": "thing hehely", "mente": "ciónue asción", "nicht": "enung"}


def _expanded_hits(spark, sf) -> DataFrame:
    queries = V.questions(spark, sf).select("question_id", "text")
    return retrieval.retrieve(queries, _index(spark, sf), expand=EXPANSIONS)


def retrieve_expanded(spark, sf):
    return _expanded_hits(spark, sf)


def retrieve_padded(spark, sf):
    """Three documents for every question, whether they share a term or not."""
    docs = V.table(spark, sf, "documents").select("doc_id")
    return retrieval.pad_hits(_expanded_hits(spark, sf), V.questions(spark, sf), docs)


def padded_context(spark, sf):
    """Explanations with three blocks each, fillers included, as long as one block scores."""
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    asked = V.questions(spark, sf).select("question_id", F.col("text").alias("question"))
    hits = retrieval.attach_documents(retrieve_padded(spark, sf).join(asked, "question_id"), docs)
    packs = retrieval.mda_context(hits, chunk_id="doc_id")
    return packs.select("question_id", "best_score", F.md5("context").alias("digest"))


def evidence_context(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    asked = V.questions(spark, sf).select("question_id", F.col("text").alias("question"))
    hits = retrieval.attach_documents(_expanded_hits(spark, sf).join(asked, "question_id"), docs)
    packs = retrieval.mda_context(hits, chunk_id="doc_id")
    return packs.select("question_id", "best_score", F.md5("context").alias("digest"))


def risk_evidence_pack(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("topic_label"), "text")
    queries = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    hits = retrieval.attach_documents(retrieval.retrieve(queries, _index(spark, sf)), docs)
    packs = retrieval.risk_evidence(hits, chunk_id="doc_id")
    return packs.select("question_id", "best_score", F.md5("evidence").alias("digest"))


def evidence_preview(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "source", "text")
    queries = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    hits = retrieval.attach_documents(retrieval.retrieve(queries, _index(spark, sf)), docs)
    return retrieval.evidence_preview(hits).select("question_id", "rank", "doc_id", "retrieval_score", "preview")


# an answer as a generator might leave it: bold marks, a table, glued words, blank lines
_ANSWER = r"""concat('**Summary:**\n', text, ' orforce[1].\n\n\n\n# Key risks:\n- **Label:** up5 or 3Bmore and 7%less[M2].\n',
  '| Fiscal Year | Value |\n|---|:-:|\n| FY2024 | ', turn, ' | |\n|x\n   \n', text, '.Next[F1]\n\n---\n\n')"""
_ANSWER_SQL = _ANSWER.replace("\\n", "' || chr(10) || '")


def _answers(spark, sf) -> DataFrame:
    turns = V.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return turns.select("conv_id", "turn", F.expr(_ANSWER).alias("raw"))


def clean_text(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", generated_text.clean_generated_text(F.col("raw")).alias("cleaned"))


def citations_used(spark, sf):
    """Which of four labels each answer cites; the label set varies with the turn."""
    labels = F.concat(retrieval.citation_labels(2), retrieval.citation_labels(2, "M"), retrieval.citation_labels(1, "F"))
    raw = F.when(F.col("turn") % 4 == 1, F.replace("raw", F.lit("[M2]"), F.lit("[2]"))).otherwise(F.col("raw"))
    return _answers(spark, sf).select("conv_id", "turn", F.array_join(retrieval.cited_labels(raw, labels), " ").alias("cited"))


def _known_regions(spark, sf) -> DataFrame:
    """Filings by region; one in five isn't known."""
    return V.table(spark, sf, "region").filter("r_regionkey <> 4").select(
        F.col("r_regionkey").cast("bigint").alias("filing_id"),
        F.col("r_name").alias("company"),
        F.lit("10-K").alias("form"),
        F.lit("2025-10-31").alias("filing_date"),
        F.concat(F.lit("https://example.org/"), F.col("r_regionkey").cast("string")).alias("source_url"),
    )


def explained_references(spark, sf):
    """References of figures explained with the second and, for some, the first and an unknown block."""
    items = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    cites = F.when(F.col("question_id") % 3 == 0, F.lit(" [M2] [F1]")).otherwise(F.lit(" [M1] [M2][M7]"))
    answers = items.select("question_id", (F.col("question_id") % 5).alias("filing_id"), F.concat("text", cites).alias("answer"))
    found = retrieval.explained_references(answers, retrieval.retrieve(items, _index(spark, sf)), _known_regions(spark, sf))
    return found.select("question_id", "reference_lines", F.md5("referenced_answer").alias("digest"))


def reference_lines(spark, sf):
    """References of answers built from benchmark texts that cite the first and third hit."""
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_title"), "text")
    items = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    hits = retrieval.attach_documents(retrieval.retrieve(items, _index(spark, sf)), docs)
    answers = items.select(
        "question_id",
        (F.col("question_id") % 5).alias("filing_id"),
        F.concat("text", F.when(F.col("question_id") % 3 == 0, F.lit(" [1]")).otherwise(F.lit(" [3] [1]"))).alias("answer"),
    )
    return retrieval.reference_list(answers, hits, _known_regions(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        html_text,
        html_text_awkward,
        section_extract,
        section_quarantine,
        sentences,
        sentences_abbrev,
        chunks,
        chunks_overlap,
        term_stats,
        tfidf_vectors,
        tfidf_by_source,
        retrieve_topk,
        retrieve_conversations,
        query_expansion,
        retrieve_expanded,
        retrieve_padded,
        padded_context,
        evidence_context,
        risk_evidence_pack,
        evidence_preview,
        clean_text,
        citations_used,
        reference_lines,
        explained_references,
    )
}

# --- SQL -------------------------------------------------------------------------------------------


def _headings_sql(section: int, heading: str, marker: str, end: str) -> str:
    """Positions of a section: the texts behind each heading, first whose next 500 characters hold the marker."""
    name = C.SECTION_SPECS[section][0]
    n = len(heading)
    return f"""SELECT page_id, '{name}' AS section, text, lower(text) AS low,
      string_split(lower(text), '{heading}') AS parts, {n} AS n, '{marker}' AS marker, '{end}' AS stop FROM plain"""


_HEADINGS = [
    ("item 1a. risk factors", C.SECTION_SPECS[0][2], "item 1b. unresolved staff comments"),
    (
        "item 7. management’s discussion and analysis of financial condition and results of operations",
        C.SECTION_SPECS[1][2],
        "item 7a. quantitative and qualitative disclosures about market risk",
    ),
]
_SECTIONS = V.ctes(
    V.FILINGS_SQL,
    f"plain AS ({V.text_sql('filings')})",
    "split AS (" + " UNION ALL ".join(_headings_sql(i, *h) for i, h in enumerate(_HEADINGS)) + ")",
    """places AS (SELECT page_id, section, text, low, n, stop, marker,
      unnest(list_transform(range(1, len(parts)),
        lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * n + 1)) AS start FROM split
      UNION ALL SELECT page_id, section, text, low, n, stop, marker, NULL FROM split)""",
    """chosen AS (SELECT page_id, section, any_value(text) AS text, any_value(low) AS low, any_value(n) AS n,
      any_value(stop) AS stop,
      CAST(min(CASE WHEN contains(substr(low, CAST(start + n AS BIGINT), 500), marker) THEN start END) AS BIGINT) AS start
      FROM places GROUP BY page_id, section)""",
    """bounds AS (SELECT *, CASE WHEN start IS NULL THEN 0 ELSE instr(substr(low, start + n), stop) END AS skip FROM chosen)""",
    """cut AS (SELECT page_id, section, CASE WHEN skip > 0 THEN trim(substr(text, start, n + skip - 1)) END AS text,
      CASE WHEN start IS NULL THEN 'heading not found' WHEN skip = 0 THEN 'end of section not found' END AS reason FROM bounds)""",
)

_DOC_WORDS = (V.words_sql("words", "documents", "doc_id"), V.counts_sql("tf", "words", "doc_id"))
_SIZE = "(SELECT count(*) FROM documents)"


def _weights_sql(counts: str = "tf") -> tuple[str, ...]:
    return (
        f"df AS (SELECT term, count(*) AS df, ln((1 + {_SIZE}) / (1 + count(*))) + 1 AS idf FROM {counts} GROUP BY term)",
        f"raw AS (SELECT doc_id, term, tf * idf AS w FROM {counts} JOIN df USING (term))",
        "weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)",
    )


def _hits_sql(source: str) -> tuple[str, ...]:
    """hits(question_id, rank, doc_id, retrieval_score) for a source of (question_id, text)."""
    return (
        V.words_sql("words", "documents", "doc_id"),
        V.counts_sql("tf", "words", "doc_id"),
        *_weights_sql(),
        V.words_sql("qwords", source, "question_id"),
        V.counts_sql("qtf", "qwords", "question_id"),
        "qraw AS (SELECT question_id, term, tf * idf AS w FROM qtf JOIN df USING (term))",
        "qweights AS (SELECT question_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS w FROM qraw)",
        """scores AS (SELECT question_id, doc_id, sum(q.w * d.w) AS score FROM qweights q JOIN weights d USING (term)
          GROUP BY question_id, doc_id)""",
        """hits AS (SELECT question_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS retrieval_score FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 10) DESC, doc_id DESC) AS rank
          FROM scores) WHERE rank <= 3)""",
    )


_ITEMS = "items AS (SELECT item_id AS question_id, text FROM benchmark)"
_TURNS = "turns AS (SELECT conv_id * 1000 + turn AS question_id, text FROM conversations WHERE role = 'user')"


def _expansion_sql(expansions) -> str:
    spaced = "regexp_replace(text, '([A-Za-z])([0-9])', '\\1 \\2', 'g')"
    extra = ", ".join(f"CASE WHEN contains(lower({spaced}), '{w}') THEN '{t}' END" for w, t in expansions.items())
    return f"concat_ws(' ', {spaced}, {extra})"


_EXPANDED = (
    V.QUESTIONS_SQL,
    f"asked AS (SELECT question_id, {_expansion_sql(EXPANSIONS)} AS text FROM questions)",
    *_hits_sql("asked"),
)
_PADDED = (
    *_EXPANDED,
    "ends AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 6)",
    """free AS (SELECT question_id, doc_id FROM questions, ends WHERE NOT EXISTS (SELECT 1 FROM hits h
      WHERE h.question_id = questions.question_id AND h.doc_id = ends.doc_id))""",
    """padded AS (SELECT question_id, doc_id, retrieval_score, CAST(place AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, doc_id DESC) AS place FROM (
        SELECT question_id, doc_id, retrieval_score, rank FROM hits
        UNION ALL SELECT question_id, doc_id, 0.0::DOUBLE, 4 FROM free)) WHERE place <= 3)""",
)
_EXPLAIN = " OR ".join(f"contains(lower(text), '{t}')" for t in C.EXPLANATION_TERMS)

_CONTEXT = f"""SELECT question_id, max(retrieval_score) AS best_score,
      md5(string_agg(concat('[M', rank, '] Item 7. MD&A, retrieved chunk ', doc_id, chr(10), d.text), chr(10) || chr(10) ORDER BY rank)) AS digest
      FROM {{hits}} JOIN documents d USING (doc_id) JOIN (SELECT question_id FROM questions WHERE {_EXPLAIN}) USING (question_id)
      GROUP BY question_id HAVING max(retrieval_score) > 0"""


def _packed_chunks_sql(overlap: bool) -> str:
    """Greedy packing, one sentence per step of a recursion over all documents at once."""
    carry = "last || ' ' || parts[i + 1]" if overlap else "parts[i + 1]"
    return V.ctes(
        V.SENTENCES_SQL,
        f"""packed AS (
          SELECT doc_id, parts, 1 AS i, 1 AS chunk_id, parts[1] AS cur, parts[1] AS last FROM sentences
          UNION ALL
          SELECT doc_id, parts, i + 1,
            CASE WHEN length(cur) + 1 + length(parts[i + 1]) > 1500 THEN chunk_id + 1 ELSE chunk_id END,
            CASE WHEN length(cur) + 1 + length(parts[i + 1]) > 1500 THEN {carry} ELSE cur || ' ' || parts[i + 1] END,
            parts[i + 1]
          FROM packed WHERE i < len(parts))""",
    ) + "SELECT doc_id, chunk_id, arg_max(cur, i) AS text FROM packed GROUP BY doc_id, chunk_id"


_SPACED = "replace(raw, 'orforce', 'or force')"
for _pattern, _to in (
    ("([.!?])([A-Z])", "\\1 \\2"),
    ("([^\\s])(\\[(?:F|M)?[0-9]+\\])", "\\1 \\2"),
    ("\\b(up|down)([0-9])", "\\1 \\2"),
    ("([0-9][BM])([A-Za-z])", "\\1 \\2"),
    ("%([A-Za-z])", "% \\1"),
):
    _SPACED = f"regexp_replace({_SPACED}, '{_pattern}', '{_to}', 'g')"
_CLEAN = V.ctes(
    f"answers AS (SELECT conv_id, turn, {_ANSWER_SQL} AS raw FROM conversations WHERE role = 'assistant')",
    f"lines AS (SELECT conv_id, turn, string_split({_SPACED}, chr(10)) AS parts FROM answers)",
    """line AS (SELECT conv_id, turn, generate_subscripts(parts, 1) AS i, replace(trim(unnest(parts)), '**', '') AS line FROM lines)""",
    """cells AS (SELECT *, list_transform(string_split(regexp_replace(line, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c)) AS c FROM line)""",
    """shown AS (SELECT conv_id, turn, i, line = '' AS blank, CASE WHEN line = '' THEN ''
        WHEN contains(line, '|') AND len(c) >= 2 THEN c[1] || ': ' || array_to_string(list_filter(c[2:], lambda x: x <> ''), ', ')
        ELSE regexp_replace(line, '^[# ]+', '') END AS out FROM cells
      WHERE line = '' OR NOT (regexp_full_match(line, '\\|?[\\s:|-]+\\|?')
        OR (contains(line, '|') AND lower(c[1]) IN ('year', 'fiscal year'))))""",
    """kept AS (SELECT * FROM (SELECT *, lag(out) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM shown)
      WHERE NOT blank OR coalesce(before, '') <> '')""",
)

ORACLES = {
    "html_text": V.text_sql("pages"),
    "html_text_awkward": V.AWKWARD_SQL,
    "section_extract": _SECTIONS
    + "SELECT page_id, section, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM cut WHERE reason IS NULL",
    "section_quarantine": _SECTIONS + "SELECT page_id, section, reason FROM cut WHERE reason IS NOT NULL",
    "sentences": V.ctes(V.SENTENCES_SQL)
    + """SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position, unnest(parts) AS sentence FROM sentences""",
    "sentences_abbrev": """SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position,
      replace(replace(replace(unnest(parts), '<U>', 'U.S.'), '<I>', 'Inc.'), '<N>', 'No.') AS sentence
      FROM (SELECT doc_id, string_split(regexp_replace(replace(replace(replace(replace(text, ',', ', Acme Inc. of the U.S. No. 1'),
        'U.S.', '<U>'), 'Inc.', '<I>'), 'No.', '<N>'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)""",
    "chunks": _packed_chunks_sql(False),
    "chunks_overlap": _packed_chunks_sql(True),
    "term_stats": V.ctes(*_DOC_WORDS)
    + f"""SELECT term, count(*) AS df, round(ln((1 + {_SIZE}) / (1 + count(*))) + 1, 6) AS idf FROM tf GROUP BY term
      HAVING count(*) >= 2 AND count(*) <= {_SIZE} * 0.95::DOUBLE""",
    "tfidf_vectors": V.ctes(*_DOC_WORDS, *_weights_sql())
    + """SELECT doc_id, count(*) AS n_terms, round(max(w), 6) AS largest, round(sum(w), 6) AS total,
      round(sum(w * w), 6) AS squared FROM weights GROUP BY doc_id""",
    "tfidf_by_source": V.ctes(
        *_DOC_WORDS,
        "sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source)",
        "placed AS (SELECT source, doc_id, term, tf, n FROM tf JOIN documents USING (doc_id) JOIN sized USING (source))",
        "raw AS (SELECT *, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY source, term))) + 1) AS w FROM placed)",
        "weights AS (SELECT source, doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)",
    )
    + "SELECT source, doc_id, count(*) AS n_terms, round(max(w), 6) AS largest FROM weights GROUP BY source, doc_id",
    "retrieve_topk": V.ctes(_ITEMS, *_hits_sql("items")) + "SELECT question_id, rank, doc_id, retrieval_score FROM hits",
    "retrieve_conversations": V.ctes(_TURNS, *_hits_sql("turns"))
    + "SELECT question_id, rank, doc_id, retrieval_score FROM hits",
    "query_expansion": V.ctes(V.QUESTIONS_SQL)
    + f"SELECT question_id, {_expansion_sql(C.QUERY_EXPANSIONS)} AS expanded FROM questions",
    "retrieve_expanded": V.ctes(*_EXPANDED) + "SELECT question_id, rank, doc_id, retrieval_score FROM hits",
    "retrieve_padded": V.ctes(*_PADDED) + "SELECT question_id, rank, doc_id, retrieval_score FROM padded",
    "padded_context": V.ctes(*_PADDED) + _CONTEXT.format(hits="padded"),
    "evidence_context": V.ctes(*_EXPANDED) + _CONTEXT.format(hits="hits"),
    "risk_evidence_pack": V.ctes(_ITEMS, *_hits_sql("items"))
    + """SELECT question_id, max(retrieval_score) AS best_score,
      md5(string_agg(concat('[', rank, '] Topic: ', d.source, chr(10), 'Chunk ID: ', doc_id, chr(10), 'SEC excerpt:', chr(10), d.text),
        chr(10) || chr(10) ORDER BY rank)) AS digest
      FROM hits JOIN documents d USING (doc_id) GROUP BY question_id HAVING max(retrieval_score) > 0""",
    "evidence_preview": V.ctes(_ITEMS, *_hits_sql("items"))
    + "SELECT question_id, rank, doc_id, retrieval_score, substr(d.text, 1, 500) AS preview FROM hits JOIN documents d USING (doc_id)",
    "clean_text": _CLEAN
    + """SELECT conv_id, turn, trim(string_agg(out, chr(10) ORDER BY i), ' ' || chr(10)) AS cleaned FROM kept GROUP BY conv_id, turn""",
    "citations_used": """SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '[1] [2] [F1]' ELSE '[1] [M2] [F1]' END AS cited
      FROM conversations WHERE role = 'assistant'""",
    "reference_lines": V.ctes(_ITEMS, *_hits_sql("items"))
    + """, known AS (SELECT * FROM region WHERE r_regionkey <> 4),
      cited AS (SELECT question_id, string_agg(concat_ws(' — ', concat_ws(' ', '[' || rank || ']', r_name || ' 10-K'), d.source),
          chr(10) ORDER BY rank) AS lines
        FROM hits JOIN documents d USING (doc_id) LEFT JOIN known ON r_regionkey = question_id % 5
        WHERE rank = 1 OR (rank = 3 AND question_id % 3 <> 0) GROUP BY question_id)
      SELECT question_id, coalesce(lines, '') AS reference_lines,
        r_name || ' 10-K, filed 2025-10-31' || chr(10) || 'https://example.org/' || r_regionkey AS filing_source
      FROM items LEFT JOIN known ON r_regionkey = question_id % 5 LEFT JOIN cited USING (question_id)""",
    "explained_references": V.ctes(_ITEMS, *_hits_sql("items"))
    + f""", known AS (SELECT * FROM region WHERE r_regionkey <> 4),
      ranks AS (SELECT question_id, max(rank) AS n FROM hits GROUP BY question_id),
      lined AS (SELECT question_id, r_regionkey, text || CASE WHEN question_id % 3 = 0 THEN ' [M2] [F1]' ELSE ' [M1] [M2][M7]' END AS answer,
        concat(concat_ws(' ', '[F1]', r_name || ' 10-K'), ' — {C.STATEMENTS_TITLE}', CASE WHEN r_name IS NULL THEN '' ELSE ', filed 2025-10-31' END,
          CASE WHEN question_id % 3 <> 0 AND n >= 1 THEN concat(chr(10), concat_ws(' ', '[M1]', r_name || ' 10-K'), ' — {C.MDA_TITLE}') ELSE '' END,
          CASE WHEN n >= 2 THEN concat(chr(10), concat_ws(' ', '[M2]', r_name || ' 10-K'), ' — {C.MDA_TITLE}') ELSE '' END) AS reference_lines
        FROM items LEFT JOIN known ON r_regionkey = question_id % 5 LEFT JOIN ranks USING (question_id))
      SELECT question_id, reference_lines, md5(concat_ws(chr(10), answer || chr(10) || chr(10) || '{C.REFERENCES_HEADING}', reference_lines,
        'https://example.org/' || r_regionkey)) AS digest FROM lined""",
}
