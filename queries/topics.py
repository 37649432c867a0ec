"""Queries over topics: factorisation, labels, excerpts and theme summaries.

The shared documents are written in four invented languages, which stand in for themes: anchors
are frequent words of each, components are term counts per language.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.functions import text as X
from ledgerspark.functions.binding import bind
from ledgerspark.operators import topics
from ledgerspark.operators.nmf import NmfModel
from ledgerspark.plans.filing_text import RISK_SECTION, label_chunks, section_chunks, topic_model
from ledgerspark.sources.tables import scratch_table, with_display_fallbacks
from queries import text as text_queries
from queries import views as V

LANGUAGES = ["es", "en", "fr", "de"]
LABELS = {1: "Theme en", 2: "Theme fr", 3: "Theme de", 4: "Theme es"}
ANCHORS = {
    1: ("thatin", "ononst", "hehely", "thing", "erble"),
    2: ("ément", "éelle", "étion", "oueau", "outre"),
    3: ("nicht", "ersch", "belich", "enung", "erkeit"),
    4: ("mente", "ciónue", "ciónas", "asción", "thing"),
}
# what topic_assign finds on this data; the classification queries take it as given
ASSIGNMENT = {0: 4, 1: 1, 2: 2, 3: 3}


def _documents(spark, sf) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", "lang", "text")


def _components(spark, sf) -> DataFrame:
    """(term, weights): occurrences of each word per language."""
    words = _documents(spark, sf).select("lang", F.explode(X.tokens(F.col("text"))).alias("term"))
    counts = [F.count_if(F.col("lang") == lang).cast("double") for lang in LANGUAGES]
    return words.groupBy("term").agg(F.array(*counts).alias("weights"))


def topic_score_table(spark, sf):
    return topics.topic_scores(_components(spark, sf), ANCHORS)


def topic_assign(spark, sf):
    return topics.assign_topics(topic_score_table(spark, sf), tuple(LABELS))


def topic_top_terms(spark, sf):
    return topics.top_terms(_components(spark, sf))


def _weighted(documents) -> DataFrame:
    """Documents with one weight per component: occurrences of its theme's anchors."""
    count = lambda low, i: sum((X.count_occurrences(low, F.lit(a)) for a in ANCHORS[ASSIGNMENT[i]]), F.lit(0))
    weights = bind(F.lower("text"), lambda low: F.array(*[count(low, i).cast("double") for i in range(len(LANGUAGES))]))
    return documents.select("doc_id", "text", weights.alias("weights"))


def _classified(spark, sf) -> DataFrame:
    return _classify(_documents(spark, sf))


def _classify(documents) -> DataFrame:
    return topics.classify_chunks(_weighted(documents), ASSIGNMENT, LABELS, ANCHORS)


def chunk_topics(spark, sf):
    return _classified(spark, sf).drop("text", "excerpt")


def topic_excerpt(spark, sf):
    return _classified(spark, sf).select("doc_id", "excerpt")


def footer_removal(spark, sf):
    """Page footers spliced in behind every line end, then removed again."""
    footer = F.lit(" Acme Inc. | 2025 Form 10-K | 17\n")
    text = F.replace("text", F.lit("\n"), footer)
    cleaned = topics.remove_page_footers(text, "Acme Inc.")
    return _documents(spark, sf).select("doc_id", F.md5(cleaned).alias("digest"))


def theme_summary(spark, sf):
    return topics.theme_summary(_classified(spark, sf)).withColumn("average_score", F.round("average_score", 6))


def theme_totals(spark, sf):
    return topics.theme_totals(_classified(spark, sf))


def theme_best_excerpt(spark, sf):
    """Excerpts are made for the themes' best documents only, once these are known."""
    best = scratch_table(topics.best_chunks(_classified(spark, sf), "doc_id"))
    winners = _documents(spark, sf).join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi")
    return topics.best_excerpts(_classify(winners), "doc_id", best)


def theme_chunks(spark, sf):
    """One theme's chunks from a table in the older layout, without display label and excerpt."""
    older = with_display_fallbacks(_classified(spark, sf).drop("display_topic_label", "excerpt"))
    return older.filter(F.col("display_topic_label") == LABELS[2]).select("doc_id", "topic_score", F.md5("excerpt").alias("digest"))


def topic_representative(spark, sf):
    return topics.representative_chunks(_weighted(_documents(spark, sf)), "doc_id")


_MODELS: dict[tuple[str, str], NmfModel] = {}


def _model(spark, sf):
    """The topic model of the whole corpus with the operator's defaults, fitted once per application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _MODELS:
        _MODELS[key] = topic_model(_documents(spark, sf).select("doc_id", "text"), doc_id="doc_id")
    return _MODELS[key]


def topic_model_shape(spark, sf):
    """What holds of every whole fit: sizes of the factors, signs, falling losses, an optimum reached."""
    model = _model(spark, sf)
    lowest = F.array_min("weights")
    widths = lambda rows: rows.agg(F.min(F.size("weights")), F.max(F.size("weights")), F.count_if(lowest < 0), F.count("*")).first()
    chunks, terms = widths(model.chunks), widths(model.components)
    rising = sum(after > before + 1e-9 * before for before, after in zip(model.losses, model.losses[1:]))
    rows = [
        ("chunks with terms", chunks[3]),
        ("terms", terms[3]),
        ("smallest number of components", min(chunks[0], terms[0])),
        ("largest number of components", max(chunks[1], terms[1])),
        ("rows with a negative weight", chunks[2] + terms[2]),
        ("sweeps with a higher loss", rising),
        ("fits that reached their tolerance", int(model.converged)),
        # unit vectors: nothing explained would leave one per chunk
        ("share of the chunks' squares explained, rounded up", math.ceil(1 - model.losses[-1] / chunks[3])),
    ]
    return spark.createDataFrame(rows, "invariant string, value bigint")


def topic_model_components(spark, sf):
    """Each component's heaviest term and the number of chunks it is strongest in."""
    model = _model(spark, sf)
    heads = topics.top_terms(model.components, 1).select("component", F.col("term").alias("head"))
    chunks = model.chunks.select(topics.strongest(F.col("weights"))["index"].alias("component"))
    sizes = chunks.groupBy("component").agg(F.count("*").alias("chunks"))
    return heads.join(sizes, "component", "left")


def filing_topics(spark, sf):
    """Filings to sections, chunks, a fitted model and labelled chunks, in one job.

    Which theme a chunk gets depends on the fit; that it has one, and that its status follows from its
    share, does not. The model is fitted to a hundredth here; ``topic_model_shape`` has the whole fit.
    """
    key = F.concat_ws(":", "page_id", "chunk_id").alias("chunk_key")
    chunks = scratch_table(section_chunks(V.filings(spark, sf), RISK_SECTION, 0).select("page_id", "chunk_id", key, "text"))
    labelled = label_chunks(chunks, topic_model(chunks, doc_id="chunk_key", tolerance=0.01), "chunk_key")
    low = F.col("topic_share") < C.LOW_CONFIDENCE_SHARE
    shown = F.when(low, F.lit(C.MIXED_TOPIC_LABEL)).otherwise(F.col("topic_label"))
    sound = (
        F.col("topic_label").isin(*C.TOPIC_LABELS.values())
        & (F.col("display_topic_label") == shown)
        & (F.col("classification_status") == F.when(low, F.lit("review")).otherwise(F.lit("confident")))
        & (F.length("excerpt") > 0)
    )
    # a share is rounded for display only, so one beside the limit may be shown on its other side
    edge = F.abs(F.col("topic_share") - C.LOW_CONFIDENCE_SHARE) <= 0.0001
    return labelled.select("page_id", "chunk_id", F.md5("text").alias("digest"), (sound | edge).alias("labelled"))


QUERIES = {
    f.__name__: f
    for f in (
        topic_score_table,
        topic_assign,
        topic_top_terms,
        chunk_topics,
        topic_excerpt,
        footer_removal,
        theme_summary,
        theme_totals,
        theme_best_excerpt,
        theme_chunks,
        topic_representative,
        topic_model_shape,
        topic_model_components,
        filing_topics,
    )
}

# --- SQL -------------------------------------------------------------------------------------------

_ANCHOR_ROWS = ", ".join(f"({t}, {V.quoted(w)})" for t, words in ANCHORS.items() for w in words)
_ANCHOR_CTE = f"anchors(topic_id, word) AS (VALUES {_ANCHOR_ROWS})"
_LANG_CTE = "langs(component, lang) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LANGUAGES)) + ")"
_TERMS = (
    V.words_sql("words", "(SELECT doc_id, lang, text FROM documents)", "lang"),
    "terms AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(words) AS term FROM words) GROUP BY ALL)",
    _LANG_CTE,
    _ANCHOR_CTE,
)
_SCORES = (
    *_TERMS,
    """scores AS (SELECT CAST(component AS INTEGER) AS component, CAST(topic_id AS INTEGER) AS topic_id,
      CAST(coalesce(sum(n), 0) AS DOUBLE) AS score FROM (SELECT component, topic_id, word, lang FROM anchors, langs
        WHERE word IN (SELECT term FROM terms)) a
      LEFT JOIN terms t ON t.term = a.word AND t.lang = a.lang GROUP BY ALL)""",
)
_LABEL_CASE = "CASE topic_id " + " ".join(f"WHEN {t} THEN '{x}'" for t, x in LABELS.items()) + " END"
_COMPONENT_CASE = "CASE topic_id " + " ".join(f"WHEN {t} THEN {c}" for c, t in ASSIGNMENT.items()) + " END"
_COUNT = "(length({0}) - length(replace({0}, word, ''))) // length(word)"
_CLASSIFIED = (
    _ANCHOR_CTE,
    f"""hits AS (SELECT doc_id, topic_id, {_COMPONENT_CASE} AS component, CAST(sum({_COUNT.format('lower(text)')}) AS DOUBLE) AS score
      FROM documents, anchors GROUP BY doc_id, topic_id)""",
    """best AS (SELECT *, sum(score) OVER (PARTITION BY doc_id) AS total,
      row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, component) AS n FROM hits)""",
    f"""labelled AS (SELECT doc_id, CAST(topic_id AS INTEGER) AS topic_id, {_LABEL_CASE} AS topic_label, score AS topic_score,
      CASE WHEN total = 0 THEN 0 ELSE score / total END AS share FROM best WHERE n = 1)""",
    f"""classified AS (SELECT doc_id, topic_id, topic_label, topic_score, round(share, 4) AS topic_share,
      CASE WHEN share < 0.5 THEN 'review' ELSE 'confident' END AS classification_status,
      CASE WHEN share < 0.5 THEN '{C.MIXED_TOPIC_LABEL}' ELSE topic_label END AS display_topic_label FROM labelled)""",
)
_EXCERPTS = (
    *_CLASSIFIED,
    """marked AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'),
      '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)""",
    "sent AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM marked)",
    f"""counted AS (SELECT doc_id, s, i, CAST(sum({_COUNT.format('lower(s)')}) AS BIGINT) AS n FROM sent
      JOIN classified USING (doc_id) JOIN anchors USING (topic_id) GROUP BY doc_id, s, i)""",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS place FROM counted)",
    """excerpts AS (SELECT doc_id, CASE WHEN max(n) > 0
        THEN string_agg(trim(s), ' ' ORDER BY i) FILTER (WHERE place <= 4 AND n > 0)
        ELSE string_agg(trim(s), ' ' ORDER BY i) FILTER (WHERE i <= 4) END AS excerpt FROM placed GROUP BY doc_id)""",
)

ORACLES = {
    "topic_score_table": V.ctes(*_SCORES) + "SELECT * FROM scores",
    "topic_assign": V.ctes(
        *_SCORES,
        """perms AS (SELECT a.topic_id AS t0, b.topic_id AS t1, c.topic_id AS t2, d.topic_id AS t3
          FROM (SELECT DISTINCT topic_id FROM anchors) a, (SELECT DISTINCT topic_id FROM anchors) b,
            (SELECT DISTINCT topic_id FROM anchors) c, (SELECT DISTINCT topic_id FROM anchors) d
          WHERE a.topic_id NOT IN (b.topic_id, c.topic_id, d.topic_id) AND b.topic_id NOT IN (c.topic_id, d.topic_id)
            AND c.topic_id <> d.topic_id)""",
        """totals AS (SELECT t0, t1, t2, t3, sum(score) AS total FROM perms JOIN scores ON
          (component = 0 AND topic_id = t0) OR (component = 1 AND topic_id = t1) OR (component = 2 AND topic_id = t2)
          OR (component = 3 AND topic_id = t3) GROUP BY ALL ORDER BY total DESC, t0, t1, t2, t3 LIMIT 1)""",
    )
    + """SELECT CAST(component AS INTEGER) AS component, CAST(topic_id AS INTEGER) AS topic_id FROM (
      SELECT 0 AS component, t0 AS topic_id FROM totals UNION ALL SELECT 1, t1 FROM totals
      UNION ALL SELECT 2, t2 FROM totals UNION ALL SELECT 3, t3 FROM totals)""",
    "topic_top_terms": V.ctes(*_TERMS)
    + """SELECT term, CAST(component AS INTEGER) AS component, CAST(n AS DOUBLE) AS weight, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, term) AS rank FROM terms JOIN langs USING (lang))
      WHERE rank <= 8""",
    "chunk_topics": V.ctes(*_CLASSIFIED) + "SELECT * FROM classified",
    "topic_excerpt": V.ctes(*_EXCERPTS) + "SELECT doc_id, excerpt FROM excerpts",
    "footer_removal": """SELECT doc_id, md5(regexp_replace(replace(text, chr(10), ' Acme Inc. | 2025 Form 10-K | 17' || chr(10)),
      'Acme Inc\\. \\| [0-9]{4} Form 10-K \\| [0-9]+', '', 'g')) AS digest FROM documents""",
    "theme_summary": V.ctes(*_CLASSIFIED)
    + """SELECT display_topic_label AS topic_label, count(*) AS chunk_count, round(avg(topic_score), 6) AS average_score
      FROM classified GROUP BY display_topic_label""",
    "theme_totals": V.ctes(*_CLASSIFIED)
    + f"""SELECT CAST(sum(n) AS BIGINT) AS chunk_total, count(*) FILTER (WHERE label <> '{C.MIXED_TOPIC_LABEL}') AS theme_count,
      bool_or(label = '{C.MIXED_TOPIC_LABEL}') AS has_review_group, max(n) AS largest_theme
      FROM (SELECT display_topic_label AS label, count(*) AS n FROM classified GROUP BY ALL)""",
    "theme_best_excerpt": V.ctes(*_EXCERPTS)
    + f"""SELECT display_topic_label, doc_id, CASE WHEN display_topic_label = '{C.MIXED_TOPIC_LABEL}'
        THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE excerpt END AS excerpt
      FROM (SELECT * FROM classified QUALIFY row_number() OVER (PARTITION BY display_topic_label
        ORDER BY topic_score DESC, doc_id) = 1) JOIN excerpts USING (doc_id) JOIN documents USING (doc_id)""",
    "theme_chunks": V.ctes(*_CLASSIFIED)
    + f"""SELECT doc_id, topic_score, md5(text) AS digest FROM classified JOIN documents USING (doc_id)
      WHERE topic_label = '{LABELS[2]}'""",
    "topic_model_shape": V.ctes(
        V.words_sql("words", "documents", "doc_id"),
        V.counts_sql("tf", "words", "doc_id"),
        """kept AS (SELECT term FROM tf GROUP BY term
          HAVING count(*) >= 2 AND count(*) <= (SELECT count(*) FROM documents) * 0.95::DOUBLE)""",
    )
    + f"""SELECT 'chunks with terms' AS invariant, count(DISTINCT doc_id) AS value FROM tf JOIN kept USING (term)
      UNION ALL SELECT 'terms', count(*) FROM kept
      UNION ALL VALUES ('smallest number of components', {len(C.TOPIC_LABELS)}), ('largest number of components', {len(C.TOPIC_LABELS)}),
        ('rows with a negative weight', 0), ('sweeps with a higher loss', 0), ('fits that reached their tolerance', 1),
        ('share of the chunks'' squares explained, rounded up', 1)""",
    "filing_topics": text_queries._SECTIONS.rstrip()
    + f""", sentences AS (SELECT page_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts
        FROM cut WHERE reason IS NULL AND section = '{RISK_SECTION}'),
      packed AS (SELECT page_id, parts, 1 AS i, 1 AS chunk_id, parts[1] AS cur FROM sentences UNION ALL
        SELECT page_id, parts, i + 1, CASE WHEN length(cur) + 1 + length(parts[i + 1]) > 1500 THEN chunk_id + 1 ELSE chunk_id END,
          CASE WHEN length(cur) + 1 + length(parts[i + 1]) > 1500 THEN parts[i + 1] ELSE cur || ' ' || parts[i + 1] END
        FROM packed WHERE i < len(parts))
      SELECT page_id, chunk_id, md5(arg_max(cur, i)) AS digest, true AS labelled FROM packed GROUP BY page_id, chunk_id""",
    "topic_representative": V.ctes(*_CLASSIFIED)
    + """SELECT CAST(component AS INTEGER) AS component, doc_id, score, substr(text, 1, 500) AS preview FROM (
      SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, doc_id) = 1)
      JOIN documents USING (doc_id)""",
}
