import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerspark import constants as C
from ledgerspark.operators import annual, growth, quality, reshape
from ledgerspark.plans.annual_report import build_annual_summary, publish_annual_summary
from ledgerspark.sources import company_facts, filings, tables

FACT = "entity string, concept string, unit string, start date, end date, val double, form string, fp string, filed date, accn string"
END = dt.date(2024, 9, 28)
D = dt.date


def fact(concept="Assets", val=1e9, start=D(2023, 10, 1), end=END, filed=D(2024, 11, 1), accn="a", form="10-K", fp="FY", entity="e", unit="USD"):
    return (entity, concept, unit, start, end, val, form, fp, filed, accn)


def all_concepts(**changes):
    return [fact(concept=c, **changes) for c in C.CONCEPT_COLUMNS.values()]


def summary_row(**changes):
    row = {
        "entity": "e",
        "end": D(2024, 9, 28),
        "revenue_billions": 200.0,
        "operating_income_billions": 60.0,
        "net_income_billions": 50.0,
        "operating_cash_flow_billions": 55.0,
        "total_assets_billions": 300.0,
        "total_liabilities_billions": 250.0,
        "cash_and_cash_equivalents_billions": 20.0,
        "operating_margin_pct": 30.0,
        "net_profit_margin_pct": 25.0,
    }
    row.update(changes)
    return row


SUMMARY = "entity string, end date, " + ", ".join(f"{c} double" for c in C.SUMMARY_METRICS)


def summary(spark, *rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SUMMARY)
    return annual.add_fiscal_year(df)


def two_years():
    return [
        summary_row(),
        summary_row(end=D(2025, 9, 27), revenue_billions=220.0, operating_margin_pct=33.0, operating_cash_flow_billions=44.0),
    ]


def test_latest_filing_wins_then_longest_period_then_accession(spark):
    rows = [
        fact(val=1.0, filed=D(2023, 1, 1)),
        fact(val=2.0, start=D(2024, 7, 1)),
        fact(val=3.0, accn="a"),
        fact(val=4.0, accn="b"),
        fact(val=9.0, form="10-Q"),
        fact(val=9.0, fp="Q3"),
        fact(val=9.0, unit="EUR"),
    ]
    facts = annual.annual_facts(spark.createDataFrame(rows, FACT))
    assert [r["val"] for r in annual.latest_facts(facts).collect()] == [4.0]


def test_period_needs_every_concept_but_may_hold_a_null(spark):
    other = D(2025, 9, 27)
    rows = all_concepts() + all_concepts(end=other)[:-1]
    rows += [fact(concept=c, entity="n", val=None) for c in C.CONCEPT_COLUMNS.values()]
    facts = annual.annual_facts(spark.createDataFrame(rows, FACT))
    for build in (annual.annual_summary, annual.annual_summary_by_joins):
        found = {r["entity"]: r for r in build(facts).collect()}
        assert set(found) == {"e", "n"}
        assert found["e"]["end"] == END and found["e"]["operating_margin_pct"] == 100.0
        assert found["n"]["revenue_billions"] is None and found["n"]["operating_margin_pct"] is None


def test_zero_revenue_gives_no_margin(spark):
    rows = [fact(concept=c, val=0.0) for c in C.CONCEPT_COLUMNS.values()]
    row = build_annual_summary(spark.createDataFrame(rows, FACT)).first()
    assert row["operating_margin_pct"] is None


def test_summary_uses_one_shuffle_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.createDataFrame(all_concepts(), FACT).write.parquet(path)
    plan = build_annual_summary(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert "EqualTo(form,10-K)" in plan and "EqualTo(fp,FY)" in plan


def test_valid_summary_passes(spark):
    df = summary(spark, *two_years())
    assert quality.validate(df).count() == 2
    assert all(r["passed"] for r in quality.quality_report(df).collect())


def test_negative_revenue_is_rejected(spark):
    with pytest.raises(quality.QualityError, match="Revenue must be positive"):
        quality.validate(summary(spark, summary_row(revenue_billions=-1.0)))


@pytest.mark.parametrize("column", C.POSITIVE_COLUMNS)
def test_missing_column_is_rejected(spark, column):
    with pytest.raises(quality.QualityError, match="Missing columns"):
        quality.validate(summary(spark, summary_row()).drop(column))


@pytest.mark.parametrize("column", C.POSITIVE_COLUMNS)
def test_zero_balance_is_rejected(spark, column):
    with pytest.raises(quality.QualityError, match=f"{column} must be positive"):
        quality.validate(summary(spark, summary_row(**{column: 0.0})))


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([], "empty"),
        ([summary_row(net_income_billions=None)], "missing values"),
        ([summary_row(net_income_billions=float("nan"))], "missing values"),
        ([summary_row(), summary_row()], "duplicate"),
        ([summary_row(operating_margin_pct=101.0)], "outside the expected range"),
    ],
)
def test_other_checks(spark, rows, message):
    with pytest.raises(quality.QualityError, match=message):
        quality.validate(summary(spark, *rows))


def test_growth_cagr_and_takeaways(spark):
    df = summary(spark, *two_years())
    first, second = sorted(growth.add_growth(df).collect(), key=lambda r: r["end"])
    assert first["revenue_growth_pct"] is None
    assert second["revenue_growth_pct"] == pytest.approx(10.0)
    assert second["cash_flow_growth_pct"] == pytest.approx(-20.0)
    assert second["operating_margin_change_pp"] == pytest.approx(3.0)
    head = growth.takeaways(df).first()
    assert head["latest_year"] == 2025 and head["revenue_cagr_pct"] == pytest.approx(10.0)
    assert growth.revenue_cagr(summary(spark, summary_row())).first()["revenue_cagr_pct"] is None


def test_kpi_cards_use_the_preceding_year(spark):
    cards = growth.kpi_snapshot(summary(spark, *two_years()), 2025).orderBy("position").collect()
    assert [c["display"] for c in cards] == ["$220.00B", "$60.00B", "$50.00B", "$44.00B"]
    assert [c["note"] for c in cards] == [
        "+10.00% year-over-year",
        "33.00% operating margin",
        "25.00% net margin",
        "-20.00% year-over-year",
    ]


def test_latest_periods_prunes_before_the_shuffle(spark):
    df = growth.latest_periods(summary(spark, *two_years()), 1)
    assert [r["fiscal_year"] for r in df.collect()] == [2025]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_transpose_and_display(spark):
    df = summary(spark, *two_years())
    wide = {r["metric"]: r for r in reshape.transpose_years(df, [2024, 2025]).collect()}
    assert (wide["revenue_billions"]["FY2024"], wide["revenue_billions"]["FY2025"]) == (200.0, 220.0)
    assert reshape.display_table(growth.add_growth(df)).columns[1:] == list(C.DISPLAY_COLUMNS.values())


def test_company_documents_to_published_table(spark, tmp_path):
    record = {"start": "2023-10-01", "end": "2024-09-28", "val": 5e9, "accn": "x", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2024-11-01"}
    concepts = {c: {"label": c, "units": {"USD": [record, {**record, "form": "10-Q"}], "shares": [record]}} for c in C.CONCEPT_COLUMNS.values()}
    folder = tmp_path / "in"
    folder.mkdir()
    for cik in (1, 2):
        (folder / f"{cik}.json").write_text(json.dumps({"cik": cik, "entityName": "n", "facts": {"us-gaap": concepts, "dei": {}}}, indent=1))
    facts = company_facts.flatten_facts(company_facts.read_company_facts(spark, str(folder)))
    out = str(tmp_path / "out")
    facts = facts.withColumn("val", F.when(F.col("concept") == "OperatingIncomeLoss", 1e9).otherwise(F.col("val")))
    publish_annual_summary(facts, out)
    rows = tables.read_summary(spark, out).collect()
    assert sorted(r["entity"] for r in rows) == ["1", "2"]
    assert rows[0]["revenue_billions"] == 5.0 and rows[0]["operating_margin_pct"] == 20.0
    with pytest.raises(Exception):
        tables.read_summary(spark, str(tmp_path / "absent"))


def test_malformed_documents_are_set_aside(spark, tmp_path):
    """A broken file and a broken concept are reported; the rest is read, dealt out by concept or not."""
    record = {"start": "2023-10-01", "end": "2024-09-28", "val": 5e9, "accn": "x", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2024-11-01"}
    units = {u: [{**record, "val": v} for v in (1, 2.5, 3e9)] for u in ("USD", "EUR", "shares")}
    concepts = {f"C{i}": {"label": "l", "units": units} for i in range(50)} | {"Broken": {"units": "none"}, "Number": 7}
    (tmp_path / "good.json").write_text(json.dumps({"cik": 1, "facts": {"us-gaap": concepts}}))
    (tmp_path / "cut.json").write_text('{"cik": 2, "facts": {"us-gaap": {"C0": {"uni')
    (tmp_path / "empty.json").write_text("{}")
    read = company_facts.read_company_facts(spark, str(tmp_path))
    for partitions in (None, 5):
        facts = company_facts.flatten_facts(read, partitions=partitions)
        assert facts.count() == 50 * 3 * 3 and facts.agg(F.sum("val")).first()[0] == 150 * (3.5 + 3e9)
    found = {(r["document"].rsplit("/", 1)[-1], r["concept"], r["reason"]) for r in company_facts.quarantined_documents(read).collect()}
    assert found == {("cut.json", None, "document is malformed"), ("good.json", "Broken", "concept is malformed"), ("good.json", "Number", "concept is malformed")}


def test_a_failed_publish_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    first, second = summary(spark, *two_years()), summary(spark, *two_years()[:1])

    def publish(df):
        version = tables.new_version(path)
        tables.write_summary(df, version)
        tables.publish_version(spark, path, version)

    publish(first)
    before = tables.read_summary(spark, path)
    monkeypatch.setattr(tables, "write_note", lambda *a: (_ for _ in ()).throw(OSError("no move")))
    with pytest.raises(OSError):
        publish(second)
    assert before.count() == tables.read_summary(spark, path).count() == 2
    monkeypatch.undo()
    publish(second)
    # readers that began before still find their version
    assert tables.read_summary(spark, path).count() == 1 and before.count() == 2
    publish(second)
    assert len(list((tmp_path / "out").glob("version-*"))) == 3 - 1 + 1  # the failed one was never named
    tables.write_note(spark, str(tmp_path / "note"), "a")
    tables.write_note(spark, str(tmp_path / "note"), "bé")
    assert tables.read_note(spark, str(tmp_path / "note")) == "bé" and tables.read_note(spark, str(tmp_path / "none")) is None


def test_bad_figures_are_not_published(spark, tmp_path):
    facts = spark.createDataFrame([], "entity string, concept string, unit string, start date, end date, val double, form string, fp string, filed date, accn string")
    with pytest.raises(Exception, match="empty"):
        publish_annual_summary(facts, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("version-*"))


def test_filing_index(spark, tmp_path):
    recent = {
        "form": ["8-K", "10-K", "10-K"],
        "accessionNumber": ["1-1", "0000000007-25-000079", "1-3"],
        "primaryDocument": ["a", "b.htm", "c"],
        "filingDate": ["2025-12-01", "2025-10-31", "2024-10-31"],
        "reportDate": ["", "2025-09-27", "2024-09-28"],
    }
    (tmp_path / "s.json").write_text(json.dumps({"cik": "0000000007", "filings": {"recent": recent}}, indent=1))
    index = filings.filing_index(filings.read_submissions(spark, str(tmp_path)))
    assert index.count() == 3
    row = filings.latest_filing(index).first()
    assert row["filing_date"] == "2025-10-31"
    assert row["source_url"] == "https://www.sec.gov/Archives/edgar/data/7/000000000725000079/b.htm"


def test_chunk_files_and_tables(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"chunk_id": 1, "section": "s", "text": "a"}, {"chunk_id": 2, "section": "s", "text": "b"}], indent=1))
    chunks = tables.read_chunks(spark, str(path))
    assert chunks.count() == 2
    tables.write_chunks(chunks, str(tmp_path / "copy"))
    lines = spark.read.schema(tables.MDA_CHUNK).json(str(tmp_path / "copy"))
    assert sorted(r["text"] for r in lines.collect()) == ["a", "b"]
    old = spark.createDataFrame([(1, "Theme", "t")], "chunk_id int, topic_label string, text string")
    row = tables.with_display_fallbacks(old).first()
    assert (row["display_topic_label"], row["excerpt"]) == ("Theme", "t")
    assert tables.publish_view(chunks, "chunk_view").count() == 2


def test_whole_files_and_metadata(spark, tmp_path):
    (tmp_path / "a.htm").write_text("<p>one</p>\n<p>two</p>")
    (tmp_path / "b.htm").write_text("")
    read = {r["filing_id"].rsplit("/", 1)[-1]: r["html"] for r in filings.read_text_files(spark, str(tmp_path / "*.htm")).collect()}
    assert read["a.htm"] == "<p>one</p>\n<p>two</p>"
    (tmp_path / "section.txt").write_text("Item 1A.\nText 😀")
    assert filings.read_text_files(spark, str(tmp_path / "section.txt"), "text").first()["text"] == "Item 1A.\nText 😀"
    known = {"company": "Example Inc.", "cik": "0000000009", "form": "10-K", "filing_date": "2025-10-31"}
    (tmp_path / "m.json").write_text(json.dumps(known, indent=1))
    row = filings.read_filing_metadata(spark, str(tmp_path / "m.json")).first()
    assert (row["company"], row["filing_date"], row["source_url"]) == ("Example Inc.", "2025-10-31", None)


def test_sections_and_managed_tables(spark, tmp_path):
    rows = [(1, "Item 1A", "a"), (1, "Item 7", "b"), (2, "Item 7", "c")]
    sections = spark.createDataFrame(rows, "filing_id int, section string, text string")
    tables.write_sections(sections, str(tmp_path / "sections"))
    back = spark.read.parquet(str(tmp_path / "sections"))
    assert sorted((r["filing_id"], r["section"], r["text"]) for r in back.collect()) == rows
    assert back.filter("section = 'Item 7'").count() == 2
    try:
        assert tables.publish_table(sections.limit(1), "ledger_sections_test").count() == 1
        assert tables.publish_table(sections, "ledger_sections_test").count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS ledger_sections_test")


def test_years_latest_first(spark):
    rows = reshape.years_descending(summary(spark, *two_years())).collect()
    assert [list(r["years"]) for r in rows] == [[2025, 2024]]
