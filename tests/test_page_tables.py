"""Tables from words: anchors, fragments, sections within spans, gates and arbitration."""

from folioscope.operators import tables

SCHEMA = "doc string, page int, text string, x0 double, x1 double, top double"


def line(top, *words, page=1):
    """Words as (text, right edge)."""
    return [("d", page, t, x - 10.0, float(x), float(top)) for t, x in words]


PAGE = [
    *line(10, ("Assets", 30)), *line(22, ("Cash", 40), ("1,234", 210), ("2,000", 270)), *line(34, ("Leases", 40), ("900", 212), ("800", 268)),
    *line(46, ("Stock", 40), ("24,000", 90)), *line(58, ("authorized", 40), ("7,500", 90)), *line(70, ("outstanding", 40), ("7,519", 100), ("120", 210), ("130", 270)),
    *line(82, ("Currency", 40), ("55", 100), ("340", 240), ("350", 270)), *line(94, ("Close", 40), ("77", 195), ("340", 210), ("350", 270)), *line(106, ("Total", 40), ("5,000", 210), ("6,000", 270)),
]


def test_only_values_that_stand_on_the_columns_are_cells(spark):
    rows = tables.span_rows(tables.span_numbers(tables.lines_from_words(spark.createDataFrame(PAGE, SCHEMA))))
    got = {r.label: r["values"] for r in rows.where("kind <> 'header'").collect()}
    assert got == {
        "Cash": ["1,234", "2,000"], "Leases": ["900", "800"], "Stock 24,000 authorized 7,500 outstanding 7,519": ["120", "130"], "Currency 55 340 350": [], "Close 77 340 350": [], "Total": ["5,000", "6,000"],
    }


def test_columns_that_do_not_agree_are_no_anchors(spark):
    moved = [(*w[:3], w[3] + 9.0, w[4] + 9.0, w[5]) if w[2] == "1,234" else w for w in PAGE]
    rows = tables.span_rows(tables.span_numbers(tables.lines_from_words(spark.createDataFrame(moved, SCHEMA))))
    assert {r.label: r["values"] for r in rows.where("kind = 'over'").collect()} == {"Stock 24,000 authorized 7,500 outstanding 7,519 120 130": [], "Currency 55 340 350": [], "Close 77 340 350": []}


def test_document_tables_take_a_page_from_its_words_or_else_from_grids(spark):
    page = [*PAGE, *line(0, ("2022", 210), ("2021", 270)), *line(200, ("in", 30), ("millions", 50))]
    prose = [w for i in range(4) for w in line(12 * i, ("We constantly endeavor to fulfil all that we have promised to each,", 100), (f"{i + 3}.5", 210), page=2)]
    grid = [("d", p, f"t{p}", r, c, x) for p in (1, 2) for r, cells in enumerate([["", "2020", "2019"], ["Revenue", "$", "10"], ["Costs", "7", "8"]]) for c, x in enumerate(cells)]
    found = tables.document_tables(spark.createDataFrame(page + prose, SCHEMA), spark.createDataFrame(grid, "doc string, page int, table_id string, r int, c int, text string")).collect()
    first = [(r.label, r.section, r.period, r.value, r.units, r.is_period) for r in found if r.page == 1 and r.label == "Cash"]
    assert sorted(first) == [("Cash", "Assets", "2021", 2000.0, "in millions", True), ("Cash", "Assets", "2022", 1234.0, "in millions", True)]
    assert {(r.page, r.found_by) for r in found} == {(1, "geometry"), (2, "grid")}
    assert sorted((r.label, r.slot, r.value) for r in found if r.page == 2) == [("Costs", 1, 7.0), ("Costs", 2, 8.0), ("Revenue", 2, 10.0)]
    assert tables.document_tables(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_are_dealt_out_once(spark):
    """Windows and groups by band, line and span stay where their page is, and no line's page is put in order once for each line."""
    spans = tables.with_prose(tables.with_sections(tables.span_numbers(tables.lines_from_words(spark.createDataFrame(PAGE, SCHEMA))), ("doc", "page", "span")))
    plan = tables.span_rows(spans, keep=("width",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "array_sort" not in plan


def test_notes_at_the_head_of_a_run_join_the_label(spark):
    lines = {
        10: ("Costs", "4.1", "5.2", "1,000", "2,000"), 20: ("Stock", "4.1", "5.2", "900"), 30: ("Debt", "4.1", "7", "1,000", "–"), 40: ("Rent", "7", "4.1", "1,000", "2,000"),
        50: ("Fees", "3", "words", "–", "(1)", "$", "12"), 60: ("None", "–"), 70: ("4.1", "4.2", "(a)", "4.3"), 80: ("Tax", "1.1", "(5,000)", "99%", "-"),
    }
    words = [w for top, texts in lines.items() for w in line(top, *((t, 40 * (i + 1)) for i, t in enumerate(texts)))]
    got = {tuple(w["text"] for w in r.before): [w["text"] for w in r.run] for r in tables.value_lines(spark.createDataFrame(words, SCHEMA)).collect()}
    assert got == {
        ("Costs", "4.1", "5.2"): ["1,000", "2,000"], ("Stock",): ["4.1", "5.2", "900"], ("Debt", "4.1", "7", "1,000", "–"): [], ("Rent",): ["7", "4.1", "1,000", "2,000"],
        ("Fees", "3", "words"): ["–", "12"], ("None", "–"): [], (): ["4.1", "4.2", "4.3"], ("Tax", "1.1", "(5,000)", "99%", "-"): [],
    }


def test_confidence_takes_the_commonest_width_of_equals_the_first_met(spark):
    grids = {"a": [["", "2020"], ["x", "1", "2"], ["y", "3"], ["z", "4", "5"]], "b": [["", "1"], ["x", "2", "3"]], "c": [["only"], ["text"]], "d": [["x", "1", "2"], ["y", "3"]], "e": [["1", "2"], ["3", "4"], ["5", "x"]]}
    rows = [(t, r, c, x) for t, g in grids.items() for r, cells in enumerate(g) for c, x in enumerate(cells)]
    got = {r.table_id: (r.confidence, r.accepted) for r in tables.confidence(spark.createDataFrame(rows, "table_id string, r int, c int, text string")).collect()}
    ragged = round(0.4 + 0.2, 6)  # half of the rows are wider than the first width
    assert got == {"a": (ragged, True), "b": (ragged, True), "c": (0.0, False), "d": (0.0, False), "e": (0.88, True)}
