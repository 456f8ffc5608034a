"""Checks of pages on small texts: nulls, empty texts, ties, and columns with other names."""

from pyspark.sql import functions as F

from lakequill.operators import lint as L


def test_sections_count_their_own_lines(spark):
    text = "# t\n## a\n\n### b\nx\n \ny\n##  c \n## d\nz\n#### e\n##no\n##### f"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "## last", 0)], "id int, body string, line int")
    rows = L.sections(docs, "id", "body")
    got = {(r.id, r.line): (r.level, r.title, r.n_body, r.next_level) for r in rows.collect()}
    assert got == {(1, 2): (2, "a", 0, 3), (1, 4): (3, "b", 2, 2), (1, 8): (2, "c", 0, 2), (1, 9): (2, "d", 1, 4), (1, 11): (4, "e", 2, None), (4, 1): (2, "last", 0, None)}
    # a deeper section right below makes up for the missing body
    assert {(r.id, r.line) for r in L.empty_sections(rows).collect()} == {(1, 8), (4, 1)}
    assert L.sections(docs.limit(0), "id", "body").count() == 0


def test_generic_headings(spark):
    names = {"知見": True, "知見と考察": True, "横断的観察": True, "知見(まとめ)": True, "知見: まとめ": True, "観察可能性": False, "まとめ買い": False, "補足事項": False, "": False, " ": False}
    rows = spark.createDataFrame([(n,) for n in names], "t string").select("t", L.generic_heading(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in rows} == names


def test_heading_findings(spark):
    rows = [
        (1, "T", "concept", "# T\n## 知見\n## 横断的知見"), (2, "T", "source", "# U\n## 検証結果 1\n## 知見"), (3, "T", "source", "# T\n# U\n# V"), (4, "T", "concept", None), (5, None, None, "# x\n## 知見"), (6, "", "concept", "# x"),
    ]
    docs = spark.createDataFrame(rows, "id int, name string, sort string, body string")
    got = L.heading_findings(docs, "id", "name", "sort", "body")
    assert {tuple(r) for r in got.collect()} == {(1, 2, "generic"), (2, 1, "h1-title"), (2, 2, "verifying"), (3, 2, "h1-many"), (4, None, "h1-none")}


def test_line_findings(spark):
    text = "a—b — c\nア・イ・x・\n[[p—q・r]] ![[多角的]]\n多角的に多角的、掘り下げ 極めて\n・"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "id int, x string").withColumnRenamed("x", "body")
    got = {(r.id, r.check, r.level): (r.n, r["first"]) for r in L.line_findings(docs, "id", "body").collect()}
    assert got == {(1, "dashes", "fail"): (1, 1), (1, "dots", "warn"): (1, 2), (1, "dots", "fail"): (3, 2), (1, "phrases", "fail"): (2, 4), (1, "phrases", "warn"): (1, 4)}


def test_derived_identifiers(spark):
    schema = "id int, a string, d string, url string, slugs array<string>, body string, kind string"
    rows = [
        (1, "2401.00001v2", None, "https://arxiv.org/abs/2402.00002", [], None, "paper"), (2, None, None, "http://ARXIV.org/pdf/2402.00002v1", ["arxiv-2403.00003"], "", "book"),
        (3, "", "", None, ["arxiv-2403.00003", None, "arxiv-2403.00003v2"], "arxiv.org/abs/2404.00004", "paper"), (4, None, None, None, ["arxiv-2403.00003", "arxiv-2403.00005"], "arxiv.org/abs/2404.00004 arxiv.org/pdf/2404.00004v2 doi.org/10.1000/Ab(1)", "paper"),
        (5, None, None, None, None, "arxiv.org/abs/2404.00004 arxiv.org/abs/2404.00005 doi.org/10.5281/zenodo.9 doi.org/10.1000/x", "paper"), (6, None, None, None, [], "arxiv.org/abs/2404.00004 doi.org/10.1000/x", "book"), (7, None, None, None, None, None, None),
    ]
    c = F.col
    got = spark.createDataFrame(rows, schema).select("id", *L.derived_identifiers(c("a"), c("d"), c("url"), c("slugs"), c("body"), c("kind"))).collect()
    assert {r.id: tuple(r)[1:] for r in got} == {
        1: ("2401.00001", "frontmatter", None, None), 2: ("2402.00002", "url", None, None), 3: ("2403.00003", "sources", None, None), 4: ("2404.00004", "body", "10.1000/ab(1)", "body"),
        5: (None, None, "10.1000/x", "body"), 6: (None, None, None, None), 7: (None, None, None, None),
    }


def test_survey_signals(spark):
    concepts = spark.createDataFrame([(k, n) for k, n in enumerate(["big bolts", "pin", None, "bo", "widgets"])], "id int, name string")
    cites = [(0, f"d{i % 13}", i < 5) for i in range(40)] + [(1, f"d{i}", True) for i in range(8)] + [(2, None, True)] * 6 + [(3, "d", None)]
    profile = {"out_of_scope": ["Bolt"], "core": ["pin", "widget"]}
    rows = L.survey_signals(concepts, spark.createDataFrame(cites, "id int, document string, inbox boolean"), "id", profile).collect()
    assert {r.id: tuple(r)[2:] for r in rows} == {0: (13, 5, "dense", True, "out_of_scope"), 1: (8, 8, "near", True, "core"), 2: (0, 6, None, True, "unknown"), 3: (1, 0, None, False, "unknown"), 4: (0, 0, None, False, "core")}


def test_subtype(spark):
    rows = [("source", {"source_type": "paper", "complexity": "x"}), ("concept", {"source_type": "paper"}), ("entity", {"entity_type": ""}), ("survey", {"answer_quality": "good"}), (None, {"answer_quality": "good"}), ("source", None)]
    got = spark.createDataFrame(rows, "type string, fields map<string,string>").select(L.subtype(F.col("type"), F.col("fields"))).collect()
    assert [r[0] for r in got] == ["paper", "", "", "good", "good", ""]
