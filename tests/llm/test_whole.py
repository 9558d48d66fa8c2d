"""Names and origins: whole texts, and spellings whoever attests them."""

from codelens.llm import names, origins


def test_origins_read_the_whole_text():
    banner = "/*\n" + " * Permission is hereby granted, free of charge, to any person.\n" * 100 + " */\n"
    code = "".join(f"function f{i}(a, b) {{\n  if (a > b) return a + {i};\n  return b.size * a\n}}\n" for i in range(3))
    kind = lambda t, p="a.js": origins.kind_of(p, t.encode())
    assert kind(banner + code) is None
    assert kind(banner + "var m = __webpack_require__(3);\n" + code) == "minified"
    assert kind(banner + 'Object.defineProperty(exports, "__esModule", { value: true });\nswitch (_a.label) {\n}\n' + code) == "minified"
    assert kind(code + "// __webpack_require__ is a mark\n" + "var m = '__webpack_require__', n = \"parcelRequire\", o = `System.register([`;\n") is None
    assert kind(banner.replace("*/", "* vendored from upstream\n */") + code) == "vendored"
    assert kind(banner.replace("*/", "* Code generated by tool. DO NOT EDIT.\n */") + code) == "generated"
    assert origins.notices((banner.replace("*/", "* This file is part of ours\n */") + code).encode()) == ["ours"]


def test_near_forms_take_the_best_and_compare_rare_ones(spark):
    rows = [("robert", "sinifa", True), ("roberta", "sinifa", True), ("robret", "sinifa", False), ("leonard", "pojusto", False), ("leonrad", "pojusto", False), ("jon", "pojusto", False), ("ines", "bibriri", False)]
    forms = spark.createDataFrame([(f"{a} {b}", a, b, t) for a, b, t in rows], "form string, first string, last string, attested boolean")
    got = {tuple(r) for r in names.near_forms(forms, spark.createDataFrame([], "form string, to string")).collect()}
    assert got == {("robret sinifa", "robert sinifa"), ("leonrad pojusto", "leonard pojusto")}


def test_of_equal_candidates_one_is_taken(spark):
    """An unattested form between two attested ones is linked to one of them, always the same, and joins nobody else."""
    rows = [("ann", "marek", True), ("ann", "marik", True), ("ann", "marjk", False)]
    forms = spark.createDataFrame([(f"{a} {b}", a, b, t) for a, b, t in rows], "form string, first string, last string, attested boolean")
    got = {tuple(r) for r in names.near_forms(forms, spark.createDataFrame([], "form string, to string")).collect()}
    assert got == {("ann marjk", "ann marik")}


def test_organisations_that_no_domain_attests(spark):
    rows = [("kuroki systems", False), ("kuroki system", False), ("relali works", True), ("relali work", False), ("abc", False), ("abd", False)]
    got = {frozenset(r) for r in names.org_near(spark.createDataFrame(rows, "form string, attested boolean")).collect()}
    assert got == {frozenset(("kuroki systems", "kuroki system")), frozenset(("relali work", "relali works"))}


def test_hand_written_files_that_repeat():
    """Lists of routes, constants, exports and rows that a person writes are no generated code; so isn't what people created."""
    kind = lambda p, t: origins.kind_of(p, t.encode())
    assert kind("app/urls.py", "from django.urls import path\n\nurlpatterns = [\n" + "".join(f'    path("a{i}/", views.show_{i}, name="a{i}"),\n' for i in range(20)) + "]\n") is None
    assert kind("a/const.go", "package a\n\nconst (\n" + "".join(f'\tName{i} = "value{i}"\n' for i in range(20)) + ")\n") is None
    assert kind("src/exports.ts", "".join(f'export {{ Part{i} }} from "./part{i}";\n' for i in range(20))) is None
    assert kind("a/table.py", "ROWS = [\n" + "".join(f'    ("name{i}", "kind{i}", True),\n' for i in range(20)) + "]\n") is None
    assert kind("a/Team.java", "/* This class was created by the web team. */\nclass Team {\n  int size() { return 3; }\n}\n") is None
    assert kind("a/a_gen.go", "package a\n\nconst (\n" + "".join(f'\tName{i} = "value{i}"\n' for i in range(20)) + ")\n") == "generated"


def test_outside_folders_need_no_word_against_them(spark):
    body = "".join(f"function load{i}(a, b) {{\n  return b.filter((x) => x > a + {i});\n}}\n" for i in range(9))
    rows = [(1, "acme", "acme/external/a.js", "// This file is part of acme\n" + body), (2, "acme", "acme/deps/b.js", "// This file is part of other\n" + body), (3, "acme", "acme/src/c.js", body)]
    df = spark.createDataFrame([(k, r, p, t.encode()) for k, r, p, t in rows], "file_id int, repo string, path string, content binary")
    assert {(r.file_id, r.kind, r.evidence) for r in origins.classify(df).collect()} == {(2, "vendored", "outside")}
