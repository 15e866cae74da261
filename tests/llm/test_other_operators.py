"""Licences, URL verdicts, vectors and page texts on small cases, the queries against SQL, and the pipeline."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import TABLES, rows_of
from newsloom.llm import curriculum, embeddings, html_text, licenses, queries, url_rules
from newsloom.llm.shared import kept
from tests.conftest import plan

SF = "/root/testdata/sf0.001"


# --- licences ------------------------------------------------------------------------------


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.py", "code"), (3, "a/b/COPYING", apache), (4, "a/b/c/y.py", None), (5, "a/b/z.py", f"text\n{mit}\nmore"),
        (6, "d/e.py", ""), (7, None, mit), (8, "a/b/license.txt", "nothing of the kind"), (9, "ab/q.py", "x"), (9, "ab/q.py", "x"), (10, "LICENSE", None),
    ]
    frame = spark.createDataFrame([(*row, "clash") for row in rows], "id bigint, path string, text string, statement string")
    got = sorted(((r.id, r.own_license, r.license, r.license_from) for r in licenses.scan(frame).collect()), key=str)
    assert got == sorted([
        (1, "MIT", "MIT", "a/LICENSE"), (2, None, "MIT", "a/LICENSE"), (3, "Apache-2.0", "Apache-2.0", "a/b/COPYING"),
        (4, None, "Apache-2.0", "a/b/COPYING"), (5, "MIT", "MIT", "a/b/z.py"), (6, None, None, None), (7, "MIT", "MIT", None),
        (8, None, "Apache-2.0", "a/b/COPYING"), (9, None, None, None), (9, None, None, None), (10, None, None, None),
    ], key=str)
    assert licenses.scan(frame.limit(0)).count() == 0


def licence_text(name):
    with open(os.path.join(licenses.TEXTS, f"{name}.txt"), encoding="utf-8") as file:
        return file.read()


def test_licence_texts_headers_and_names(spark):
    holder = "Copyright (c) 2020 Some Person and other contributors\n"
    commented = "".join(f"# {line}\n" for line in (holder + licence_text("Apache-2.0_header")).splitlines())
    gnu = "/* " + holder + licence_text("GPL-3.0_header") + "*/\nint main() { return 0; }\n" * 300
    bsd = holder + licence_text("BSD-3-Clause_text")
    cases = [
        ("m/LICENSE", "MIT License\n\n" + holder + licence_text("MIT_text"), "MIT"), ("m/x.py", "code", None),
        ("g2/COPYING", licence_text("GPL-2.0_text"), "GPL-2.0"), ("l/COPYING", licence_text("LGPL-3.0_text"), "LGPL-3.0"),
        ("b/LICENSE", bsd, "BSD-3-Clause"), ("b2/LICENSE", holder + licence_text("BSD-2-Clause_text"), "BSD-2-Clause"),
        ("a/LICENSE", licence_text("Apache-2.0_text"), "Apache-2.0"), ("p/LICENSE", licence_text("MPL-2.0_text"), "MPL-2.0"),
        ("s/a.py", commented + "import os\n" * 50, "Apache-2.0"), ("s/b.c", gnu, "GPL-3.0"),
        ("s/c.rs", holder + "// SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0"),
        ("s/d.rs", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "MIT OR Apache-2.0"),
        ("s/e.py", holder + "# This project is licensed under the MIT license.\n", "MIT"),
        ("s/f.py", holder + "# License: Apache License 2.0\n", "Apache-2.0"),
        ("s/g.py", holder + "All rights reserved.", None), ("s/h.txt", "The licence of the MIT lab was not renewed, they said.", None),
        ("q/LICENSE", holder + "This software is released under the MIT License.\nIt was written by a group of friends.", "MIT"),
        ("g3/COPYING", licence_text("GPL-3.0_text"), "GPL-3.0"), ("g4/COPYING", licence_text("GPL-3.0_text")[:3600], None),
        ("ag/COPYING", licence_text("AGPL-3.0_text"), "AGPL-3.0"), ("cc/LICENSE", licence_text("CC-BY-SA-4.0_text"), "CC-BY-SA-4.0"),
        ("s/i.rs", "// SPDX-License-Identifier: Zlib", None), ("s/j.c", f"/*\n{licence_text('MIT_text')}*/\n" + "int a;\n" * 200_000, "MIT"),
        ("pr/LICENSE", "All rights reserved. No license is granted to copy or redistribute this proprietary software.", None),
    ]
    frame = spark.createDataFrame([(i, path, text) for i, (path, text, _) in enumerate(cases)], "id int, path string, text string")
    frame = frame.union(frame.limit(1))
    got = {r.path: r for r in licenses.scan(frame).collect()}
    assert {path: got[path].own_license for path, *_ in cases} == {path: license for path, _, license in cases}
    assert (got["m/x.py"].license, got["m/x.py"].license_from) == ("MIT", "m/LICENSE")
    assert all(r.similarity <= 1 for r in got.values() if r.similarity is not None)


def test_licences_of_equal_cosine_go_to_the_first_name(spark):
    templates = spark.createDataFrame([("B", "Granted by license one"), ("A", "granted by license ONE"), (None, "license")], "license string, statement string")
    frame = spark.createDataFrame([(1, "x.py", "# granted by license one")] * 2, "id int, path string, text string")
    assert [(r.own_license, r.similarity) for r in licenses.scan(frame, templates).collect()] == [("A", 1.0)] * 2
    assert [r.own_license for r in licenses.scan(frame, templates.limit(0)).collect()] == [None, None]


def test_licence_files_equal_sql(spark, tmp_path):
    holder = "Copyright (c) 2020 Some Person\n"
    names = sorted(name[:-4] for name in os.listdir(licenses.TEXTS))
    texts = [licence_text(name) for name in names]
    rows = [(50 * k, holder + text, "en", f"s{k}") for k, text in enumerate(texts)]
    rows += [(50 * k + 2, "".join(f"# {line}\n" for line in text.splitlines()) + "x = 1\n", "en", f"s{k % 3}") for k, text in enumerate(texts)]
    rows += [
        (51, "This is licensed under GPL v3.0.\nMore follows here.", "de", "s9"), (53, "GPLv2 license", "de", "s9"), (54, None, "de", "s9"), (55, "", None, "s9"),
        (56, "Licensed under the K\u0130T License\nSPDX-License-Identifier: MIT", "de", None), (58, "a\n\n\n\nlicense\n", "de", "s0"),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_license_scan"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = duck.execute(queries.ORACLE["op1_license_scan"])
    columns = [column[0] for column in result.description]
    want = rows_of(columns, result.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    own = {r.doc_id: r.own_license for r in got.collect()}
    assert [own[50 * k] for k in range(len(names))] == [name.rsplit("_", 1)[0] for name in names]


# --- URLs ----------------------------------------------------------------------------------


def test_blocks_are_handed_to_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.net/x?q=1#top", link.format("https://shop.com/de/1")), (2, "http://a.net/x?q=1", None), (3, "http://b.net/", None),
        (4, "https://c.net/p/q", "<META http-equiv='refresh' content='0; url=/r'>"), (5, "http://c.net/r", link.format("//x.com/fr/2")),
        (6, "HTTP://WWW.Example.ORG/es/1?z", None), (7, "http://example.org/en/12", None), (8, "http://example.org/en/2", None),
        (9, None, None), (10, "no scheme", None), (11, "http://org", None), (12, "http://d.net/y", link.format("http://shop.com/de/9")),
        (13, "http://d.net/z", link.format("http://d.net/y")), (13, "http://d.net/z", link.format("http://x.com/fr/7")), (14, "http://shop.com/de/9", ""),
    ]
    frame = spark.createDataFrame([(*row, "clash") for row in rows], "page_id bigint, url string, html string, host string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(frame).collect()}
    assert got[1] == ("a.net", "/x", None, "block") and got[2][3] == "block" and got[3] == ("b.net", "/", None, "allow")
    assert got[4][3] == got[5][3] == "allow"
    assert got[6] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[7][2:] == ("example.org/en/1", "block") and got[8][2:] == ("org/", "allow")
    assert got[9] == got[10] == ("", "", None, "allow") and got[11] == ("org", "", None, "allow")
    # One alias is explicitly allowed, so the others are not blocked; the rule still decides for the blocked one.
    assert got[12][3] == got[13][3] == "allow" and got[14][2:] == ("com/de/", "block")
    moved = spark.createDataFrame([("http://b.net/", "http://shop.com/de/1"), (None, "http://b.net/")], "a string, b string")
    assert {r.id: r.verdict for r in url_rules.judge(frame, redirects=moved).collect()}[3] == "block"
    assert url_rules.judge(frame.limit(0)).count() == 0


# --- vectors -------------------------------------------------------------------------------


def alias_verdicts(spark, pages):
    frame = spark.createDataFrame([(at, url, html, "clash") for at, (url, html) in enumerate(pages)], "page_id bigint, url string, html string, node string")
    return [r.verdict for r in url_rules.judge(frame).orderBy("id").collect()]


@pytest.mark.parametrize(
    "url, html, verdict",
    [
        ("http://c.net/a/b", '<link rel="canonical" href="../../x.com/de/1"><link rel=canonical href="//x.com/de/1">', "block"),
        ("http://c.net/a/b/c", "<link rel='canonical' href='../z'>", "block"),
        ("http://c.net/a/z", '<link rel="canonical" href="?v=1">', "block"),
        ("http://c.net:80", '<link rel="canonical" href="http://x.com/de/1">', "block"),
        ("https://c.net:443/q", '<link title="a > b" rel="canonical" href="http://x.com/de/1">', "block"),
        ("http://c.net/k", '<link rel="canonical" href="/other"><link rel="canonical" href="http://x.com/de/1"/>', "block"),
        ("http://c.net/k", '<!-- <link rel="canonical" href="http://x.com/de/1"> -->', "allow"),
        ("http://c.net/k", '<link rel="stylesheet" href="http://x.com/de/1">', "allow"),
        ("http://c.net/k", '<meta http-equiv="refresh" content="0; url=http://x.com/de/./1">', "block"),
        ("http://c.net/k", None, "allow"),
    ],
)
def test_aliases_are_resolved(spark, url, html, verdict):
    blocked = [("http://x.com/de/1", "")]
    more = [("http://c.net/a/z", '<link rel=canonical href="http://x.com/de/1">'), ("http://c.net/a/z?v=1", '<link rel=canonical href="http://x.com/de/1">')]
    assert alias_verdicts(spark, [(url, html), *blocked, *([] if url == "http://c.net/a/z" else more[:1]), *([] if "b/c" in url else more[1:])])[0] == verdict


def test_alias_sql_equals_operator(spark):
    """The given pages hold no links, so the SQL's components are compared on pages that do."""
    chance = random.Random(4)
    hosts = ["x.com", "y.com", "z.org", "C.net:80", *(f"h{k}.net" for k in range(20))]
    paths = ["", "/", "/de/1", "/de/1", "/de/1", "/a/b", "/a/../q", "/es/3", "/en/1", "/k?v=1", "/k?v=2#f", "/a/./c/"]

    def link():
        to = chance.choice(["http://x.com/de/1", f"http://{chance.choice(hosts)}{chance.choice(paths)}", f"//{chance.choice(hosts)}{chance.choice(paths)}", "../q", "?v=1", "/k?v=2", "c", "/a/.."])
        return chance.choice([f'<link title="a > b" rel="canonical" href="{to}">', f"<!-- <link rel=canonical href={to}> -->",
                              f'<meta http-equiv="refresh" content="0; url={to}">', f"<link rel='stylesheet' href='{to}'>"])

    rows = [(at, chance.choice([None, "x", *(f"{scheme}://{chance.choice(hosts)}{chance.choice(paths)}" for scheme in ("http", "https"))]),
             chance.choice([None, "", link(), link() + "<p>" + link()])) for at in range(120)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = sorted(map(tuple, url_rules.judge(frame).collect()), key=str)
    result = duck.execute(queries.ORACLE["op2_url_rules"])
    assert [c[0] for c in result.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert got == sorted(result.fetchall(), key=str)
    handed_on = {row[4] for row in got if row[3] is None}
    assert handed_on == {"allow", "block"}, handed_on


def test_one_form_of_addresses(spark):
    forms = ["http://C.net", "http://c.net/", "https://c.net:443/#x", "http://c.net:80/a/..", "http://c.net/./"]
    frame = spark.createDataFrame([(url,) for url in [*forms, "http://c.net/a/b/../c/.", "http://c.net:443/", None, "x", "http://"]], "url string")
    got = [r[0] for r in frame.select(url_rules.address_of(frame["url"])).collect()]
    assert got[:5] == ["c.net/"] * 5 and got[5:7] == ["c.net/a/c/", "c.net:443/"] and [g or "" for g in got[7:]] == ["", "", ""]


def test_vectors_that_share_an_id(spark):
    v, close, w = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, v), (1, w), (2, close), (3, v), (9, w), (7, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 1, False)]


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    chance = np.random.default_rng(3)
    vectors = []
    for size in (1, 2, 60, 5, 1, 1, 30):
        centre = chance.standard_normal(16)
        vectors += [(centre + 0.12 * chance.standard_normal(16)).tolist() for _ in range(size)]
    vectors += [vectors[0]] * 40 + [[2 * x for x in vectors[0]], [0.0] * 16, None, [], [None, *vectors[0][1:]], [float("nan")] * 16, [float("inf")] * 16]
    vectors += [vectors[0][:8], vectors[0][:8]]
    order = list(range(len(vectors)))
    random.Random(1).shuffle(order)
    rows = [(int(i), vectors[k], 1) for i, k in enumerate(order)] + [(None, vectors[0], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, first int")
    got = {r.id: r for r in embeddings.near_vectors(frame, recall=0.9999).collect()}
    sound = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: set() for i, _ in sound}
    for i, v in sound:
        for j, w in sound:
            if i != j and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9:
                near[i].add(j)
    low = {i: i for i in near}
    for _ in near:
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in near}
    for i, *_ in rows:
        row = got[i]
        if i in near:
            assert (row.n_links, row.component_id, row.kept) == (len(near[i]), low[i], low[i] == i)
        else:
            assert (row.n_links, row.component_id, row.kept) == (0, i, True)
    assert len(got) == len(rows) and embeddings.near_vectors(frame.limit(0)).count() == 0


def test_recall_on_given_vectors(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = frame.collect()
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = int(((unit @ unit.T) >= 0.9).sum()) - len(rows)
    got = sum(r.n_links for r in embeddings.near_vectors(frame).collect())
    assert 0.9 * want <= got <= want


# --- pages ---------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, yes.</p></div>
<div class="content has-sidebar"><h2>Title &amp; more</h2><p>First <b>bold</b> text,
 with&nbsp;space.<br>Same block. <!-- no --><p>Second &lt;b&gt; paragraph, longer than the others are; it goes on.</div>
<div id="comments"><p>I disagree, strongly. And at length, with commas, and more of them.</p></div><form><p>Search</p></form>
<aside><p>Related.</p></aside><div class="ad">Buy!</div><footer><p>(c)</p></footer></body></html>"""
TEXT = "Title & more\nFirst bold text, with space. Same block.\nSecond <b> paragraph, longer than the others are; it goes on."


def test_main_text():
    assert html_text.main_text(PAGE) == TEXT
    assert html_text.main_text(PAGE.replace("content has-sidebar", "x").replace("<div class=\"x\">", "<article>")) == TEXT
    nested = "<main><article><header class=entry-header><h1>Head</h1></header><p>Body text, here.</p><article class='comment'><p>No, no.</p></article></article></main>"
    assert html_text.main_text(nested) == "Head\nBody text, here."
    assert html_text.main_text("plain words, no tags") == "plain words, no tags"
    assert html_text.main_text("<p>cut &am") == "cut &am" and html_text.main_text("<article><p>one<p>two</article") == "one\ntwo"
    for empty in (None, "", "<html></html>", "<script>x", "<nav>a</nav>", "<"):
        assert html_text.main_text(empty) in ("", "<")
    assert html_text.main_text("<p>word, </p>" * 5000) == "\n".join(["word,"] * 5000)


LONG = "A sentence of some length, with a mark or two, goes on here. " * 10


def test_short_blocks_between_long_paragraphs_stay():
    items = "<ul><li>one item</li><li>two <a href='/'>items</a></li></ul><table><tr><td>cell</td></tr></table><div><div class=x>short quote</div></div>"
    want = "\n".join([LONG.strip(), "one item", "two items", "cell", "short quote", LONG.strip()])
    assert html_text.main_text(f"<nav>n</nav><article><p>{LONG}</p>{items}<p>{LONG}</p></article>") == want
    assert html_text.main_text(f"<article><div><p>{LONG}</p></div>{items}<p>{LONG}</p></article><footer>f</footer>") == want
    assert html_text.main_text(f"<body><div class=text><p>{LONG}</p>{items}<p>{LONG}</p></div><div>other</div></body>") == want
    table = "<ul><li>one item</li></ul><ul><li><a href='/'>link</a></li></ul>"
    assert html_text.main_text(f"<body><p>{LONG}</p>{table}</body>") == f"{LONG.strip()}\none item"


def test_marks_and_names_lose_to_far_better_text():
    cards = "<article class=card><h3>Teaser</h3><p>Read on</p></article>" * 3
    assert html_text.main_text(f"<div id=content><p>{LONG}</p></div>{cards}") == LONG.strip()
    for name in ("elementor-widget-container widget", "layout-sidebar-right", "side", "related", "page header"):
        share = "<div class=share><p>Tell others, please.</p></div>"
        assert html_text.main_text(f"<div class='{name}'><p>{LONG}</p>{share}</div><div>menu</div>") == LONG.strip()
    short = "<article><h1>News</h1><p>A short piece, of a few words.</p></article>"
    assert html_text.main_text(f"{short}<div class=comments><p>{LONG[:120]}</p></div>") == "News\nA short piece, of a few words."


def test_extract(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "u", "<p>\U0001f642", "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(frame).collect())
    assert got == [(1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0), (3, "\U0001f642", 1)]
    assert html_text.extract(frame.limit(0)).count() == 0


# --- queries and pipeline --------------------------------------------------------------------

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    result = duck.execute(queries.ORACLE[name])
    columns = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, result.fetchall())


@needs_data
@pytest.mark.parametrize("name", ["op1_license_scan", "op2_url_rules"])
def test_native_plans_run_no_python(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text


@needs_data
def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        left = {r.doc_id for r in docs.collect()}
        assert left <= ids and left, name
        ids = left
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in tokens.collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == tokens.count()


def test_pipeline_writes_tokens_in_training_order(spark):
    """The last stage's ids follow the mix, whichever tasks read its rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    mixed = kept(corpus_pipeline.mix(spark, kept(docs), SF).repartition(1).sortWithinPartitions("doc_id"))
    ordered = curriculum.training_rows(kept(docs)).select("doc_id")
    want = [r.doc_id for r in ordered.collect()]
    assert want != sorted(want) and len(set(want)) < len(want)
    for size in ("128MB", "4KB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            stored = kept(corpus_pipeline.mix(spark, kept(docs), SF))
            got = corpus_pipeline.tokens(spark, stored, SF).orderBy("start").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.doc_id for r in got] == want
    by_id = corpus_pipeline.tokens(spark, mixed, SF).orderBy("start").collect()
    assert [r.doc_id for r in by_id] == sorted(want)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    """NULLs in every column, empty and very long texts, repeated rows, unlabelled rows, clashing columns, no rows."""
    story = "The river was low that summer and the boats lay on the sand while children ran along the dry banks of it"
    rows = [
        (1, story, None, None, None), (1, story, None, None, None), (None, story + " again and again", None, "a", 3), (2, None, "en", "a", 0),
        (3, "", None, None, 0), (4, "12 34", "de", "b", 5), (5, " ".join(f"word{k}" for k in range(40_000)), None, "b", None),
    ]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(rows, shape)
    wide = frame.withColumns({c: F.lit(7) for c in ("id", "hash", "row", "size", "order", "file", "position")})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, kept(wide), SF).collect()
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out)
    named = lambda *found: sorted((i is not None, i or 0) for i in found)
    assert stage(spark, kept(frame.limit(0)), SF).count() == 0
    if name == "language":
        assert ids == named(None, 1, 1, 5)
    elif name == "simhash":
        assert {i for _, i in ids} >= {1, 4, 5} and len(ids) == len(set(ids))
    elif name == "mix":
        assert not {(True, 2), (True, 3)} & set(ids) and ids
    else:
        assert ids == named(None, 1, 1, 2, 3, 4, 5)


_STORY = "".join(f"<p>Paragraph {k} of the story, which goes on, and ends here.</p>" for k in range(5))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm><header>Site</header><div>{_STORY}</div><footer>x</footer></form></body>",
        f"<body><header><div>{_STORY}</div></header></body>",
        f"<body><header>Site name</header><form><p>Search here.</p></form><div>{_STORY}<form><p>Leave a reply, now.</p></form></div></body>",
        f"<body><article><header><p>Paragraph 0 of the story, which goes on, and ends here.</p></header>{_STORY[_STORY.index('</p>') + 4:]}</article><form>x</form></body>",
    ],
)
def test_forms_and_headers_weigh(page):
    assert html_text.main_text(page).split("\n") == [f"Paragraph {k} of the story, which goes on, and ends here." for k in range(5)]
