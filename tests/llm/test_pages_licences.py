"""Main text of pages, and licence recognition."""

import html as entities
import re

import pytest
from conftest import SMALL

from needmap.llm import html, licences
from needmap.llm.common import importable
from needmap.llm.queries import ORACLE, QUERIES
from workbench.check import connect, difference

LONG = "This paragraph belongs to the story and runs on for a good while, as paragraphs do. "


def test_given_pages_give_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op10_html_main_text"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(entities.unescape(re.sub("</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("<!-- x -->", ""), ("<script>var a = '<p>no</p>'", ""), ("Only words", "Only words"), ("a &lt;b&gt; &#233;&amp", "a <b> é&"),
    ("<article><h1>T</h1><nav>menu</nav><p>x<b>y</b><p>z</article><p>" + LONG, "T xy z"),
    ("<article><header><h1>Title</h1></header><p>x</p><div class='share'>share me</div><section id=comments><p>" + LONG + "</p></section></article>", "Title x"),
    ("<ul class=menu><li><a>Home</a><li><a>News of all the kinds there are and more</a></ul><div>" + LONG * 2 + "</div><p>Short.</p><p>" + LONG + "</p><form>Mail</form><div class='cookie-notice'>" + LONG + "</div><footer>c</footer>", (LONG * 2 + "Short. " + LONG).strip()),
    ("<div><a href=x>" + "link words here " * 9 + "</a></div><p>" + LONG + "</p>", LONG.strip()),
    ("<body><div class='layout has-sidebar'><article><p>" + LONG + "</p></article><div class=sidebar>side</div></div>", LONG.strip()),
    ("<div class='layout sidebar-left'><div class=menu><a>Home</a></div><article><p>" + LONG + "</p></article></div>", LONG.strip()),
    ("<div id='search-page'><p>" + LONG + "</p><p>" + LONG + "</p></div>", (LONG * 2).strip()),
    ("<div id='search-page'><p>" + LONG + "</p><div class=related><p>More</p></div><p>" + LONG + "</p></div><p class=share>x</p>", (LONG * 2).strip()),
    ("<article><p>one</p><svg class=x /><p>two</p><math/><p>three</p></article>", "one two three"),
    ("<form><select><option>1</form><article><p>one</p></article>", "one"),
    ("<select><option>1<article><p>one</p></article><select><option>2</select>", "one"),
    ("<title>T<body><p>" + LONG, LONG.strip()),
    ("<canvas><p>" + LONG + "</p><object data=x><p>" + LONG, (LONG * 2).strip()),
    ("<p>" + LONG + "</p><p><a href=x>a link</a></p><p>" + LONG + "</p><div class='reader-comments'><p>" + LONG * 9 + "</p></div>", LONG + "a link " + LONG.strip()),
    ("<main>one<br>two\n three&nbsp;four<svg><text>no</text></svg></main><aside>five</aside>", "one two three four"),
])
def test_page_parts(page, text):
    assert html.main_text(page) == text


def test_page_edges(spark):
    importable(spark)
    df = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (2, "<p>" + "word " * 60_000, None)], "page_id long, html string, TEXT string")
    out = html.with_main_text(df)
    assert out.columns == ["page_id", "html", "text"]
    assert sorted((r.page_id, len(r.text)) for r in out.collect()) == [(1, 0), (1, 0), (2, 299_999)]
    assert html.with_main_text(df.limit(0)).count() == 0


def test_licence_twin(spark):
    assert difference(spark, connect(SMALL), QUERIES["op6_licence_scan"], ORACLE["op6_licence_scan"], SMALL) is None


def test_every_sentence_has_a_word_that_lets_its_text_in():
    assert all(any(w in s for w in licences.WORDS) for s in licences.SENTENCES)
    assert {p for _, parts in licences.RULES for p in parts} <= set(licences.SENTENCES.values())


def test_whole_licences_notices_and_edges(spark):
    mit = (
        "Copyright (c) 2020 A. N. Other\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
        "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\n"
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.\n"
    )
    rows = [
        (1, mit), (2, "Prose.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nMore"), (3, "The word license alone"), (4, None), (5, ""), (5, ""),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (7, "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F
    out = licences.with_licences(df.withColumn("Licences", F.lit(1)).withColumn("by_text", F.lit(2)))
    assert out.columns == ["doc_id", "text", "by_text", "licences", "licence_sentences"]
    got = {r.doc_id: (r.licences, r.licence_sentences) for r in out.collect()}
    assert got[1] == (["MIT"], ["mit.grant", "mit.condition", "mit.warranty"])
    assert got[2] == (["CC-BY-NC-4.0", "MIT"], ["mit.notice", "cc-by-nc4.notice"])
    assert got[3] == got[4] == got[5] == ([], []) and got[6] == ([], ["bsd.grant"]) and got[7][0] == ["Apache-2.0"]
    assert out.count() == len(rows) and licences.with_licences(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "names"), [
    ("This code is released under the MIT License.", "MIT"), ("Some words. This software is licensed under the terms of the MIT licence, see the LICENSE file.", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "GPL-2.0-only"), ("# SPDX-License-Identifier: LGPL-2.1+\n", "LGPL-2.1-or-later"), ("SPDX-License-Identifier:  CC-BY-SA-3.0", "CC-BY-SA-3.0"),
    ("All code in this repository is distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This data is made available under the Eclipse Public License v2.0", "EPL-2.0"), ("Licensed under CC0 1.0", "CC0-1.0"), ("The work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
    ("I was licensed under the sea, and released under the terms of my bail.", ""), ("The licence under which we sail", ""), ("x " * 200_000 + "\nlicensed under the MIT license", "MIT"),
])
def test_notices(spark, tmp_path, text, names):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert ",".join(licences.with_licences(df).first().licences) == names
    df.write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert con.execute(licences.SQL).fetchall()[0][1] == names
