import re
import time

from threshline.llm import licenses

CASES = {
    None: (0, [], ""),
    "": (0, [], ""),
    "Released under the MIT License.": (5, [1], "mit"),
    "under the mit licensed": (4, [], ""),
    "Licensed under the Apache License, Version 2.0. Again: apache license version 2": (13, [3, 9], "apache-2"),
    "CC BY-NC 4.0 and cc-by-nc": (9, [0, 6], "cc-by-nc"),
    "released under the GNU General Public License, version 3.": (9, [], "gpl-3"),
    "GNU General Public License": (4, [], "gpl-unversioned"),
    "SPDX-License-Identifier: BSD-3-Clause": (6, [], "bsd-3-clause"),
    "under the KMIT license, İ é": (6, [], None),
    "Apache and mit are words": (5, [], ""),
}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = sorted(i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), at


def forms(tree, choice):
    """A text that a parsed pattern matches: optional parts left out, and of alternatives the one of that number."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            first = arg[0][1]
            out += chr(first[0] if isinstance(first, tuple) else first)
        elif name == "MAX_REPEAT":
            out += forms(arg[2], choice) * arg[0]
        elif name == "SUBPATTERN":
            out += forms(arg[3], choice)
        elif name == "BRANCH":
            out += forms(arg[1][min(choice, len(arg[1]) - 1)], choice)
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
    return out


def test_rules_are_many_and_gated():
    table = licenses.rules()
    gate = licenses.gate()
    assert len(licenses.SENTENCES.strip().splitlines()) > 200 and len(table) > 450
    for label, priority, confidence, key, pattern in table:
        assert 1 <= priority <= licenses.TIERS and 0 < confidence <= 1
        for choice in range(4):
            text = forms(re._parser.parse(pattern), choice) + " "
            assert re.search(pattern, text), pattern
            assert any(g in text for g in gate), (label, text)
            assert key in text, (label, key, text)


def test_signatures_find_their_texts(spark):
    """Every hand-written signature, as a text of its own, is detected under its label."""
    lines = [[c.strip() for c in x.split(" | ", 4)] for x in licenses.SENTENCES.strip().splitlines()]
    texts = [(i, forms(re._parser.parse(x[4]), 0).upper().replace(" ", " \n")) for i, x in enumerate(lines)]
    got = {r.id: {m.label for m in r.detections} for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    covered = 0
    for i, x in enumerate(lines):
        # unless a stronger rule covers it
        covered += x[0] not in got[i]
        assert got[i], x
    assert covered <= 12


def test_many_statements_in_a_long_text(spark):
    n = 40_000
    docs = spark.createDataFrame([(1, "licensed under the GPL version 3 and more words here. " * n), (2, "word " * 1_000_000)], "doc_id long, text string")
    began = time.time()
    (one, two) = licenses.scan(docs).selectExpr("id", "n_words", "size(detections) AS n", "try_element_at(detections, -1).start AS last").orderBy("id").collect()
    assert (one.n_words, one.n, two.n) == (10 * n, n, 0) and one["last"] >= 10 * (n - 1)
    assert time.time() - began < 120


def test_cases_and_brute_force(spark):
    texts = [*CASES, "x " * 30000 + "under the MIT license " * 500, "the\x00mit under the mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.createOrReplaceTempView("x")
    got = {r.id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        n, at = brute(t)
        assert (got[i].n_words, sorted(m.start for m in got[i].base)) == (n, at), t
        if t in CASES:
            assert (n, at) == CASES[t][:2]
            label = ",".join(sorted({m.label for m in got[i].detections} | {m.label for m in got[i].base}))
            if CASES[t][2] is not None:
                assert label == CASES[t][2], t


def test_contained_detections_are_suppressed(spark):
    docs = spark.createDataFrame([(1, "licensed under the gnu lesser general public license version 3")], "doc_id long, text string")
    (r,) = licenses.scan(docs).collect()
    assert [m.label for m in r.detections] == ["lgpl-3"]


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
