"""Mixture, URL filter, licence scan, queries and pipeline."""

from __future__ import annotations

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from evidentry.llm import licenses, mixture, queries, urls


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    total = share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level >= most * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * level for s in open_}}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.fixture(scope="module")
def sources(spark):
    rows, k = [], 0
    for s, n in (("a", 40), ("B", 900), ("c", 7), (None, 300), ("é", 1200), ("empty", 3)):
        for i in range(n):
            rows.append((k if k % 50 else None, "" if s == "empty" else " ".join(["w"] * (1 + (i * 7919) % 90)), s, "x"))
            k += 1
    rows += [(5000, "twin text here", "B", "x")] * 3 + [(5001, None, "B", "x"), (5002, "z " * 20_000, "é", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_mixture(spark, sources):
    rows = mixture.mix_report(sources, group_rows=64).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given = sources.collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r["doc_id"] or -1, size(r["text"])) for r in given)
    sizes: dict = {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    expected = plain_targets(sizes)
    for s, target in expected.items():
        mine = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 * (1 + target) and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= max((r["size"] for r in mine), default=0)
        assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in mine)
    again = mixture.mix_report(sources.repartition(7), group_rows=64).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    copies = mixture.mix(sources, group_rows=64)
    assert copies.columns == [*sources.columns, "copy", "mix_size", "mix_source_size", "mix_target"]
    total = {r[0]: r[1] for r in copies.groupBy("source").sum("mix_size").collect()}
    for s, target in expected.items():
        assert abs(total.get(s, 0) - target) <= max(r["size"] for r in rows if r["source"] == s)
    assert {r["copy"] for r in copies.collect()} >= {1, 2}
    again = mixture.mix(copies, group_rows=64)              # columns of an earlier mix are replaced
    assert again.columns == copies.columns
    assert mixture.mix_report(sources.limit(0)).count() == 0 and mixture.mix(sources.limit(0)).count() == 0


def test_pivotal_keeps_words():
    import numpy as np

    rng = np.random.default_rng(0)
    size, share = rng.integers(1, 500, 300), rng.random(300)
    mean = np.zeros(300)
    for _ in range(400):
        out, left = mixture.pivotal(size, share, rng.random(300))
        assert abs((size * out).sum() - (size * share).sum()) < 1e-4
        fractional = np.flatnonzero((out > 0) & (out < 1))
        assert list(fractional) in ([], [left])
        mean += out / 400
    assert np.abs(mean - share).max() < 0.15


RULES = queries.URL_RULES


def test_url_rules(spark):
    cases = {  # url: host, path, rule
        None: ("", "", None), "": ("", "", None), "no scheme/de/": ("", "", None), "http://x.net": ("x.net", "", None),
        "http://x.net/": ("x.net", "/", "net/"), "HTTP://A.Example.NET/en/1?q#f": ("a.example.net", "/en/1", "example.net/en/"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/"), "http://myexample.net/en/": ("myexample.net", "/en/", "net/"),
        "http://example.com/de/x": ("example.com", "/de/x", "example.com/de/"), "http://example.com/dex": ("example.com", "/dex", None),
        "http://a.org/fr/": ("a.org", "/fr/", "org/fr/"), "x://y://z/a": ("y:", "//z/a", None), "http://É.net/a\nb": ("É.net", "/a\nb", "net/"),
        "http://h.com?x/": ("h.com", "", None), "http:///p": ("", "/p", None)}
    rows = [(i, u, "clash") for i, u in enumerate(cases)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(frame, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == list(cases.values())[r["page_id"]]
        if r["rule"]:
            assert r["verdict"] == ("block" if r["rule"] in ("net/", "example.com/de/") else "allow")
        assert r["verdict"] in ("allow", "block")
    assert urls.judge(frame.limit(0), RULES).count() == 0


def test_url_templates(spark):
    rows = []
    for i in range(40):
        rows += [(f"http://h.com/shop/{i}", 1), (f"http://h.com/news/{i}.html", 0), (f"http://h.com/news/x{i}/deep/a/b/c/d/e/{i}", 0)]
    rows += [(f"http://h.com/shop/{1000 + i}", None) for i in range(5)] + [("http://h.com/news/77.html", None), ("http://h.com/misc/1", None)]
    rows += [(f"http://wide.com/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/p", 1) for i in range(60)] + [("http://wide.com/user-zz/p", None)]
    frame = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r["page_id"]: r for r in urls.judge(frame, (), label="bad").collect()}
    by_url = {u: got[i] for i, (u, _) in enumerate(rows)}
    assert by_url["http://h.com/shop/1003"]["verdict"] == "block" and by_url["http://h.com/news/77.html"]["verdict"] == "allow"
    assert by_url["http://h.com/misc/1"]["verdict"] == "allow" and by_url["http://wide.com/user-zz/p"]["verdict"] == "block"
    assert by_url["http://h.com/shop/1"]["template"] == "h.com/shop/{n}"
    assert by_url["http://wide.com/user-aa/p"]["template"] == by_url["http://wide.com/user-bb/p"]["template"]
    assert {r["verdict"] for r in urls.judge(frame, ()).collect()} == {"allow"}


def test_unlabelled_branches_take_their_parents_share(spark):
    """Sites with impure labelled pages reject their other pages too; sites without labels, and the rules' own pages, are as before."""
    rows = [(f"http://bad.com/de/{i}", 1) for i in range(30)] + [("http://bad.com/en/1", None), ("http://bad.com", None)]
    rows += [(f"http://good.com/de/{i}", 0) for i in range(30)] + [("http://good.com/en/1", None), ("http://new.com/de/1", None)]
    rows += [(f"http://mixed.com/{'de' if i % 2 else 'fr'}/{i}", i % 2) for i in range(60)] + [("http://mixed.com/es/1", None), ("http://mixed.com/de/999", None)]
    got = {u: r["verdict"] for (u, _), r in zip(rows, sorted(urls.judge(spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int"), (), label="bad").collect(), key=lambda r: r["page_id"]), strict=True)}
    assert [got[f"http://{u}"] for u in ("bad.com/en/1", "bad.com", "good.com/en/1", "new.com/de/1", "mixed.com/es/1", "mixed.com/de/999")] == [
        "block", "block", "allow", "allow", "allow", "block"]


def test_hidden_rule_verdicts_come_back(spark, sf):
    """Of the pages that a rule decides, a third loses its label; the tree gives most of their verdicts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    truth = urls.judge(pages, queries.URL_RULES).where("rule is not null").select("page_id", (F.col("verdict") == "block").cast("int").alias("truth"))
    hidden = F.pmod(F.crc32(F.col("page_id").cast("string")), F.lit(3)) == 0
    found = urls.judge(pages.join(truth, "page_id", "left").withColumn("y", F.when(~hidden, F.col("truth"))), (), label="y").join(truth, "page_id").where(hidden)
    right = [(r["verdict"] == "block") == bool(r["truth"]) for r in found.collect()]
    assert sum(right) >= 0.75 * len(right) > 10


def test_licences(spark, odd):
    scanner = licenses.train(spark)
    lines = {"Released under the MIT License.": "mit", "© 2021 Foo. Licensed under the Apache License, Version 2.0, see NOTICE.": "apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0", "The ISC License applies to this text.": "isc",
             "SPDX-License-Identifier: GPL-2.0-only": "gpl", "Distributed under the terms of the Zephyr license.": "unknown",
             "A boost for the economy.": None,
             "ALL RIGHTS RESERVED.": "proprietary", "Licensed under the Quux Wombat License.": "unknown",
             "She got her driver license.": None, "mit der Zeit": None, "The seats are reserved for us.": None}
    texts = [(i, f"first\n{line}\nlast") for i, line in enumerate(lines)] + [(90, "x\n" * 50_000 + "Licensed under CC BY 4.0.\n" + "y\n" * 50_000)]
    frame = spark.createDataFrame([(*t, "clash") for t in texts] + [(0, texts[0][1], "")], "doc_id long, text string, family string")
    got = licenses.scan(frame, scanner).collect()
    assert {r["doc_id"]: r["family"] for r in got if r["doc_id"] < 90} == {i: f for i, f in enumerate(lines.values()) if f}
    assert [(r["paragraph"], r["family"]) for r in got if r["doc_id"] == 90] == [(50_001, "cc-by")]
    assert sum(r["doc_id"] == 0 for r in got) == 2
    # held-out variations of known notices keep their family
    held = [(i, t, f) for i, (t, f, fold) in enumerate(licenses.examples()) if fold and f not in ("unknown", "none")]
    frame = spark.createDataFrame(held, "doc_id long, text string, truth string")
    found = {r["doc_id"]: r["family"] for r in licenses.scan(frame, scanner).collect()}
    assert sum(found.get(i) == f for i, _, f in held) >= 0.85 * len(held)
    assert licenses.scan(odd, scanner).count() == 0 and licenses.scan(odd.limit(0), scanner).count() == 0


def test_wrapped_licences(spark):
    notices = [(f, n) for f, ns in licenses.NOTICES.items() for n in ns if len(n.split()) >= 12]
    texts, wanted = [], []
    for width, margin in ((48, "# "), (60, " * "), (72, ""), (72, "    ")):
        for family, notice in notices:
            lines = textwrap.wrap(notice, width)
            wanted.append((len(texts), 3, family, len(lines)))
            texts.append((len(texts), "Title\n\n" + "\n".join(margin + x for x in lines) + "\n\nShort line\nAnother sentence."))
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), licenses.train(spark)).collect()
    # one row each, over all lines that the notice was wrapped into
    assert sorted((r["doc_id"], r["paragraph"], r["family"], len(r["line"].split("\n"))) for r in got) == wanted


def plain_paragraphs(text):
    out, lines = [], text.split("\n")
    for i, line in enumerate(lines):
        before = lines[i - 1].rstrip(" \t\r") if i else ""
        wrapped = len(before) >= licenses.WRAP_COLUMNS and before[-1] not in ".!?:\x0b\x0c" and "SPDX" not in lines[i - 1]
        if wrapped and line.strip(" \t\r\x0b\x0c").lstrip(" \t#/*;>-"):
            out[-1] = (out[-1][0], out[-1][1].rstrip(" \t\r") + "\n" + line)
        else:
            out.append((i + 1, line))
    return out


def test_paragraphs(spark):
    long = "a line that is long enough to have been wrapped by hand"
    texts = ["", "one", f"{long}\nnext", f"{long}.\nnext", f"{long}  \r\n# next\n", f"{long}\n\nnext", f"{long}\n{long}\n{long}\nend\nmore",
             f"// SPDX-License-Identifier: MIT AND {long}\nnext", f"{long}\n---\n{long}", f"12{long}\n34 {long}\n5", "x\n" * 50 + long, f"{long}\n" * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: [(p["paragraph"], p["line"]) for p in r["p"]] for r in frame.select("i", licenses.paragraphs(F.col("t")).alias("p")).collect()}
    assert got == {i: plain_paragraphs(t) for i, t in enumerate(texts)}


def test_queries_and_pipeline(spark, sf):
    import __spark_entry__ as entry
    import corpus_pipeline

    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    out = entry.queries()["pipeline"](spark, sf)
    assert out.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars", "copy"} <= set(out.columns)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # a column of the user's that is called like a score, and none called n_chars
    own = docs.drop("n_chars").withColumn("toxicity", F.lit("mine"))
    assert {r["toxicity"] for r in corpus_pipeline.drop_toxic(spark, own, sf).collect()} == {"mine"}
    assert corpus_pipeline.cut_repeats(spark, own, sf).columns == own.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
