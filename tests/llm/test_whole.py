"""The whole job: near copies, links, pages and rows that earlier rounds left out."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import html, jaccard, sharding, vectors


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_near_copies_by_five_words(spark, monkeypatch):
    """Chains of near copies, small parts; all links of brute force, and those that 2 bits miss."""
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two")]
    for g in range(12):
        t = words(rng, 120)
        for i in range(15):
            rows.append((10 + 20 * g + i, " ".join(t)))
            t = list(t)
            if g < 6:
                t[rng.randrange(120)] = f"x{g}{i}"  # each close to the one before only
            else:
                t[(7 * i) % 120 : (7 * i) % 120 + 12] = words(rng, 12)
    want = jaccard.brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part in (1000, 7):
        monkeypatch.setattr(jaccard, "PART", part)
        assert {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {d for d, c in want.items() if d == c} and len(kept) <= 100
    assert jaccard.near_copies(docs.where("false")).count() == 0


def test_copies_are_dealt_apart(spark):
    """Two copies share a shard 1 time in 8, and a row that is a third of the table lies all over its shards."""
    rows = [(i, f"t{i}") for i in range(400)] * 2 + [(1000, "hot")] * 400
    out = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8).collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    at, order = collections.defaultdict(list), collections.defaultdict(dict)
    for r in out:
        at[r.doc_id].append(r.shard)
        order[r.shard][r.slot] = r.doc_id == 1000
    assert all(sorted(x) == list(range(150)) for x in order.values())
    assert sum(x[0] == x[1] for d, x in at.items() if d < 1000) < 100
    for x in order.values():
        seen = [x[i] for i in range(150)]
        assert 20 < sum(seen) < 80 and sum(a != b for a, b in zip(seen, seen[1:], strict=False)) > 35


def partners(rng, x, cosine=0.9):
    """Unit vectors at the cosine to the rows of x."""
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    return cosine * x + (1 - cosine**2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [20_000, 100_000, 1_000_000])
@pytest.mark.parametrize("kind", ["centred", "off-centre", "hot cluster"])
def test_pairs_meet_in_cells(n, kind):
    """Recall of the cells at the threshold, for vectors off the centre and in a cluster."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, 64))
    if kind == "off-centre":
        x += 12 * np.eye(64)[0]
    if kind == "hot cluster":
        x[:3000] = 40 * np.eye(64)[1] + 0.75 * x[:3000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = vectors.Plan(64, n, rng.permutation(x), 0.9)
    mine = x[:3000]
    assert (plan.cells(mine) == plan.cells(partners(rng, mine))).any(1).mean() >= 0.993


def test_pairs_in_a_cell_reach_the_count():
    """No single projection decides: 99.5 % of links at the threshold are found in a cell, whole or in two parts."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    both = np.concatenate((x, partners(rng, x, 0.9 + 1e-9)))
    plan, one = vectors.Plan(64, 10, x[:0], 0.9), np.ones(len(both), np.int64)
    for part, parts in ((0 * one, (0, 0)), (np.repeat([0, 1], 2500), (0, 1))):
        degree, labels = vectors.near_in_cell(both, one, part, parts, 0, plan, 0.9)
        assert degree.sum() / len(both) >= 0.995 and (labels[2500:] == np.arange(2500)).mean() >= 0.995


def test_every_page_of_a_host_counts(spark):
    """Copies and shared headings come first; later pages differ, and none of their text is lost."""
    body = "<html><body><div class='top'>Site</div><div><h1>{0}</h1><p>{1}</p><p>More: {1}</p></div></body></html>"
    same = [(i, "http://a.example/", body.format("Head", "The same long paragraph, again and again.")) for i in range(9)]
    late = [(i, "http://a.example/", body.format(f"Title {i}", f"Paragraph number {i}, which is new on this page.")) for i in range(9, 12)]
    only = [(i, "http://b.example/", "<html><body><p>Only one text here.</p></body></html>") for i in range(20, 24)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(same + late + only, "page_id long, url string, html string")).collect()}
    assert all("The same long paragraph, again and again." in got[i] and "Head" in got[i] for i in range(9))
    assert all(f"Title {i}" in got[i] and f"Paragraph number {i}, which" in got[i] for i in range(9, 12))
    assert not any("Site" in got[i] for i in range(12)) and {got[i] for i in range(20, 24)} == {"Only one text here."}


def extracted(spark, pages, url="http://s.example/"):
    rows = [(i, url, h) for i, h in enumerate(pages)]
    return {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit("x")).withColumn("host", F.lit(1))).collect()}


def prose(rng, n):
    return " ".join(words(rng, n))


def test_template_text_goes_inside_the_article_too(spark):
    rng = random.Random(6)
    told = [(prose(rng, 6), prose(rng, 30), prose(rng, 25)) for _ in range(8)]
    marked = "<body><article><h1>{0}</h1><p>{1}</p><p>Subscribe to our letter today</p><p class='share'>{2}</p></article></body>"
    plain = "<body><div><h1>{0}</h1><p>{1}</p><p>{2}</p><p>All rights reserved by Foo</p></div></body>"
    for shape in (marked, plain):
        got = extracted(spark, [shape.format(*t) for t in told])
        assert [got[i] for i in range(8)] == ["\n\n".join(t) for t in told]
    # near copies share most of their text, which is no template; two pages are too few to tell
    got = extracted(spark, [marked.format("Same head", told[0][1], f"Line {i}") for i in range(4)])
    assert all(told[0][1] in got[i] and f"Line {i}" in got[i] for i in range(4))
    assert "Subscribe" in extracted(spark, [marked.format(*t) for t in told[:2]])[0]


def test_deep_and_hostile_markup(spark):
    deep = "<body><article><p>Before the depth.</p>" + "<div>" * 10_000 + "The text at the bottom." + "</div>" * 10_000 + "<p>After the depth.</p></article></body>"
    spans = "<body><p>" + "<span>" * 5_000 + "word" + "</span>" * 5_000 + " end</p></body>"
    quotes = "<body><p>Some text.</p>" + "<a href=\"x' " * 20_000 + "</body>"
    got = extracted(spark, [deep, spans, quotes], None)
    assert got[0].split("\n\n") == ["Before the depth.", "The text at the bottom.", "After the depth."]
    assert got[1] == "word end" and got[2].startswith("Some text.")


def test_squares_become_groups():
    """A run of siblings that comes once more is one repeated group, whatever its length in a page."""
    section = "<h2>{0}</h2><p>{1}</p><pre>{2}</pre>"
    pages = ["<body><div>" + "".join(section.format(f"h{i}{j}", f"p{i}{j}", f"c{i}{j}") for j in range(2 + i)) + "<hr></div></body>" for i in range(4)]
    w = html.infer([html.parse(p) for p in pages])
    group = w.children[0].children[0].children
    assert [c.key[0] for c in group] == ["h2", "p", "pre", "hr"] and [c.repeated for c in group] == [True, True, True, False]
    assert [c.seen for c in group] == [2 + 3 + 4 + 5] * 3 + [4]
    # by brute force: each page is one word of the expression (h2 p pre)+ hr
    for p in pages:
        keys = [c.key[0] for c in html.parse(p).children[0].children[0].children]
        assert keys == ["h2", "p", "pre"] * ((len(keys) - 1) // 3) + ["hr"]


def test_rows_that_share_an_id(spark):
    """SimHash: one class per fingerprint, whatever ids repeat; the stage keeps one row of each repeated text, and rows without an id."""
    from sluiceway.llm import simhash

    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, a), (5, b), (3, a), (7, c), (7, c), (None, c), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Tag", F.lit("x")).repartition(3)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fp = lambda t: int(np.uint64(simhash.fingerprint(t)).astype(np.int64))
    assert got[5, fp(a)] == 3 and got[5, fp(b)] == 5 and got[7, fp(c)] == 7 and got[None, fp(c)] == 7 and got[8, 0] == got[9, 0] == 8
    want = sorted([(3, a), (5, b), (7, c), (None, c), (8, None)], key=str)
    for stage in (simhash.drop_near_duplicates, jaccard.drop_near_copies):
        out = stage(docs)
        assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want


def test_mixing_takes_repeated_rows_together(spark):
    from sluiceway.llm import mixing

    rows = [(i // 2, " ".join(["w"] * (5 + i // 2 % 7)), "ab"[i // 2 % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_table(docs).collect()
    assert len(out) == 400 and len({(r.doc_id, r.copies) for r in out}) == 200
    for source in "ab":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    again = sorted((r.doc_id, r.copies) for r in mixing.mix_table(docs.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.copies) for r in out)


def test_vectors_of_any_scale_and_type(spark):
    """Huge and tiny vectors link by their direction; floats and doubles are compared as they are; one length each."""
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(1, base), (2, [x * 1e200 for x in base]), (3, [x * 1e-200 for x in base]), (4, [-x for x in base]), (5, base[:3]), (6, [float("nan"), 1.0, 1.0, 1.0]), (7, None), (8, [0.0] * 4), (9, [1.0, None, 2.0, 3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), **{i: (0, i) for i in range(4, 10)}}
    floats = spark.createDataFrame(rows[:1] + [(2, base)] + rows[3:], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(floats).collect()}
    assert got[1] == got[2] == 1 and got[4] == got[6] == got[7] == got[9] == 0


def test_one_python_worker_for_each_core(spark, monkeypatch):
    """Near-dedup and language id: no stage of two Python steps, and no rows that pass through Python workers of RDDs."""
    import corpus_pipeline
    from pyspark import RDD
    from sluiceway.llm import common, components, langid, simhash

    def most(node, above):
        """Python steps between two exchanges, at most."""
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(node.initialPlan(), above)
        here = 0 if "Exchange" in name else above + bool(re.search("InArrow|InPandas|EvalPython", name))
        below = node.children()
        return max([here, *(most(below.apply(i), here) for i in range(below.size()))])

    seen = []

    def watched(df):
        seen.append(most(df._jdf.queryExecution().executedPlan(), 0))
        return common.written(df)

    rng = random.Random(8)
    texts = [" ".join(words(rng, 30)) for _ in range(40)]
    rows = [(i, "abc"[i % 3], t if i % 4 else texts[0] + " more") for i, t in enumerate(texts * 3)]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    for module in (components, jaccard, simhash):
        monkeypatch.setattr(module, "written", watched)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.count() == len({t for _, _, t in rows}) and max(seen) == 1
    monkeypatch.setattr(RDD, "_to_java_object_rdd", lambda self: pytest.fail("rows pass through Python workers of RDDs"))
    assert langid.keep_identified(docs).count() == len(rows)
    assert langid.keep_identified(docs.where("false")).count() == 0
