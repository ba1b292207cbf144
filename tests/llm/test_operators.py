"""The ten operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from sluiceway.llm import common, components, decontaminate, html, jaccard, langid, mixing, quality, queries, sharding, simhash, sketch, substrings, suffixes, vectors

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empties, copies, near copies, shared passages, one very long text, ties."""
    rng = random.Random(4)
    shared = words(rng, 60)
    out = [(0, None, None, None), (1, "", "en", "a"), (2, "   \t\n", None, "a"), (3, "one", "en", None), (4, "ünï ¡cödé! 日本 語", "xx", "b")]
    for i in range(5, 60):
        t = words(rng, rng.randrange(5, 120))
        if i % 4 == 0:
            t += "\n" + shared + " " + words(rng, 5)
        if i % 9 == 0:
            t = out[-1][1]
        if i % 10 == 0:
            t = (out[-1][1] or "") + " tail"
        out.append((i, t, ("en", "de")[i % 2], "abc"[i % 3]))
    out.append((60, "To " * 400 + words(rng, 30), "en", "c"))
    out.append((61, words(rng, 6000, 5000) + " " + shared, "de", "c"))
    return [(*r, 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# 1


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    gold = dict(zip(labels["doc_id"], labels["quality"], strict=True))
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d in gold if got[d].held_out]
    assert sum(got[d].predicted == gold[d] for d in held) / len(held) >= 0.93


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(5, 60)] + [(6, None, 0), (5, 1, 0)], "doc_id long, quality int, score int")
    out = quality.classify(docs.withColumn("score", F.lit("x")).withColumn("quality", F.lit(1)), labels).collect()
    assert len(out) == 62 and all(0 <= r.score <= 1 for r in out)
    one = quality.classify(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_quality_network_learns_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality.Network(x, y, epochs=80)
    assert ((net.score(x) > 0.5) == y).mean() > 0.9 and net.temperature > 0


# 2


def check_shards(out, n, shards=8):
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, docs, empty, rows):
    out = queries.op2_sharding(spark, DATA).collect()
    check_shards(out, 200)
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" for r in out)
    again = {(r.doc_id, r.shard, r.slot) for r in queries.op2_sharding(spark, DATA).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out}
    twice = docs.union(docs).withColumn("shard", F.lit("old")).withColumn("row", F.lit(1)).withColumn("tie", F.lit(1))
    got = sharding.shuffle_into_shards(twice, 5)
    assert got.columns == [*docs.columns, "row", "tie", "shard", "slot"]
    out = got.collect()
    check_shards(out, 2 * len(rows), 5)
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((r[0], r[1]) for r in rows * 2)
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_hypergeometric_draws(spark):
    col = lambda x: F.lit(x).cast("long")
    k = np.array([r[0] for r in spark.range(4000).select(sharding.hypergeometric(col(50), col(300), col(1000), F.rand(3))).collect()])
    want = np.random.default_rng(1).hypergeometric(300, 700, 50, 4000)
    assert abs(k.mean() - want.mean()) < 0.3 and abs(k.std() - want.std()) < 0.2
    edge = spark.range(1).select(*(sharding.hypergeometric(col(n), col(g), col(t), F.lit(0.999999)) for n, g, t in ((0, 5, 9), (9, 5, 9), (3, 0, 9), (3, 9, 9), (0, 0, 0))))
    assert list(edge.first()) == [0, 5, 0, 3, 0]


def test_shuffle_is_uniform(spark):
    """Each row lands in each shard about equally often over seeds."""
    df = spark.range(40).withColumnRenamed("id", "doc_id")
    seen = collections.Counter()
    for seed in range(12):
        seen.update((r.doc_id < 20, r.shard) for r in sharding.shuffle_into_shards(df, 2, seed=seed * 10).collect())
    assert all(80 < seen[low, s] < 160 for low in (True, False) for s in (0, 1))


# 3


def test_decontamination(spark, docs, empty, rows):
    text = dict(pairs(rows))
    items = [(1, " ".join(text[8].split()[-30:])), (2, text[61][:300].upper()), (3, "one"), (4, None), (5, ""), (6, "!!!"), (7, text[61][:300]), (None, "w1 w2"), (9, "never seen here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute_force(pairs(rows), [i for i in items if i[0] is not None])
    for limit in (decontaminate.MAX_PATTERN_WORDS, 400):  # one automaton, or several
        got = decontaminate.contamination(docs.withColumn("n_hit", F.lit(0)), bench, max_pattern_words=limit)
        assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(want)
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == {w[0] for w in want if not w[5]} and 0 < len(clean) < len(rows)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.where("false")).collect())


def test_offsets_point_into_the_original():
    a = decontaminate.automaton(decontaminate.windows([(1, "alpha beta gamma")]))
    text = "Ünder, ALPHA -- beta\n\ngamma; x"
    n, ranges, ids, spans = decontaminate.scan(a, text)
    assert (n, ranges, ids) == (5, [(1, 4)], {"1"})
    assert text.encode()[spans[0][0] : spans[0][1]].decode() == "ALPHA -- beta\n\ngamma"


# 4

PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Site name</a></header><nav><ul>{nav}</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="layout"><{tag}><h1>Title {n}</h1><p>First &amp; line {n}<br>goes &#111;n.<p>Second <b>bold</b> para{n}.</p>{more}<script>x()</script></{tag}>
<aside>Related things</aside><section class="comments"><p>Reader {n} says hi</p></section></div><form><p>Sign up</p></form><footer><p>&copy; 2020</p></footer></body></html>"""


def page(n, tag="article", items=3, more=""):
    return PAGE.format(n=n, tag=tag, nav="".join(f"<li><a href='/{n}{i}'>nav {n} {i}</a></li>" for i in range(items)), more=more)


def test_html_extraction(spark):
    table = "<table><tr><td>a</td><td>b</td></tr></table>"
    rows = [(i, "http://h.example/x", page(i, more=table if i % 2 else "")) for i in range(12)]
    rows += [(20, None, None), (21, "http://h.example/", ""), (22, "x", "just < text &lt;b&gt;"), (23, "http://lone.example/a", page(23, "main")), (24, "http://lone.example/a", page(23, "main"))]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        want = [f"Title {i}", f"First & line {i} goes on.", f"Second bold para{i}."] + (["a", "b"] if i % 2 else [])
        assert got[i] == "\n\n".join(want)
    assert got[20] == "" and got[21] == "" and got[22] == "just < text <b>"
    assert got[23] == got[24] == "Title 23\n\nFirst & line 23 goes on.\n\nSecond bold para23."
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_finds_groups():
    w = html.infer([html.parse(page(i, items=2 + i, more="<ul><li>x</li></ul>" if i else "")) for i in range(3)])
    node = lambda x, *keys: node(next(c for c in x.children if keys[0] in c.key), *keys[1:]) if keys else x
    body = node(w, "html", "body")
    assert node(body, "nav", "ul", "li").repeated
    article = node(body, "layout", "article")
    assert node(article, "ul").optional(3) and not node(article, "h1").optional(3)
    assert node(article, "h1").children[0].text is False and node(body, "footer", "p").children[0].text == "© 2020"


def test_page_without_article_uses_the_largest_slots(spark):
    rows = [(i, "http://d.example/", page(i, "div")) for i in range(5)]
    for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Title {r.page_id}\n\nFirst & line {r.page_id} goes on.\n\nSecond bold para{r.page_id}."


# 5


#: Repeated ids with equal and with different texts, and rows without an id.
def odd_rows(rng):
    t, u = words(rng, 70), words(rng, 50)
    return [(200, t), (200, t), (201, "first " + u), (201, u), (202, t + " " + u), (None, t), (None, u), (203, None), (203, u)]


def test_suffix_dedup(spark, docs, empty, rows, monkeypatch):
    extra = [(62, "é" * 40 + "\0" * 60), (63, "x" + "é" * 40 + "\0" * 60), (64, "a" * 500), (65, "b" + "a" * 200), (65, "b" + "a" * 200), *odd_rows(random.Random(8))]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("Tag", F.lit("x")).withColumn("marks", F.lit(1))
    want = suffixes.brute_force([*pairs(rows), *extra])
    for hot in (sketch.HOT, 3):  # from three documents on, grams are dealt by whole strings
        monkeypatch.setattr(sketch, "HOT", hot)
        got = suffixes.remove_repeats(every).withColumn("h", F.sha2("kept", 256)).select("doc_id", "n_bytes", "n_removed", "n_spans", "h")
        key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and sum(w[2] for w in want) > 1000
    assert suffixes.remove_repeats(empty).count() == 0


def test_texts_are_shuffled_once(spark, docs):
    """The exchange of the texts that meets the sketch's replies also meets the spans."""
    out = suffixes.remove_repeats(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(2)
    runs = []
    for _ in range(7):
        keys = sorted(bytes(rng.randrange(2) for _ in range(suffixes.KEY)) if rng.random() < 0.5 else bytes(suffixes.KEY) for _ in range(rng.randrange(1, 30)))
        table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, suffixes.KEY)
        shared, rest = suffixes.front_code(table)
        assert suffixes.decode(shared, rest) == keys
        runs.append((keys, shared.tolist()))
    out = [(runs[r][0][i], share) for r, i, share in suffixes.merge_runs(runs)]
    assert [k for k, _ in out] == sorted(k for keys, _ in runs for k in keys)
    for (a, _), (b, share) in zip(out, out[1:], strict=False):
        assert share == suffixes.common(a, b, 0)


# 6


def test_substring_dedup(spark, docs, empty, rows):
    extra = odd_rows(random.Random(8))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = substrings.remove_repeats(every.withColumn("spans", F.lit(1)).withColumn("TAG", F.lit(1))).withColumn("h", F.sha2(F.col("kept").cast("binary"), 256))
    want = substrings.brute_force([*pairs(rows), *extra])
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "h").collect()), key=key) == sorted(want, key=key) and sum(w[2] for w in want) > 300
    # rows that repeat keep their text: nothing of them starts earlier
    assert [w[2] for w in want if w[0] == 200] == [0, 0] and [w[2] for w in want if w[0] is None] == [0, 0]
    assert substrings.remove_repeats(empty).count() == 0


def test_substring_dedup_of_a_long_text(spark):
    rng = random.Random(5)
    t = words(rng, 300_000, 10**6)
    rows = [(1, words(rng, 40)), (2, t), (3, t[len(t) // 2 :] + " end")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("h", F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "h").collect())) == substrings.brute_force(rows)


def test_sketch_never_falls_short(spark, monkeypatch):
    """Hashes counted over chunks and segments: none that occurs twice is missed, few others pass, the hot are known."""
    rng = np.random.default_rng(3)
    h = (rng.integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    df = spark.createDataFrame([(i, 0, "") for i in range(40)], "doc_id long, tag long, text string").repartition(4)

    def anchors(batches):
        for b in batches:
            for i in b.column("doc_id").to_pylist():
                x = np.concatenate((h[i::40], h[(i // 2) : 200 : 20], h[:3]))
                yield np.array([i]), np.array([0]), np.array([len(x)]), x

    monkeypatch.setattr(sketch, "HOT", 40)
    monkeypatch.setattr(sketch, "FLUSH", 300)
    for expected in (100, 5 * sketch.PER_SEGMENT):
        got = {r.doc_id: r.marks for r in sketch.repeated_anchors(df, anchors, expected).collect()}
        wrong = total = 0
        for i in range(40):
            x = np.concatenate((h[i::40], h[(i // 2) : 200 : 20], h[:3]))
            m = sketch.read_marks(got[i], len(x))
            twice = np.isin(x, h[:200])
            assert (m[twice] > 0).all() and (m[np.isin(x, h[:3])] == 2).all()
            wrong, total = wrong + int((m[~twice] > 0).sum()), total + int((~twice).sum())
        assert wrong < 0.02 * total
        once = sketch.repeated_anchors(df.where("doc_id = 0"), anchors, expected, once=True).count()
        assert once == 0  # what repeats within one document counts once


# 7


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    near = [base[i % 20] + rng.normal(size=16) * 0.15 for i in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near])]
    rows += [(200, None), (201, [0.0] * 16), (202, [1.0, None]), (203, [float("nan")] * 16), (204, [float("inf")] * 16), (205, []), (206, rows[3][1]), (207, [2 * x for x in rows[3][1]]), (208, [1.0] * 4), (209, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == vectors.brute_force(rows) and max(n for n, _ in got.values()) > 3
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_embedding_cells_and_parts(spark, monkeypatch):
    """Several rounds of cells, and cells cut into parts, count every link once."""
    monkeypatch.setattr(vectors, "CELL", 20)
    monkeypatch.setattr(vectors, "PART", 15)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(10, 24))
    rows = [(i, (centre[i % 10] + rng.normal(size=24) * 0.08).tolist()) for i in range(300)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = vectors.brute_force(rows)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


# 8


def test_mixing(spark, docs, empty, rows):
    out = mixing.mix_table(docs.withColumn("size", F.lit("x")).withColumn("rank", F.lit(0)))
    c = duckdb.connect()
    table = out.toPandas()
    c.register("documents", docs.toPandas())
    want = c.sql(mixing.ORACLE).fetchall()
    assert sorted(map(str, table[["doc_id", "source", "size", "source_size", "target", "copies", "taken"]].astype(object).where(table.notna(), None).values.tolist())) == sorted(str([None if x is None else x for x in w]) for w in want)
    assert (table["taken"] <= 3 * table["size"]).all() and abs(table.groupby("source", dropna=False)["target"].first().sum() - table["size"].sum()) < 1e-6
    assert mixing.mix_table(empty).count() == 0
    full = mixing.mix_documents(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert full == {r.doc_id: r.copies for r in table.itertuples() if r.copies}


def test_mixing_weights(spark):
    rows = [(i, words(random.Random(i), 50), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000 + i, words(random.Random(i), 50), "en", "t", 1) for i in range(2000)], DOCS)
    slim, cuts, n = mixing.mix(docs, weights=(1, 9), weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    out = mixing._copies(slim, cuts, n, 3, 11).groupBy("source", (F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    got = {(r.source, r.odd): r.n for r in out}
    assert 2 < got["s", 0] / got["s", 1] < 4.5


# 9


def test_language_id(spark):
    out = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    gold = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == gold[r.doc_id] for r in held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_id_edges(spark, docs, empty):
    odd = spark.createDataFrame([(100, "123 !! 45"), (101, "𝔘𝔫𝔦 ß" * 3), (102, "x" * 30_000)], "doc_id long, text string")
    every = docs.drop("n_chars").unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("z"))
    got = {r.doc_id: r for r in langid.identify(every).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} >= {0, 1, 2, 100} and got[100].score == 0
    assert got[102].lang_pred in ("en", "de", "xx")
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert set(r.doc_id for r in langid.keep_identified(every.drop("score")).collect()) == {d for d, r in got.items() if r.lang_pred != "und"}


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "abc", "c", "bc", "▁a"]
    prob = np.random.default_rng(1).random((8, 2)) / 8
    prob[7] = 0

    def brute(w, lang):
        if not w:
            return 1.0
        total = 0.0
        for n in range(1, len(w) + 1):
            p = prob[pieces.index(w[:n]), lang] if w[:n] in pieces else langid.UNKNOWN if n == 1 else 0.0
            total += p * brute(w[n:], lang) if p else 0.0
        return total

    look = langid.Pieces(pieces)
    for w in ("▁abcabc", "▁zab", "▁" + "abc" * 5):
        got = langid.forward(look, prob, langid.codes([w]))[0]
        assert np.allclose(got, [np.log(brute(w, 0)), np.log(brute(w, 1))])


# 10


def test_simhash(spark, docs, empty, rows):
    every = docs.withColumn("fp", F.lit(1)).withColumn("rep", F.lit(2))
    got = {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(every).collect()}
    assert got == simhash.brute_force(pairs(rows))
    assert got[0] == got[1] == ("0" * 16, 0)
    assert simhash.near_duplicates(empty).count() == 0
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


def test_shingle_hash_is_the_contract():
    assert simhash.shingles("A b\tC d", 3) == [b"a b c", b"b c d"] and simhash.shingles("ÀB", 3) == ["Àb".encode()]
    h = xxhash.xxh64_intdigest("àb c".encode(), 42)
    assert simhash.fingerprint("àb C") == h


def test_vantage_point_trees_find_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 12)
    monkeypatch.setattr(simhash, "PAIRS", 200)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << i) for i in range(64)}
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(sorted(fps))]
    edges = simhash.links(spark.createDataFrame(rows, "rep long, fp long").repartition(3))
    found = {r.node: r.component for r in components.components(edges).collect()}
    group = {i: i for i, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in rows:
        for j, b in rows[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((top(i), top(j)))
                group[y] = x
    assert {i: found.get(i, i) for i in group} == {i: top(i) for i in group}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (200, 250)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 140)} == {100} and {got[x] for x in (200, 250, 300)} == {200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_components_in_few_jobs_or_in_rounds(spark, monkeypatch, one_task):
    """Ids as strings, loops, repeats and nulls; what one task can hold takes a few jobs, not some per round."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    monkeypatch.setattr(components, "AT_ONCE", 40)
    chain = [(f"é{i:03}", f"é{i + 1:03}") for i in range(200)]
    other = [("b", "a"), ("a", "b"), ("c", "b"), ("z", "z"), (None, "a"), ("c", None), ("y", "x")]
    group = f"components-{one_task}"
    spark.sparkContext.setJobGroup(group, group)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain + other, "u string, v string").repartition(5)).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {f"é{i:03}": "é000" for i in range(201)} | dict.fromkeys("abc", "a") | dict.fromkeys("xy", "x")
    if one_task:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 10



# queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = c.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, DATA)
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def near_kept(docs):
    """What the near-dedup stage keeps: least ids of SimHash groups over five words, then of groups at a similarity of 0.8."""
    near = simhash.brute_force(docs, 5)
    docs = [(d, t) for d, t in docs if near[d][1] == d]
    alike = jaccard.brute_force(docs)
    return [(d, t) for d, t in docs if alike[d] == d]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    check_shards(out, len(out))
    c = duckdb.connect()
    docs = c.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    items = c.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    docs = near_kept([(d, t) for d, t in docs if t and any(ch.isalpha() for ch in t)])
    dirty = {w[0] for w in decontaminate.brute_force(docs, items) if w[5]}
    docs = {d: t for d, t in docs if d not in dirty}
    c.execute(f"CREATE TABLE left_over AS SELECT * FROM '{DATA}/documents.parquet' WHERE doc_id IN ({','.join(map(str, docs))})")
    copies = dict(c.sql(mixing.MIX_SQL.replace("{docs}", "left_over") + "SELECT doc_id, copies FROM m WHERE copies > 0").fetchall())
    assert collections.Counter(r.doc_id for r in out) == copies
    assert all(r.text == docs[r.doc_id] for r in out)
    assert hashlib.sha256(b"").hexdigest()  # digests of empty lists are those of the empty string


def test_pipeline_on_odd_tables(spark, docs, rows, empty, tmp_path):
    """Nulls, empties, repeated rows, columns that clash with every stage's own, and tables without rows or labels."""
    import corpus_pipeline

    odd = docs.drop("n_chars").unionByName(docs.drop("n_chars").where("doc_id % 7 = 0"))
    odd = odd.unionByName(spark.createDataFrame([(None, "a text without an id", "en", "a"), (None, None, None, None)], "doc_id long, text string, lang string, source string"))
    for c in ("score", "Score2", "lang_pred", "fp", "Tag", "component_id", "key", "row", "copies", "size", "tie", "item_id", "doc"):
        odd = odd.withColumn(c, F.lit("orig"))
    items = spark.createDataFrame([(1, rows[30][1])], "item_id long, text string")
    for name, table in (("odd", odd), ("unlabelled", odd.withColumn("lang", F.lit(None).cast("string"))), ("none", odd.where("false"))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == [*odd.columns, "shard", "slot"]
        got = out.collect()
        check_shards(got, len(got))
        assert all(getattr(r, c) == "orig" for r in got for c in odd.columns[4:])
        left = {r.doc_id for r in got}
        if name == "none":
            assert not got
            continue
        lettered = [(d, t) for d, t in pairs(rows) if t and any(ch.isalpha() for ch in t)]
        clean = dict(near_kept(lettered))
        dirty = {w[0] for w in decontaminate.brute_force(list(clean.items()), [(1, rows[30][1])]) if w[5]}
        assert left - {None} <= set(clean) - dirty and None in left  # mixing may leave some of these out
        stage = spark.read.parquet(f"{folder}/documents.parquet")
        for _, f in corpus_pipeline.STAGES[:3]:
            stage = common.written(f(spark, stage, folder))
        kept = [r.doc_id for r in stage.collect()]
        assert sorted(d for d in kept if d is not None) == sorted(set(clean) - dirty)


def test_language_stage_keeps_clashing_columns(spark, docs):
    odd = docs.withColumn("score", F.lit("orig")).withColumn("lang_pred", F.lit("orig")).withColumn("Score2", F.lit(1))
    assert {(r.score, r.lang_pred) for r in langid.keep_identified(odd).collect()} == {("orig", "orig")}
    upper = docs.withColumn("Score", F.lit("orig"))
    assert {r.Score for r in langid.keep_identified(upper).collect()} == {"orig"}
    assert langid.predict(upper, langid.learn(docs, F.lit(True))).columns[-2:] == ["lang_pred", "score"]
    assert quality.score(upper, quality.Model([("a b c", 1), ("d e f", 0)])).columns == [*docs.columns, "score"]


def test_long_words_are_fitted_and_scored():
    """A script without spaces: one run of hundreds of letters per text, longer than any product of doubles can hold."""
    rng = random.Random(3)
    texts = [("aa", "".join(rng.choice("abc") for _ in range(700))) for _ in range(6)] + [("zz", "".join(rng.choice("xyz") for _ in range(500))) for _ in range(6)]
    model = langid.Model(["▁", "a", "b", "c", "x", "y", "z", "ab", "xy"], texts)
    names, scores = langid.Scorer(model).predict(["".join(rng.choice("abc") for _ in range(2000)), "xyzzy", None])
    assert names == ["aa", "zz", "und"] and all(np.isfinite(scores)) and scores[2] == 0


def test_expected_counts_sum_over_segmentations():
    """Forward and backward sums against all segmentations of a word, one by one."""
    pieces = ["a", "ab", "b", "abc", "c", "bc", "▁a", "▁"]
    prob = np.append(np.random.default_rng(2).random(8) / 8, 0)

    def every(w):
        return [[p, *r] for n in range(1, len(w) + 1) if (p := w[:n]) in pieces for r in every(w[n:])] if w else [[]]

    look = langid.Pieces(pieces)
    words_ = ["▁abcab", "▁cab", "▁b"]
    got = langid.expected_counts(look, prob, langid.codes(words_), np.array([1.0, 2.0, 3.0]))
    want = np.zeros(9)
    for w, k in zip(words_, (1, 2, 3), strict=True):
        cuts = every(w)
        weight = np.array([np.prod([prob[pieces.index(p)] for p in c]) for c in cuts])
        for c, x in zip(cuts, weight / weight.sum(), strict=True):
            for p in c:
                want[pieces.index(p)] += k * x
    assert np.allclose(got, want, atol=1e-4)


def test_copies_of_a_table_are_dealt_like_chance(spark):
    """Of a table with three copies of each row, triples are in one shard one time in 64; one row repeated is no hot task."""
    one = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shuffle_into_shards(one.union(one).union(one), 8)
    together = out.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n = 1").count()
    assert 30 < together < 100
    hot = sharding.shuffle_into_shards(spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text")), 8)
    check_shards(hot.collect(), 20_000)


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BYTES_PER_BLOCK", 1000)
    rows = [(i, "x" * 2000) for i in range(400)]
    check_shards(sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), 400)


def test_folders(spark):
    """Tables that cut lineage lie in the application's own folder, and go when they are forgotten."""
    import os

    t = common.written(spark.range(3))
    path = t._written.removeprefix("file:")
    assert os.path.isdir(path) and spark.sparkContext.applicationId in path
    common.forget(t)
    assert not os.path.exists(path)
