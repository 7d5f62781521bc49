"""The ten operators on small inputs: brute force, round trips, and the cases that each must bear."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import components, ctw, html_text, jaccard, langid, line_dedup, mixing, packing, shingles, token_files, topk, vamana
from lattica.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import duck, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def docs(spark, *texts, **more):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOCS)


# ---------------------------------------------------------------- contracts against DuckDB


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    d = "/root/testdata/sf0.001"
    assert rows(QUERIES[name](spark, d).toPandas()) == rows(duck(ORACLE_SQL[name], d))


# ---------------------------------------------------------------- line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(a, b, edits):
    """Whether the edit distance is at most edits; letter counts alone rule most pairs out."""
    x, y = collections.Counter(a), collections.Counter(b)
    return abs(len(a) - len(b)) <= edits and sum((x - y).values()) <= edits and sum((y - x).values()) <= edits and edit_distance(a, b) <= edits


def lines_by_hand(texts, edits, least):
    seen, out = [], []
    for t in texts:
        kept = []
        for line in t.split("\n"):
            if not line.strip():
                kept.append(line)
            elif line not in seen:
                if not (len(line) >= least and any(len(s) >= least and within(s, line, edits) for s in seen)):
                    kept.append(line)
                seen.append(line)
        out.append("\n".join(kept))
    return out


def test_line_dedup_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 14))) for _ in range(25)]

    def edited(x):
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
        return "".join(x)

    texts = ["\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["", "a\n\na", base[0]]
    got = line_dedup.dedup_lines(docs(spark, *texts).select("doc_id", "text"), 2, 6).toPandas().sort_values("doc_id")
    assert got["line_text"].tolist() == lines_by_hand(texts, 2, 6)


def test_near_lines_of_large_groups(spark, monkeypatch):
    """Families of lines that share most of their text: near ones, and ones with a word changed."""
    monkeypatch.setattr(line_dedup, "GROUP", 3)
    rng = random.Random(5)
    lines = []
    for _ in range(3):
        base = "".join(rng.choice("abcdefgh tu") for _ in range(48)).strip().ljust(40, "z")
        for _ in range(25):
            at = rng.randrange(0, 36)
            lines.append(base[:at] + (rng.choice("xyz") if rng.random() < 0.5 else "".join(rng.choice("qrstuv") for _ in range(5))) + base[at + rng.choice((1, 2)) :])
    lines += [f"page number {n:06d} of the long catalogue" for n in rng.sample(range(10**6), 30)]
    rng.shuffle(lines)
    d = docs(spark, *("\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)))
    got = {r["doc_id"]: r["line_text"] for r in line_dedup.dedup_lines(d).collect()}
    seen, want = [], {}
    for i in range(0, len(lines), 7):
        kept = []
        for x in lines[i : i + 7]:
            if x not in seen:
                if not any(within(x, y, 2) for y in seen):
                    kept.append(x)
                seen.append(x)
        want[i // 7] = "\n".join(kept)
    assert got == want


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_of_one_family(spark, monkeypatch, edits):
    """Lines made from one by a few edits anywhere, also at their ends and side by side: some near the earliest, most not."""
    monkeypatch.setattr(line_dedup, "GROUP", 2)
    rng = random.Random(edits)
    base = "".join(rng.choice("abcé ") for _ in range(30))

    def edited(x):
        x = list(x)
        for i in rng.sample(range(len(x)), rng.randint(1, 2 * edits)):
            x[i] = rng.choice(["", "a", "bz", "q"])
        return "".join(x)

    lines = list(dict.fromkeys(edited(base) for _ in range(70)))
    got = line_dedup.dedup_lines(docs(spark, *lines).select("doc_id", "text"), edits, 12).toPandas().sort_values("doc_id")
    assert got["line_text"].tolist() == lines_by_hand(lines, edits, 12)


def test_pairs_of_one_family_are_few(spark, monkeypatch):
    """Lines with one word of their own somewhere, hardly one near another: few of the 79,800 pairs are compared."""
    monkeypatch.setattr(line_dedup, "GROUP", 8)
    rng, made, compared = random.Random(8), [], line_dedup._compared
    word = lambda n: "".join(rng.choice("etaoinshr") for _ in range(n))
    words = [word(4) for _ in range(60)]
    lines = [" ".join([*words[:at], word(6), *words[at + 1 :]]) for at in (rng.randrange(60) for _ in range(400))]

    def counted(pairs, *more):
        made.append(pairs.count())
        return compared(pairs, *more)

    monkeypatch.setattr(line_dedup, "_compared", counted)
    got = line_dedup.dedup_lines(docs(spark, *lines).select("doc_id", "text")).toPandas()
    assert got["n_near"].sum() == sum(any(within(x, y, 2) for y in lines[:i]) for i, x in enumerate(lines))
    assert sum(made) < 10 * len(lines)


def test_line_dedup_edges(spark):
    d = spark.createDataFrame([(None, "only here\nshared line", 1, "m"), (1, None, 2, "m"), (2, "shared line", 3, "m"), (2, "shared line", 3, "m"), (2, "other text", 4, "m"), (3, "x" * 200_000, 5, "m")], "doc_id long, text string, flags int, mark_ string")
    got = line_dedup.dedup_lines(d).toPandas()
    by = got.groupby(got["doc_id"].fillna(-1))["line_text"].apply(list).to_dict()
    assert by[-1] == ["only here"] and by[1] == [None] and sorted(by[2]) == ["other text", "shared line", "shared line"] and len(by[3][0]) == 200_000
    assert set(d.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=9), st.text("abc", max_size=9)), min_size=1, max_size=30))
def test_banded_distance(spark, pairs):
    d = spark.createDataFrame(pairs, "a string, b string")
    for r in d.select("a", "b", line_dedup.within_edits(line_dedup.chars(F.col("a")), line_dedup.chars(F.col("b")), 2).alias("w"), line_dedup.within_edits(*map(line_dedup.chars, line_dedup.trimmed(F.col("a"), F.col("b"))), 1).alias("w1")).collect():
        assert r["w"] == (edit_distance(r["a"], r["b"]) <= 2) and r["w1"] == (edit_distance(r["a"], r["b"]) <= 1)


# ---------------------------------------------------------------- HTML


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One  two<br>three<p>Fo&uuml;r &lt;x&gt;</p><aside>Side</aside><ul><li>item</ul><form>f<input></form><section id="comments"><p>me too</p></section></article>
    <div id=cookie-notice>Accept</div><footer>&copy; x</footer><script>var a="</p>";</script></body></html>"""
    assert html_text.extract(page) == "Head & line\nOne two three\nFoür <x>\nitem"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html><body></body></html>") == ""
    plain = "<body><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div><p>" + "long text " * 40 + "</p><p>short</p></div><div><a href=4>more links</a></div></body>"
    assert html_text.extract(plain) == ("long text " * 40).strip() + "\nshort"
    assert html_text.extract("just text") == "just text"
    assert html_text.extract("<p>open <b>tags &am") == "open tags &am"


def test_html_regions_are_chosen_on_every_page():
    long, tags = "long text " * 40, "<div><i>a</i> <i>b</i> <i>c</i></div>" * 8
    assert html_text.extract(f"<body><article><p>Teaser</p></article><div><p>{long}</p><p>{long}</p></div></body>").count("long text") == 80
    got = html_text.extract(f"<body><article><p>{long}</p><p>short</p>{tags}<p>{long}</p></article></body>").split("\n")
    assert got == [long.strip(), "short", long.strip()]
    assert html_text.extract(f"<body><p>{long}</p>" + "<p>Yes.</p>" * 9 + f"<p>{long}</p></body>").count("Yes.") == 9


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a long first paragraph</p><![foo[bar]]><p>and a long second one</p>", "a long first paragraph\nand a long second one"),
        ("<!DOCTYPE html [<!ENTITY x 'y'>]><p>hello world this is text</p>", "hello world this is text"),
        ("<![CDATA[ a > b ]]><p>hello world this is text</p>", "hello world this is text"),
        ("<article><p class='related-work'>earlier work is long and good</p><p id='skip'>the next part is too</p></article>", "earlier work is long and good\nthe next part is too"),
        ("<![ x", None),
        ("<b>" * 20000 + "<p>deep down is some text</p>", "deep down is some text"),
    ],
)
def test_html_that_is_malformed(html, text):
    got = html_text.extract(html)
    assert text is None or got == text


def test_html_rows(spark):
    p = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>é</p>")], "page_id long, url string, html string")
    got = html_text.extract_pages(p).collect()
    assert sorted((r["text"], r["n_chars"]) for r in got) == [("", 0), ("", 0), ("é", 1)]


# ---------------------------------------------------------------- mixing


def test_water_fill(spark):
    n = spark.createDataFrame([("p", "a", 10, 1, 100), ("p", "b", 1000, 1, 100), ("p", "c", 1000, 2, 100), ("p", "z", 50, 0, 100), ("q", "a", 5, 1, 100)], "parent string, name string, cap long, w long, parent_budget long")
    got = {(r["parent"], r["name"]): r["budget"] for r in mixing.water_fill(n, ["parent"], "name").collect()}
    assert got == {("p", "a"): 10, ("p", "b"): 30, ("p", "c"): 60, ("q", "a"): 5}


def test_mixing_edges(spark):
    d = spark.createDataFrame([(1, "a" * 400, "en", "src1", "x"), (1, "a" * 400, "en", "src1", "x"), (None, "b" * 100, None, None, "x"), (3, None, "de", "", "x"), (4, "", "de", "src2", "x"), (5, "c" * 40, "fr", "zz", "x")], "doc_id long, text string, lang string, source string, domain string")
    m = mixing.mixed(d, budget_percent=100, max_epochs=1)
    assert m.filter("doc_id = 1").count() == 2 and set(d.columns) <= set(m.columns)
    assert m.agg(F.sum(F.col("mix_tokens") * F.col("mix_copies"))).first()[0] <= 235
    assert mixing.mixed(d.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows_ = [("d0", "en", "s0", 10), ("d0", "en", "s1", 1000), ("d1", "en", "s2", 1000)]
    leaves = spark.createDataFrame([(*r, 1, 1, 1) for r in rows_], "domain string, language string, source string, n long, w_domain long, w_language long, w_source long")
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, 50, 1).collect()}
    assert got == {"s0": 10, "s1": 492, "s2": 502}


# ---------------------------------------------------------------- language ID


def test_language_id_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, model = langid.document_model(spark, d.filter("doc_id % 2 = 0"))
    t = d.filter("doc_id % 2 = 1").withColumn("real", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    got = langid.identify_documents(t, languages, model).toPandas()
    assert (got["language"] == got["real"]).mean() > 0.97 and got["accepted"].mean() > 0.97 and len(got) == t.count()


def test_language_id_edges(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    languages, model = langid.document_model(spark, d)
    odd = spark.createDataFrame([(None, None, None, None, "c"), (1, "", "en", "s", "c"), (1, "  \n", "xx", "s", "c"), (2, "the and of that with " * 5000, "fr", None, "c"), (3, "x", None, "s", "c")], "doc_id long, text string, lang string, source string, host string")
    got = langid.identify_documents(odd, languages, model).toPandas()
    assert len(got) == 5 and got[got["text"].fillna("").str.strip() == ""]["language"].isna().all() and got[got["doc_id"] == 2]["text_language"].tolist() == ["en"]
    assert langid.identify_documents(odd.limit(0), languages, model).count() == 0
    assert langid.identify_documents(odd, *langid.fit(d.limit(0).select("doc_id", "text", F.col("lang").alias("language")))).filter("accepted").count() == 0
    p = spark.createDataFrame([(1, "https://www.a.example.org/fr/1", "<html lang='fr'><p>que les des une est dans pour</p></html>"), (None, None, None), (2, "nonsense", "<p></p>")], "page_id long, url string, html string")
    assert langid.identify_pages(p, languages, model).count() == 3


def test_language_id_knows_every_labelled_language(spark):
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}q" for x in "bdfhjlnprt")
    d = spark.createDataFrame([(3 * i + j, own(i), f"l{i:02}", "s", 9) for i in range(70) for j in range(3 if i < 66 else 2)], DOCS)
    languages, model = langid.document_model(spark, d)
    assert languages == [f"l{i:02}" for i in range(70)]
    got = langid.identify_documents(d, languages, model).collect()
    assert all(r["language"] == r["lang"] for r in got)


def test_declared_language_after_a_long_beginning(spark):
    d = spark.createDataFrame([(i, " ".join(f"{x}{y}" for x in "abcdef" for y in "bcdfg"), lang, "s", 9) for i, lang in enumerate(["aa", "bb"] * 3)], DOCS)
    page = lambda lang, before: f"{before}<html lang='{lang}'><p>ab ac ad af ag bb bc bd bf bg</p></html>"
    p = spark.createDataFrame([(2 * i + j, "u", page(lang, before)) for i, lang in enumerate(["aa", "bb"]) for j, before in enumerate(["<!--x-->", "<!--" + "licence " * 900 + "-->"])], "page_id long, url string, html string")
    got = {r["page_id"]: r["probability"] for r in langid.identify_pages(p, *langid.document_model(spark, d)).collect()}
    assert got[0] == got[1] and got[2] == got[3]


# ---------------------------------------------------------------- top-k and nearest neighbours


def vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[n // 2 :: 7] = v[1]  # a very common vector
    return spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), v


def test_exact_top_k_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 40)
    monkeypatch.setattr(topk, "TILE_QUERIES", 4)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    d, v = vectors(spark)
    e = d.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = topk.exact_top_k(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, 5).toPandas()
    z = np.floor(64 * v).astype(int)
    for q, g in got.groupby("query_id"):
        want = sorted((-int(z[q] @ z[i]), i) for i in range(len(z)) if i != q)[:5]
        assert [(-s, i) for s, i in zip(g.sort_values("rank")["score"], g.sort_values("rank")["vec_id"], strict=True)] == want


def test_vectors_that_take_no_part(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(r[0] for r in d.filter(topk.usable(F.col("embedding"))).select("vec_id").collect()) == [0, 1, 2, 100]
    assert sorted(r[0] for r in d.filter(topk.usable(F.col("embedding"), nonzero=True)).select("vec_id").collect()) == [0, 1, 2]
    e = d.filter(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = topk.exact_top_k(e.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"), e, 20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 64 * 192 + 128 * 256), (100, 0)]
    assert topk.exact_top_k(e.limit(0).withColumnRenamed("vec_id", "query_id"), e).count() == 0


def test_graph_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vamana, "SHARD_NODES", 100)
    d, v = vectors(spark, 400)
    e = d.select("vec_id", F.col("embedding").alias("v"))
    got = vamana.nearest(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), vamana.build_index(e, 10), 10).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        want = sorted((-float((v[q] * v[i]).sum()), i) for i in range(len(v)) if i != q)[:10]
        g = g.sort_values("rank")
        hits += len({i for _, i in want} & set(g["vec_id"]))
        assert np.allclose(g["score"], [(v[q] * v[i]).sum() for i in g["vec_id"]]) and sorted(zip(-g["score"], g["vec_id"], strict=True)) == list(zip(-g["score"], g["vec_id"], strict=True))
    assert hits >= 0.95 * 10 * got["query_id"].nunique()
    assert vamana.build_index(e.limit(0)).count() == 0


def test_repeated_vectors(spark):
    rows_ = [(1, [1.0, 0.0])] * 30 + [(2, [1.0, 0.0]), (3, [0.5, 0.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0])]
    e = spark.createDataFrame(rows_, "vec_id long, v array<double>")
    q = e.filter("vec_id = 20").withColumnRenamed("vec_id", "query_id")
    got = vamana.nearest(q, vamana.build_index(e, 3), 3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 3)]
    ids = np.array([1, 2, 7, 7, 7, 9])
    assert [x.tolist() for x in topk.top_lists(np.array([[1, 2, 9, 9, 9, 3]]), ids, np.array([7]), 2)] == [[5, 1]]


# ---------------------------------------------------------------- scoring


def test_ctw_against_direct_mixture():
    rng = random.Random(1)
    train = ["".join(rng.choice("ab c") for _ in range(60)).encode() for _ in range(6)]
    held, depth = [b"abcab", b"", b"zq"], 2
    g, _ = ctw.grams_of(train, depth)
    h, starts = ctw.grams_of(held, depth)
    keys = np.unique(np.concatenate((g, h)))
    n = np.zeros(len(keys))
    np.add.at(n, np.searchsorted(keys, g), 1)
    levels, at = ctw.tree_up(keys, n, depth, 0)
    levels[-1].down(None)
    bits = ctw.code_lengths(keys, levels, at)
    assert len(h) == sum(len(x) + 1 for x in held)

    counts = collections.Counter()
    for t in train:
        s = b"\xff\xff" + t + b"\xff"
        for i in range(2, len(s)):
            for d, k in itertools.product(range(3), range(8)):
                counts[(s[i - d : i], 1 << k | s[i] >> (8 - k), s[i] >> (7 - k) & 1)] += 1

    def kt(c, node):
        a, b = counts[(c, node, 0)], counts[(c, node, 1)]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    contexts = {c for c, _, _ in counts if len(c) == 2}

    def weighted(c, node):
        if len(c) == depth:
            return kt(c, node)
        kids = {x[1 - len(c) :] if len(c) == 1 else x[1:] for x in contexts if x.endswith(c)} if len(c) < 2 else set()
        kids = {x[-len(c) - 1 :] for x in contexts if x.endswith(c)}
        return np.logaddexp(math.log(0.5) + kt(c, node), math.log(0.5) + sum(weighted(k, node) for k in kids))

    def p_one(c, node, d):
        s = c[len(c) - d :] if d else b""
        a, b = counts[(s, node, 0)], counts[(s, node, 1)]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        w = math.exp(math.log(0.5) + kt(s, node) - weighted(s, node))
        return w * p + (1 - w) * p_one(c, node, d + 1)

    s, want = b"\xff\xffabcab\xff", 0.0
    for i in range(2, len(s)):
        for k in range(8):
            p = p_one(s[i - 2 : i], 1 << k | s[i] >> (8 - k), 0)
            want -= math.log2(p if s[i] >> (7 - k) & 1 else 1 - p)
    got = bits[np.searchsorted(keys, h[: starts[1]])].sum()
    assert abs(got - want) < 1e-6


def test_ctw_probabilities_sum_to_one():
    g, _ = ctw.grams_of([b"hello hello", b"help"], 3)
    n = collections.Counter(g.tolist())
    context = int(g[3]) >> 8 << 8
    keys = np.unique(np.concatenate((g, context + np.arange(256, dtype=np.uint64))))
    levels, at = ctw.tree_up(keys, np.array([n[k] for k in keys.tolist()], float), 3, 0)
    levels[-1].down(None)
    bits = ctw.code_lengths(keys, levels, at)
    assert abs((2.0 ** -bits[keys >> np.uint64(8) << np.uint64(8) == context]).sum() - 1) < 1e-9


def test_scores_base_and_edges(spark):
    texts = ["the cat the", None, "", "the dog", "THE\tcat"] * 4
    d = spark.createDataFrame([(i if i != 3 else None, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = ctw.score_texts(d).toPandas()
    tokens = [([*(t or "").lower().split(), "\n"], i != 3 and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in enumerate(texts)]
    c = collections.Counter(w for ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 9) for ws, _ in tokens)
    assert sorted(got["base_score"].round(9)) == want and set(got["train_tokens"]) == {n} and got["held_out"].sum() == sum(h for _, h in tokens)
    assert ctw.score_texts(d.limit(0)).count() == 0 and (got["score"] < 0).all()


# ---------------------------------------------------------------- token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=20))
def test_token_file_round_trip(ids):
    flat = np.array([x for d in ids for x in d], "<u4")
    f = token_files.TokenFile(token_files.pack(flat, [None, *range(1, len(ids))][: len(ids)], np.cumsum([len(x) for x in ids])))
    assert f.ids().tolist() == flat.tolist() and [f.id_at(i) for i in range(len(flat))] == flat.tolist()
    assert f.doc_ids == [None, *range(1, len(ids))][: len(ids)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_pieces_encode_as_the_library_does(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = text.encode("utf-8", "ignore").decode()
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert np.frombuffer(token_files.encoder(path).encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files_rows(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["<|endoftext|> it's  two\n\n spaces", None, "", "Ünï ćödé — 数字 12³"] * 5
    d = spark.createDataFrame([(i, x, 9) for i, x in enumerate(texts)][::-1] + [(7, "again", 9), (None, "first", 9)], "doc_id long, text string, start int")
    got = token_files.read_token_files(token_files.write_token_files(d, path)).toPandas().sort_values("start")
    order = sorted(d.toPandas().itertuples(), key=lambda r: (r.doc_id == r.doc_id, r.doc_id if r.doc_id == r.doc_id else 0, r.text is not None, r.text or ""))
    ids = [np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in order]
    assert got["n_tokens"].tolist() == [len(x) for x in ids] and got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for x in ids] and got["start"].tolist() == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert token_files.read_token_files(token_files.write_token_files(d.limit(0), path)).count() == 0


def test_token_files_query_encodes_as_the_tokenizer_does_as_loaded(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a b <|endoftext|> c", "<|endoftext|><|endoftext|>x  <|endoftext|>", "plain  text", None, "<|endoftext|"]
    docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]
    got = QUERIES["op7_token_files"](spark, str(tmp_path)).toPandas().sort_values("doc_id")
    assert got["n_tokens"].tolist() == [len(x) for x in ids] and got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for x in ids]


# ---------------------------------------------------------------- Jaccard


def components_by_hand(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("cluster", [4096, 3])
def test_jaccard_brute_force(spark, monkeypatch, cluster):
    monkeypatch.setattr(jaccard, "CLUSTER", cluster)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        for _ in range(14):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append(" ".join(x))
    texts += [None, "", " \t", "One two", "one\ttwo ", "a b c d e", "A B C D E"]
    got = jaccard.jaccard_components(docs(spark, *texts)).toPandas().sort_values("doc_id")
    assert list(got.itertuples(index=False, name=None)) == components_by_hand(texts)


def test_jaccard_edges(spark):
    d = spark.createDataFrame([(5, "a b c d e f", 1), (5, "a b c d e f", 1), (5, "q r s t u v", 1), (None, "a b c d e f", 1), (9, "word " * 60_000, 1), (8, "word " * 50_000, 1)], "doc_id long, text string, cid int")
    got = sorted(jaccard.jaccard_components(d).toPandas().fillna(-1).itertuples(index=False, name=None))
    assert got == sorted([(5.0, 2, 5), (5.0, 2, 5), (5.0, 2, 5), (-1.0, 2, 5), (9.0, 1, 8), (8.0, 1, 8)])
    assert jaccard.jaccard_components(d.limit(0)).count() == 0
    assert jaccard.jaccard_components(docs(spark, None, "")).count() == 2


def test_connected_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components.connected_components(links.limit(0)).count() == 0


def test_shingles_of_many_texts_as_of_each():
    texts = [b"a b c d e f g", b"", b"x", b" A  b\tc d E f\n", b"one two three four five"]
    for t, s in zip(texts, shingles.shingle_sets(texts), strict=True):
        assert s.tolist() == shingles.shingle_sets([t])[0].tolist()
    assert [len(s) for s in shingles.shingle_sets(texts)] == [3, 0, 1, 2, 1]


# ---------------------------------------------------------------- packing


def best_fit_by_hand(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= size and sum(x[1] == source for x in b) < per_source and (cluster < 0 or all(x[2] != cluster for x in b))]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        bins[i].append((size, source, cluster))
        out.append(i)
    return out, bins


def test_best_fit_passes_over_closed_bins():
    """Many items of one source, or of one cluster, are packed without looking at every bin."""
    import time

    for items in ([(100, 0, -1)] * 16384, [(100, i, 0) for i in range(16384)]):
        began = time.time()
        bins = packing.best_fit(items, 4096, 2)
        assert max(collections.Counter(bins).values()) <= 2 and time.time() - began < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(-1, 4)), max_size=40), st.integers(1, 3))
def test_best_fit_is_tightest(items, per_source):
    got = packing.best_fit(items, 20, per_source)
    left, held = {}, {}
    for (size, source, cluster), b in zip(items, got, strict=True):
        fits = {r for i, r in left.items() if r >= size and sum(x[0] == source for x in held[i]) < per_source and (cluster < 0 or all(x[1] != cluster for x in held[i]))}
        assert (left.get(b) == min(fits)) if fits else b not in left
        left[b] = left.get(b, 20) - size
        held.setdefault(b, []).append((source, cluster))


def test_packing_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 7)
    texts = ["x" * n for n in (40, 400, 401, 0, 1234, 7, 7, 7, 399)] + [None]
    d = docs(spark, *texts).unionByName(docs(spark, "dup " * 10)).unionByName(docs(spark, "dup " * 10))
    got = packing.pack_best_fit(d, capacity=100, per_source=2).toPandas()
    size = {i: -(-len(t or "") // 4) for i, t in enumerate(texts)}
    assert got[got["doc_id"] > 0].groupby("doc_id")["n_tokens"].sum().to_dict() == {k: v for k, v in size.items() if k}
    assert (got.groupby("bin_id")["n_tokens"].sum() <= 100).all() and (got.groupby("bin_id").size() <= 2).all() and not got.duplicated(["bin_id", "slot"]).any()
    same = got[got["n_tokens"] == 2]  # three equal texts
    assert same["bin_id"].nunique() == 3
    assert packing.pack_best_fit(d.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, d).cache()
        assert now.columns == columns and 0 < now.count() <= 2 * before.count(), name
        if name == "line dedup":
            want = lines_by_hand(before.orderBy("doc_id").toPandas()["text"].tolist()[:40], 2, 24)
            got = now.toPandas().set_index("doc_id")["text"].to_dict()
            ids = before.orderBy("doc_id").toPandas()["doc_id"].tolist()[:40]
            assert all(got.get(i, "") == w for i, w in zip(ids, want, strict=True) if w.strip())
        if name == "n-gram Jaccard join":
            kept = before.orderBy("doc_id").toPandas()
            groups = components_by_hand(kept["text"].tolist())
            assert sorted(now.toPandas()["doc_id"]) == [kept["doc_id"].iloc[i] for i, _, c in groups if i == c]
    out = corpus_pipeline.STAGES[-1][1](spark, now, d).toPandas()
    assert set(out["doc_id"]) == set(now.toPandas()["doc_id"]) and (out.groupby("bin_id")["n_tokens"].sum() <= 4096).all()
    assert isinstance(out, pd.DataFrame)


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(10)) for x in "abcde")
    texts = [(7, a), (7, b), (3, c), (8, c), (8, d), (8, d), (None, e), (None, e), (None, e.upper()), (1, None), (None, ""), (None, "")]
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS), "").collect()
    want = [(7, a), (7, b), (3, c), (8, d), (None, e), (1, None), (None, ""), (None, "")]
    assert sorted(str((r["doc_id"], r["text"] and r["text"].lower())) for r in got) == sorted(map(str, want))


def test_pipeline_bears_empty_tables_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    some = [(i, f"this is the text number {i} of a small corpus, and it has some words\nline {i} of it", "en", f"src{i % 3}", 70) for i in range(12)] + [(None, None, None, None, None), (1, "", "en", "s", 0)]
    full = spark.createDataFrame(some, DOCS).withColumns({c: F.lit("x") for c in ("flags", "mark", "d", "label", "cid", "language", "n_lines", "mix_copies")})
    for what, now in (("none", full.limit(0)), ("some", full)):
        columns, ids = now.columns, set()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, "")
            assert i == 4 or out.columns == columns, name
            out.write.parquet(str(tmp_path / f"{what}{i}"))
            now = spark.read.parquet(str(tmp_path / f"{what}{i}"))
            ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert ids == set() if what == "none" else ids
