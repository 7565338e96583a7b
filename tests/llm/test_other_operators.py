"""Vector searches, HTML extraction, components and the pipeline."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparkloom.llm import components, extraction, neighbours, topk
from sparkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def vectors(spark, n=3000, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, 16))
    x[n // 2 : n // 2 + n // 5] = x[0]  # one vector of a fifth of the rows
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0] * 15 + [None]), (None, [1.0] * 16), (n + 4, [1.0] * 3), (n + 5, [float("inf")] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), np.array([r[1] for r in rows[:n]])


def test_nearest_reaches_its_recall(spark):
    table, x = vectors(spark)
    found = neighbours.nearest(table, F.col("vec_id") % 100 == 0, settings=neighbours.Settings(sample=1000, leaf=30, chunk=200)).collect()
    hits = total = 0
    for q in range(0, 3000, 100):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert np.allclose([r["score"] for r in own], [d[r["vec_id"]] for r in own], rtol=1e-12, atol=0)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        hits, total = hits + len({r["vec_id"] for r in own} & set(best.tolist())), total + 10
    assert hits >= 0.9 * total
    assert {r["query_id"] for r in found} == set(range(0, 3000, 100))


def test_top_k_is_exact(spark):
    table, x = vectors(spark)
    found = topk.top_k(table, F.col("vec_id") % 50 == 0, settings=topk.Settings(shard=700, batch=16, block=32)).collect()
    t = np.floor(256 * x).astype(np.int64)
    zero = {3001: np.zeros(16, dtype=np.int64)}
    for q in range(0, 3000, 50):
        score = t @ t[q]
        order = [i for i in np.lexsort((np.arange(len(score)), -score)) if i != q][:5]
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["vec_id"], r["score"]) for r in own] == [(i, score[i]) for i in order]
    assert {r["query_id"] for r in found} == set(range(0, 3000, 50)) and zero


def test_top_k_prunes_only_what_cannot_count():
    rng = np.random.default_rng(1)
    x, s = rng.integers(-9, 9, (500, 4)), topk.Settings(block=8, step=1)
    q, ids, score = topk.search(x, np.arange(500), x[:20], np.arange(20), s)
    for i in range(20):
        full = x @ x[i]
        want = [k for k in np.lexsort((np.arange(500), -full)) if k != i][:5]
        assert ids[q == i].tolist() == want


@pytest.mark.parametrize("search", [neighbours.nearest, topk.top_k])
def test_searches_of_few_or_no_vectors(spark, search):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(none, F.col("vec_id") % 2 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 2)], "vec_id long, embedding array<float>, rank int")
    assert [tuple(r)[:3] for r in search(two, F.col("vec_id") % 2 == 0).collect()] == [(0, 1, 1)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><p>Site name and slogan of the site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site and you agree to all of them.</div>
<article><h1>A title &amp; more</h1><p>This is the first paragraph of the article, and it has the words that a text has.<p>Second&nbsp;one
 with <b>bold</b>, <a href=x>a link</a> and &lt;tags&gt;.<br>Still the second one.</p><div class="ad">Buy the thing now, it is the best of all.</div><p>Of.</p>
<form><p>Your mail</p><input></form><!-- <p>hidden</p> --><ul><li>A point</li><li>Another</li></ul></article>
<aside><p>Related things that are in the sidebar of the page.</p></aside><section id="comments"><p>I think that this is a great text, and I like it.</p></section><footer>&copy; all</footer></body></html>"""


def test_main_text():
    want = ["A title & more", "This is the first paragraph of the article, and it has the words that a text has.", "Second one with bold, a link and <tags>. Still the second one.", "Of.", "A point", "Another"]
    assert extraction.main_text(PAGE) == "\n\n".join(want)
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<nav>x</nav>") == ""


def test_ambiguous_blocks_take_their_neighbours_labels():
    long = "This is a long block of text that has the words which a text has, and it is here to be found by the rules of the pass. "
    page = f"<body><div>Short one</div><p>{long}</p><p>Near.</p><p>{long}</p><div>{'<a href=x>link of a menu</a> ' * 9}</div><div>Far end</div></body>"
    assert extraction.main_text(page).split("\n\n") == ["Short one", long.strip(), "Near.", long.strip()]


def test_broken_pages_end():
    for page in ("<", "<p", '<p title="x', "<!-- x", "<p>a<p>b</div></div>c", "<script>x", "<" * 5000, '<a b="' * 3000, "a" * 100_000):
        assert isinstance(extraction.main_text(page), str)


TEXT = "This is the text of the page, and it has the words that a text has in it."


@pytest.mark.parametrize("part,last", [("<div>", "</p>"), ("<b>", "</i>"), ("<a ", ""), ('<a x=">"', '"'), ("<textarea>", ""), ('<a "', ">"), ("<p", '"'), ("<aside>", "<article>"), ("<!--", "")])
def test_broken_pages_take_linear_time(part, last):
    import time

    began = time.process_time()
    times = 2_000_000 // (len(part) + len(last))
    extraction.main_text(part * times + last * times)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'class="overflow-hidden"', 'class="hidden-xs"', 'class="content-with-sidebar"', 'class="no-sidebar"', 'id="post-search-result"', 'data-x="hidden"'])
def test_wrappers_are_kept(attributes):
    assert extraction.main_text(f"<body><div {attributes}><p>{TEXT}</p></div></body>") == TEXT


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display: none"', 'class="x sidebar-left"', 'id="navBar"'])
def test_surroundings_go_unless_they_hold_an_article(attributes):
    page = f"<body><p>{TEXT}</p><div {attributes}><div><p>No, {TEXT}</p></div></div></body>"
    assert extraction.main_text(page) == TEXT
    assert extraction.main_text(f"<body><div {attributes}><div><article><p>{TEXT}</p></article></div></div></body>") == TEXT


def test_pages_without_stop_words_or_articles():
    finnish = "Metsien keskellä sijaitseva järvi jäätyy talvella kokonaan, jolloin kalastajat kulkevat jäätä pitkin saariin. " * 3
    assert extraction.main_text(f"<body><nav>Alku</nav><div>{finnish}</div></body>") == finnish.strip()
    assert extraction.main_text("<body><table><tr><td>Oak</td><td>12 m</td></tr></table><ul><li>Elm</li><li><a href=x>More trees</a></li></ul></body>") == "Oak\n\n12 m\n\nElm"


def test_teaser_articles_do_not_bound_the_page():
    page = f"<body><div><p>{TEXT}</p><p>{TEXT} {TEXT}</p></div><article><p>Read on about it.</p></article><article><a href=x>A card</a></article></body>"
    assert TEXT in extraction.main_text(page) and f"{TEXT} {TEXT}" in extraction.main_text(page)
    assert extraction.main_text(f"<body><p>{TEXT}</p><article><p>{TEXT} {TEXT}</p></article></body>") == f"{TEXT} {TEXT}"


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", None)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(extraction.main_text(PAGE))), (1, len(extraction.main_text(PAGE))), (2, 0)]


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    label = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = components.connected(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    got = {r["node"]: r["component"] for r in found}
    assert all(got[x] == y for x, y in label.items() if x in got) and all(label[x] == x for x in label if x not in got)
    assert len(found) == len(got)


def test_every_query_runs_over_a_whole_table(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op5_toxicity", "op4_license_scan"):
        assert QUERIES[name](spark, SF).count() == docs


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, SF)
        assert sorted(after.columns) == sorted(columns), name
        after = spark.createDataFrame(after.toPandas(), after.schema)
        assert 0 < after.count() <= docs.count()
        docs = after
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).cache()
    assert sorted(mixed.columns) == sorted(columns)
    packed = corpus_pipeline.pack(spark, mixed, SF)
    ends = packed.groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.max("piece").alias("m"))
    assert ends.filter("n <> m + 1").count() == 0 and ends.count() == mixed.count()


def test_near_copies_whatever_the_splits_of_a_scan(spark, tmp_path):
    """The number of cores changes between the scans: the same rows stay."""
    text = lambda k: " ".join(f"w{(k * 7 + i) % 997}" for i in range(40))
    rows = [(None if k % 3 else k, text(k // 4), "en", "s", 1) for k in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7).write.parquet(path)
    kept = []
    for before, after in (("1", "16"), ("16", "1")):
        spark.conf.set("spark.sql.files.minPartitionNum", before)
        found = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(path), SF)
        spark.conf.set("spark.sql.files.minPartitionNum", after)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", after)
        kept.append(sorted((r["text"], r["doc_id"] or -1) for r in found.collect()))
    for name in ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism"):
        spark.conf.unset(name)
    assert kept[0] == kept[1] and [t for t, _ in kept[0]] == sorted({r[1] for r in rows})


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS


def test_near_copies_leave_one_row_of_a_group(spark):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(3, base), (3, base), (None, f"{base} end"), (2, base), (None, "other words that stand alone in here"), (None, "other words that stand alone in here"), (9, "x y z"), (9, "a b c"), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id", "text").collect()
    want = [(2, base), (None, "other words that stand alone in here"), (9, "x y z"), (9, "a b c"), (5, None), (5, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_oracles_name_columns_of_their_queries(spark):
    con = duckdb.connect()
    for name in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(SF, name)}.parquet'")
    sql = __spark_entry__.oracle_sql()
    want = sorted(con.execute(sql["op3_exact_top_k"]).fetchall())
    got = QUERIES["op3_exact_top_k"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["social-science", "search-engines-explained", "promotion-of-health", "menu-recipes", "notice-of-decision"])
def test_names_of_subjects_are_no_surroundings(name):
    for own in (f'class="{name}"', f'id="{name}"', 'id="ad-hoc-analysis"'):
        assert extraction.main_text(f"<body><nav><a href=x>Home</a></nav><div {own}><p>{TEXT}</p></div></body>") == TEXT.strip()


@pytest.mark.parametrize("name", ["ad-slot", "sidebar", "sidebar-right", "site-footer", "main-nav", "cookie-notice", "ad", "ad-1", "adBanner", "related-posts", "social-share", "menu-item"])
def test_names_of_surroundings(name):
    body = f"<div><p>{TEXT} {TEXT}</p></div>"
    assert extraction.main_text(f'<body>{body}<div class="{name}"><p>{TEXT}</p></div></body>') == f"{TEXT} {TEXT}".strip()


def test_an_element_with_most_of_the_text_stays():
    assert extraction.main_text(f'<body><div>Home</div><div class="sidebar"><p>{TEXT}</p></div></body>').endswith(TEXT.strip())
    assert extraction.main_text(f'<body><article><p>Short one.</p></article><div class="sidebar"><p>{TEXT}</p></div></body>') == "Short one."
    assert TEXT not in extraction.main_text(f'<body><div>Home</div><div class="ad"><p>{TEXT}</p></div></body>')


@pytest.mark.parametrize("comments", [
    '<section id="comments"><article class="comment"><p>{}</p></article></section>', '<section class="comments-area"><article><p>{}</p></article></section>',
    '<article class="comment"><p>{}</p></article>', '<div class="respond"><p>{}</p></div>', '<ol class="comment-list"><li><article><p>{}</p></article></li></ol>'])
def test_comments_are_left_out(comments):
    said = comments.format(TEXT + " says a reader")
    for page in (f"<main><p>{TEXT}</p></main>{said}", f"<article><p>{TEXT}</p></article>{said}", f"<div><p>{TEXT}</p></div>{said}", f"<article><p>{TEXT}</p>{said}</article>"):
        assert extraction.main_text(f"<body>{page}</body>") == TEXT.strip()


def test_formulas_and_fallbacks_stay():
    formula = "<math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><annotation>a+b</annotation></math>"
    assert extraction.main_text(f"<body><article><p>Here {formula} stands. {TEXT}</p></article></body>") == f"Here a+b stands. {TEXT}".strip()
    assert "A table of trees." in extraction.main_text(f"<body><article><p>{TEXT}</p><object data=x><p>A table of trees.</p></object><p>{TEXT}</p></article></body>")


def test_pages_of_parts(spark):
    """Pages put together from the parts of given pages: what is known to be the article comes out, and nothing else."""
    import re

    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect() if r["html"]]
    menus, articles, feet = ([m[0] for p in pages if (m := re.search(rf"<{t}>.*?</{t}>", p, re.S))] for t in ("nav", "article", "footer"))
    plain = lambda x: extraction.main_text(f"<body>{x}</body>")
    for k, own in enumerate(articles):
        menu, foot = menus[k % len(menus)], feet[-1 - k % len(feet)]
        other = re.sub("article>", "div>", articles[k - 1])
        for page in (f"{menu}{own}{foot}", f'<div class="page-wrapper">{menu}<div class="content">{own}</div><div class="comments">{other}</div>{foot}</div>', f'{menu}<aside>{other}</aside>{own}<div class="related-posts">{other}</div>'):
            assert plain(page) == plain(own) != ""


def test_no_pages(spark):
    none = extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]
