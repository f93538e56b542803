"""Pages as rows: places against Python's parser by hand, families of items, nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources import elements as X

PAGE = """<html><body><nav><div class="card"><h2>Menu Card</h2></div></nav>
<div class="portfolio-item big"><img alt="logo" src="x.png"><h3>Alfa <b>Spa</b></h3><div class="card"><h4>Inner</h4><a href="/inner">in</a></div></div>
<article><a href="https://beta.it">Beta &amp; Co</a></article><div class="card"><img alt=" Gamma " data-src="g.png" src="lazy.gif"></div><div class="card"><p>no name</div>
<div class="logo-grid"><figure><img alt="Delta" src="d.png"><noscript><img alt="delta" src="d2.png"></noscript></figure><img alt="logo" src="e.png"></div>
<h2>Epsilon Group</h2><h2>Our portfolio</h2><h3>epsilon small</h3><h3>Epsilon group</h3>
<table><tr><th>Name<th>Sector</tr><tr><td>Zeta<td><b>Food</b> tech<tr><td><td>Nameless</table><svg><title>Eta</title><path d="M0"/></svg><![odd[ x ]]><script>var t = "<h2>Not Here</h2>";</script>
<ul><li>one<li>two</ul><p>open <b>bold"""


def test_items(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain text < 3"), (5, PAGE)], "page_id long, html string").repartition(3)
    rows = X.items(X.elements(pages)).collect()
    got = sorted(((r.family, r.name, r.link, r.image, r.cells and tuple(r.cells)) for r in rows if r.page == 1), key=repr)
    assert got == sorted(
        [("card", "Alfa Spa", "/inner", "x.png", None), ("card", "Beta & Co", "https://beta.it", None, None), ("card", "Gamma", None, "g.png", None), ("logo", "Delta", None, "d.png", None), ("heading", "Epsilon Group", None, None, None),
         ("row", "Name", None, None, ("Name", "Sector")), ("row", "Zeta", None, None, ("Zeta", "Food tech")), ("svg", "Eta", None, None, None)],
        key=repr,
    )
    assert {r.page for r in rows} == {1, 5} and len(rows) == 2 * len(got)


def test_places(spark):
    rows = X.read(PAGE)
    assert [r[0] for r in rows] == sorted({r[0] for r in rows}) and all(r[0] <= r[1] for r in rows)
    for a in rows:  # intervals are nested or apart, and depth counts those around
        around = [b for b in rows if b[0] < a[0] <= b[1]]
        assert all(b[1] >= a[1] for b in around) and len(around) == a[2]
    assert [r[3] for r in rows if r[3] in ("td", "th", "li")] == ["th", "th", "td", "td", "td", "td", "li", "li"] and X.read("") == []


def test_outermost(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<div class=card>" * 3000 + "x" + "<p>" * 3000)], "page_id long, html string")
    rows = X.elements(pages)
    chosen = F.col("attributes")["class"].isNotNull()
    every = [r for r in rows.where(chosen).collect()]
    wanted = sorted((a.page, a.at) for a in every if not any(b.page == a.page and b.at < a.at <= b.until for b in every))
    assert sorted((r.page, r.at) for r in X.outermost(rows, chosen).collect()) == wanted and sum(p == 2 for p, _ in wanted) == 1
    assert X.items(rows.where("page > 9")).count() == 0


def test_references_as_the_sql_reads_them(spark, data, tmp_path):
    """Headings with other references than &amp;, and with ampersands that begin none, against the query's SQL."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from oracle import duck_rows, spark_rows

    from tessera.plans import QUERIES, SQL

    pq.write_table(pq.read_table(f"{data}/part.parquet"), tmp_path / "part.parquet")
    names = ["A &amp; B", 'say "&quot;x&quot;"', "cut off&amp", "a &&& b", "&lt;b&gt; &amp;lt; &#65;&nbsp;é", "&amp;amp;", "&", " & ", "x&ampy", "two\n lines &copy"]
    pages = [f"<html><body><article><h1>{n}</h1><p>t</p></article>" for n in names]
    pq.write_table(pa.table({"page_id": list(range(len(pages))), "html": pages}), tmp_path / "pages.parquet")
    assert spark_rows(QUERIES["s17_page_items"](spark, str(tmp_path))) == duck_rows(SQL["s17_page_items"], str(tmp_path))
