"""Subtitle cleaning, tag stripping and page extraction."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelrank.functions import text as tx
from reelrank.operators import scripts as sc


def _model_clean(text):
    """State-machine reading of the cleaning rule: skip 3 lines, a blank
    line swallows the next two, every other line is emitted plus a space."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if text.endswith("\n") or text.endswith("\r"):
        lines = lines[:-1]
    out, i = [], 3
    while i < len(lines):
        if lines[i] == "":
            i += 3
            continue
        out.append(lines[i] + " ")
        i += 1
    return "".join(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "1", "00:00:01,000 --> 00:00:02,000", "hello", "a b"]),
                min_size=0, max_size=14),
       st.booleans())
def test_srt_clean_matches_state_machine(spark, parts, trailing):
    text = "\n".join(parts) + ("\n" if trailing else "")
    got = spark.createDataFrame([(text,)], "t string").select(tx.srt_clean(F.col("t")).alias("c")).first().c
    assert got == _model_clean(text)


def test_strip_tags_only_on_tagged_lines(spark):
    df = spark.createDataFrame([("<i>Tom &amp; Jerry</i>",), ("Tom &amp; Jerry",)], "x string")
    got = [r.y for r in df.select(tx.strip_tags(F.col("x")).alias("y")).collect()]
    assert got == ["Tom & Jerry", "Tom &amp; Jerry"]


def test_cue_mode_keeps_first_cue(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\n<i>World</i>\n"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.srt_clean(F.col("t"), "cue").alias("c")).first().c == "Hello World "
    assert df.select(tx.srt_clean(F.col("t")).alias("c")).first().c == "World "


def test_merge_orders_files_by_name(spark):
    files = spark.createDataFrame(
        [("m", "cd2.srt", "x\ny\nz\nsecond\n"), ("m", "cd1.srt", "x\ny\nz\nfirst\n")],
        "movie_id string, file_name string, text string")
    r = sc.srt_merge(files).first()
    assert (r.text, r.n_files) == ("first second ", 2)


HTML = ('<html><head><script>var a="<p>no</p>";</script></head><body>'
        '<nav><a href="/plot">Plot Summary</a><a href="/x">Other</a></nav>'
        '<p class="plotSummary"> First &amp; plot. </p><p>Second <b>plot</b></p>'
        '<div class="ad">Syn <b>opsis</b> text</div></body></html>')


def test_page_extraction(spark):
    df = spark.createDataFrame([(1, "https://example.org/title/1?x=1", HTML)], "id int, url string, html string")
    r = df.select(tx.paragraphs(F.col("html")).alias("p"),
                  tx.link_by_text(F.col("html"), F.col("url"), "Plot Summary").alias("l"),
                  tx.section_text(F.col("html"), sc.SECTION_OPEN, sc.SECTION_CLOSE).alias("s")).first()
    assert r.p == ["First & plot.", "Second plot"]
    assert r.l == "https://example.org/plot"
    assert r.s == "Syn \nopsis\n text"


def test_paragraphs_of_a_class(spark):
    html = ("<p class='a plot'>one</p><P CLASS=plot id=x>two</P><p class=\"plots\">no</p><p data-x=\"plot\">no</p>"
            "<pre class=\"plot\">no</pre><p class=\"Plot\">no</p><p>no</p><p id=y class=\"plot b\">th<b>re</b>e</p>")
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = [r.p for r in df.select(tx.paragraphs(F.col("html"), "plot").alias("p")).collect()]
    assert got == [["one", "two", "three"], None, []]
    assert df.select(F.size(tx.paragraphs(F.col("html"))).alias("n")).first().n == 7


def test_plots_empty_page_gives_empty_array(spark):
    df = spark.createDataFrame([(1, "<html></html>")], "page_id int, html string")
    r = sc.plots(df).first()
    assert r.plots == [] and r.text == ""


def test_movie_docs_no_separator(spark):
    s = spark.createDataFrame([("1", "script "), ("2", "only")], "movie_id string, text string")
    p = spark.createDataFrame([("1", "plot")], "movie_id string, text string")
    got = {r.movie_id: r.text for r in sc.movie_docs(s, p).collect()}
    assert got == {"1": "script plot", "2": "only"}


def test_entities_equal_the_standard_decoder(spark):
    """Random references, whole and broken, against html.unescape."""
    import html
    import random

    rng = random.Random(9)
    names = sorted(tx.entity_names())
    pick = [lambda: "&" + rng.choice(names), lambda: "&" + rng.choice(names).rstrip(";"), lambda: f"&#{rng.randint(0, 0x110010)};",
            lambda: f"&#x{rng.randint(0, 0x2FFFF):x}", lambda: f"&#{rng.choice([0, 1, 9, 11, 13, 128, 129, 0xD800, 0xFDD0, 0xFFFE, 65, 99999999999])}",
            lambda: rng.choice(["&", "&amp;lt;", "&;", "&#;", "&#x;", "&ampx", "&notit;", "&copy2020", "a b", "é", "#", ";", "&lt;b&gt;", "&zz;", "&#0065;"])]
    texts = ["".join(rng.choice(pick)() for _ in range(rng.randint(0, 5))) for _ in range(3000)] + ["&" + n for n in names]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string").repartition(4)
    got = {r.i: r.u for r in df.select("i", tx.unescape_entities(F.col("t")).alias("u")).collect()}
    assert got.pop(-1) is None
    bad = [(texts[i], u, html.unescape(texts[i])) for i, u in got.items() if u != html.unescape(texts[i])]
    assert bad == []


def test_nested_containers(spark):
    rows = ['<div class="a x">1<div>2<div >3</div></div><p>4</p></div>5', '<DIV ID=top><div/>a</div>b</div>c', "no", None, "",
            "<divx class='x'>n</divx><div class='y'>n</div><div class='z x'>k<script>var a='</div>'</script>m</div>n", '<div class="x">open <b>end']
    df = spark.createDataFrame([(r,) for r in rows], "html string")
    got = [r.t for r in df.select(tx.container_text(F.col("html"), "div", css_class="x").alias("t")).collect()]
    assert got == ["1\n2\n3\n4", None, None, None, None, "km", "open \nend"]
    ids = [r.t for r in df.select(tx.container_text(F.col("html"), "div", element_id="top").alias("t")).collect()]
    assert ids[1] == "a\nb" and ids[0] is None


def test_links_of_any_quoting(spark):
    rows = ['<a href="/w" data-href="/z">Go</a>', '<a data-href="/z" href="/w">Go</a>', "<a class=q href='/w'><b>Go</b></a>", "<a href=/w>Go</a>",
            '<a data-href="/z">Go</a>', "<abbr href='/w'>Go</abbr>", "<a href='https://o.org/w'>Go</a>"]
    df = spark.createDataFrame([(r,) for r in rows], "html string")
    got = [r.l for r in df.select(tx.link_by_text(F.col("html"), F.lit("https://e.org/a?b"), "Go").alias("l")).collect()]
    assert got == ["https://e.org/w"] * 4 + [None, None, "https://o.org/w"]
