from pyspark.sql import functions as F

from newsloom.functions import labels, markup, text, urls
from newsloom.functions.scoring import goldstein_percent, risk_score, threat_band
from newsloom.operators.media import IMAGE_TYPE, extract_articles, page_media, read_pages
from tests.conftest import plan


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def each(spark, values, rule, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", rule(F.col("v"))).orderBy("i").collect()]


def test_theme_names(spark):
    raw = ["WB_635_PUBLIC_HEALTH", "TAX_FNCACT_PRESIDENT", "CRISISLEX_C07_SAFETY", "econ_trade", "USPEC_UNGP_X-RAY", "A"]
    assert each(spark, raw, labels.clean_theme) == ["Public Health", "President", "Safety", "Trade", "X-Ray", "A"]


def test_labels(spark):
    assert each(spark, [1, 4, 9], labels.quad_class_label, "int") == ["Verbal Cooperation", "Material Conflict", None]
    assert each(spark, ["20", "1"], labels.root_code_label) == ["Use Unconventional Mass Violence", None]
    assert each(spark, ["SPY", "XXX"], labels.actor_type_label) == ["Intelligence", None]


def test_number_texts(spark):
    assert each(spark, [999, 1000, 1250, 1_000_000], labels.count_text, "long") == ["999", "1.0K", "1.3K", "1.0M"]
    assert each(spark, [1500], lambda v: labels.count_text(v, 0), "long") == ["2K"]
    assert each(spark, [None, -3.456], labels.tone_text, "double") == ["N/A", "-3.46"]
    assert each(spark, [0.1234], labels.ratio_text, "double") == ["12.3%"]
    assert one(spark, labels.share_text(F.lit(1), F.lit(0))) == "0.0"


def test_risk(spark):
    def score(*parts):
        return one(spark, risk_score(*(F.lit(p).cast("double") for p in parts)))

    assert score(None, None, None) == 30  # 50 * 0.35 + 50 * 0.25
    assert score(1.0, -10.0, -30.0) == 100 and score(0.0, 10.0, 30.0) == 0
    assert score(0.0, -99.0, 99.0) == 35
    assert score(0.0, 10.0, 28.8) == 0 and score(0.0, 10.0, 26.4) == 2  # 0.5 and 1.5 go to the even number
    assert each(spark, [30, 31, 50, 51, 70, 71], threat_band, "int") == [
        "LOW", "MODERATE", "MODERATE", "ELEVATED", "ELEVATED", "CRITICAL",
    ]
    assert each(spark, [None, -20.0, 5.0], goldstein_percent, "double") == [50.0, 0.0, 75.0]


def test_briefing_check(spark):
    texts = ["I am UNABLE to verify it", "could refer to", "Assuming refers to X", "appears to be cryptic", "All well"]
    assert each(spark, texts, text.is_poor_briefing) == [True, True, True, True, False]


def test_event_text(spark):
    nothing = F.lit(None).cast("string")
    assert one(spark, text.event_text(nothing, F.lit(""), nothing, F.lit(None).cast("double"))) == "unknown_features"
    full = text.event_text(F.lit("US"), F.lit("CN"), F.lit("19"), F.lit(-5.0))
    assert one(spark, full) == "actor_us actor_cn event_19 tone_negative"
    assert each(spark, [-5.1, -5.0, 0.0, 5.0, 5.1, None], text.goldstein_bucket, "double") == [
        "tone_highly_negative", "tone_negative", "tone_neutral", "tone_positive", "tone_highly_positive", None,
    ]


def test_article_text(spark):
    short, long = " " * 50 + "x" * 99, "Word " * 3000
    got = each(spark, [short, "y" * 100, long, None], text.article_text)
    assert got[0] is None and got[1] == "y" * 100 and got[3] is None
    assert len(got[2]) == 8003 and got[2].endswith("...") and got[2][:8000] == long[:8000]


def test_urls(spark):
    assert each(spark, ["HTTP://www.BBC.com/a", "x.org", "https://a.www.b.c"], urls.domain) == ["bbc.com", "x.org", "a.b.c"]
    found = each(spark, ["http://a", "HTTPS://a/b", "ftp://a", "http:///x", "a.com", None], urls.is_web_url)
    assert found == [True, True, False, False, False, False]


def test_embeds(spark):
    cases = {
        "https://www.youtube.com/watch?v=abc&t=1": "https://www.youtube.com/embed/abc",
        "https://youtube.com/embed/xyz": "https://youtube.com/embed/xyz",
        "https://m.youtube.com/shorts/s1/x?y=1": "https://www.youtube.com/embed/s1",
        "https://youtube.com/": None,
        "https://youtu.be/q1?t=2": "https://www.youtube.com/embed/q1",
        "https://vimeo.com/channels/9876": "https://player.vimeo.com/video/9876",
        "https://player.vimeo.com/video/1": "https://player.vimeo.com/video/1",
        "https://vimeo.com/about": None,
        "https://x.com/a/status/1?b=c d*~": "https://twitframe.com/show?url=https%3A%2F%2Fx.com%2Fa%2Fstatus%2F1%3Fb%3Dc%20d%2A~",
        "https://twitter.com/a": None,
        "https://notx.com/a/status/1": None,
        "https://t.co/abc": None,
        "ftp://vimeo.com/1": None,
    }
    assert each(spark, list(cases), urls.embed_url) == list(cases.values())


def test_image_scores(spark):
    cases = [
        ("https://cdn.example.com/photos/story.jpg", None, None, None, 3),
        ("https://cdn.example.com/photos/story.jpg", "Lead picture", 500, 90, 6),
        ("https://cdn.example.com/photos/story.jpg", "Logo", 500, 80, 1),
        ("https://example.com/images/logo.png", "", 0, 500, -1),
        ("https://example.com/icon.svg", None, None, None, -5),
        ("https://example.com/photo.jpg?w=32&h=32", None, None, None, -3),
        ("https://example.com/photo.jpg?w=400&sz=64&size=x&other=1", None, None, None, 1),
        ("https://gravatar.com/a.png", None, None, None, -2),
        ("https://d.cloudfront.net/sortd-service/imaginary/jpg/x", None, None, None, 4),
        ("https://e.org/static/a.webp", None, None, None, -1),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, u string, a string, w int, h int, want int")
    got = rows.select("i", urls.image_score(F.col("u"), F.col("a"), F.col("w"), F.col("h"))).orderBy("i").collect()
    assert [r[1] for r in got] == [c[-1] for c in cases]
    assets = ["https://e.org/a.gif", "https://e.org/thumb/x.jpg", "https://e.org/p.jpg?w=64", "https://e.org/p.jpg?w=65"]
    assert each(spark, assets, urls.is_asset_image) == [True, True, True, False]


def test_article(spark):
    body = (
        "This is a long enough article body to pass the minimum content threshold. It includes an external embed "
        "link to ensure URL extraction works. https://vimeo.com/1234567 and ![x](https://e.org/hero.png)"
    )
    pictures = [
        ("https://example.com/images/logo.png", None, None, None),
        ("https://cdn.example.com/photos/story.jpg", None, None, None),
        ("https://example.com/icon.svg", None, None, None),
        ("https://cdn.example.com/photos/story.jpg", "Main", None, None),
    ]
    links = ["https://www.youtube.com/watch?v=abc", "https://news.example.com/article", "https://youtu.be/abc"]
    only_assets = [("https://example.com/logo.png", None, None, None), ("https://example.com/icon.svg", None, None, None)]
    rows = spark.createDataFrame(
        [(1, "T", body, pictures, links), (2, "", body.split("http")[0] * 2, only_assets, None), (3, "short", "too short", None, None)],
        f"page_id long, title string, content string, images {IMAGE_TYPE}, links array<string>",
    )
    got = extract_articles(rows).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [1, 2]
    assert got[0].images == ["https://cdn.example.com/photos/story.jpg", "https://e.org/hero.png"]
    assert got[0].embeds == ["https://www.youtube.com/embed/abc", "https://player.vimeo.com/video/1234567"]
    assert got[1].title == "Untitled"
    assert got[1].images == ["https://example.com/logo.png", "https://example.com/icon.svg"]
    many = [(f"https://e.org/photo{i}.jpg", None, None, None) for i in range(15)]
    wide = spark.createDataFrame([(1, "T", body, many, links * 4)], rows.schema)
    row = extract_articles(wide).first()
    assert len(row.images) == 10 and row.embeds == ["https://www.youtube.com/embed/abc"]
    free = extract_articles(wide, None, None, None).first()
    assert len(free.images) == 16 and free.embeds == [
        "https://www.youtube.com/embed/abc", "https://player.vimeo.com/video/1234567"
    ]


def test_resolved(spark):
    cases = [
        ("http://e.org/a/b?x=1#y", "c.png", "http://e.org/a/c.png"),
        ("http://e.org/a/b?x=1#y", "/c?d#e", "http://e.org/c?d#e"),
        ("https://e.org/a/b", "//f.org/c", "https://f.org/c"),
        ("http://e.org/a/b?x=1#y", "?z", "http://e.org/a/b?z"),
        ("http://e.org/a/b?x=1#y", "#z", "http://e.org/a/b?x=1#z"),
        ("http://e.org", "c", "http://e.org/c"),
        ("http://e.org/a/b/c", "../d/./e.png?f=/../g", "http://e.org/a/d/e.png?f=/../g"),
        ("http://e.org/a/b/c", "../../../..", "http://e.org/"),
        ("http://e.org/a/b/c/d", "..", "http://e.org/a/b/"),
        ("http://e.org/a", " mailto:x@e.org ", "mailto:x@e.org"),
        (None, "c.png", "c.png"),
        ("http://e.org/a", None, None),
    ]
    rows = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "i int, base string, link string, want string")
    got = rows.withColumn("parts", markup.address_parts(F.col("base"))).select("i", markup.resolved(F.col("link"), F.col("parts")))
    assert [r[1] for r in got.orderBy("i").collect()] == [case[-1] for case in cases]


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B
 </title><meta property="og:image" content="/photos/lead.jpg?a=1&amp;b=2"><META content='https://vimeo.com/77' name=og:video>
<script>var t = '<img src="/no1.png">'; if (a < b) {}</script><style>i{background:url(x)}</style></head><body>
<!-- <img src="/no2.png"> --><nav><a href="/menu">Menu</a></nav><template><img src=/no3.png></template>
<article><h1>Title</h1><p title="a > b">Some&nbsp;<b>bo</b>ld text &lt;here&gt;.</p>
<IMG alt="say src=/no4.png" SRC='story.jpg' width=640 height="480px" src="/no5.png">
<img data-src="late.jpg" src="data:image/gif;base64,AA" width="50%">
<img srcset="s.jpg 320w, ../l,1.jpg 1200w,m.jpg 640w" src="s.jpg"><picture><source srcset="w.webp, w2.webp 2x"></picture>
<iframe src="//www.youtube.com/embed/abc"></iframe><video src="clip.mp4"><source src="clip.webm"></video>
<a class=x href='https://youtu.be/xyz?t=1'>watch</a><a name="top">no address</a><img><abbr href="/no6">x</abbr></article>
<footer>Foot</footer><img src=/last.png"""


def test_media_of_raw_pages(spark):
    pages = [(1, "https://e.org/news/day/1.html", PAGE), (2, "https://e.org/", None), (3, "https://e.org/", ""), (4, None, "<p>x")]
    pages += [(5, "https://e.org/", '<base href="//cdn.org/x/"><img src="a.png">')] * 2
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("media", F.lit("clash"))
    got = page_media(rows)
    assert "Exchange" not in plan(got)
    found = [(r.kind, r.tag, r.url, r.alt, r.width, r.height) for r in got.orderBy("page_id", "at").collect() if r.page_id == 1]
    day = "https://e.org/news/day/"
    assert found == [
        ("image", "meta", "https://e.org/photos/lead.jpg?a=1&b=2", "", None, None),
        ("embed", "meta", "https://vimeo.com/77", "", None, None),
        ("link", "a", "https://e.org/menu", "", None, None),
        ("image", "img", day + "story.jpg", "say src=/no4.png", 640, 480),
        ("image", "img", day + "late.jpg", "", None, None),
        ("image", "img", day + "s.jpg", "", None, None),
        ("image", "img", "https://e.org/news/l,1.jpg", "", 1200, None),
        ("image", "source", day + "w2.webp", "", None, None),
        ("embed", "iframe", "https://www.youtube.com/embed/abc", "", None, None),
        ("embed", "video", day + "clip.mp4", "", None, None),
        ("embed", "source", day + "clip.webm", "", None, None),
        ("link", "a", "https://youtu.be/xyz?t=1", "", None, None),
        ("image", "img", "https://e.org/last.png", "", None, None),
    ]
    assert [r.url for r in got.where("page_id > 1").collect()] == ["https://cdn.org/x/a.png"] * 2


def test_raw_page_to_article(spark):
    long = PAGE.replace("text &lt;here&gt;", "text &lt;here&gt; " + "and more " * 20)
    rows = spark.createDataFrame([(1, "https://e.org/news/day/1.html", long), (2, None, None)], "page_id long, url string, html string")
    read = read_pages(rows).orderBy("page_id").collect()
    assert (read[0].title, read[1].title, read[1].content, read[1].images, read[1].links) == ("A & B", "", "", [], [])
    assert read[0].content.split("\n")[:2] == ["Title", "Some bold text <here> " + "and more " * 19 + "and more ."]
    article = extract_articles(read_pages(rows)).collect()
    assert [r.page_id for r in article] == [1]
    assert article[0].images[:2] == ["https://e.org/news/day/story.jpg", "https://e.org/photos/lead.jpg?a=1&b=2"]
    assert article[0].embeds == [
        "https://player.vimeo.com/video/77", "https://www.youtube.com/embed/abc", "https://www.youtube.com/embed/xyz"
    ]


def test_very_long_page_and_tag(spark):
    tag = "<img " + " ".join(f'data-a{i}="v{i}"' for i in range(3_000)) + ' src="/far.png">'
    html = "<p>x</p>" * 20_000 + tag + "<!-- open " + "y" * 100_000
    rows = spark.createDataFrame([(1, "http://e.org/", html)], "page_id long, url string, html string")
    assert [r.url for r in page_media(rows).collect()] == ["http://e.org/far.png"]
    assert read_pages(rows).first().content == "x" + "\nx" * 19_999
