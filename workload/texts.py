"""Label, URL, text and media queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import labels, markup, text, urls
from newsloom.functions.dates import day_number_col, number_day_col
from newsloom.functions.scoring import goldstein_percent, risk_score, threat_band
from newsloom.operators import media
from newsloom.schema import ACTOR_TYPE_LABELS, QUAD_CLASS_LABELS, ROOT_CODE_LABELS
from newsloom.sources import demo_feeds
from newsloom.sources.demo_events import enriched_events, table
from workload.base import on_events, pick, r6, register, score


@register(
    "url_domains",
    """SELECT page_id, split_part(replace(replace(replace(lower(url), 'https://', ''), 'http://', ''), 'www.', ''),
    '/', 1) AS domain FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


_PREFIXES = "theme"
for _prefix in labels.THEME_PREFIXES:
    _PREFIXES = f"regexp_replace({_PREFIXES}, '^{_prefix}', '', 'i')"


@register(
    "theme_names",
    on_events(
        f"""SELECT theme, array_to_string(list_transform(string_split(lower(replace({_PREFIXES}, '_', ' ')), ' '),
        lambda w: upper(w[1]) || w[2:]), ' ') AS name, n FROM (SELECT theme, count(*) AS n
        FROM (SELECT unnest(themes) AS theme FROM ev) GROUP BY 1)"""
    ),
)
def _(spark, sf):
    themes = enriched_events(spark, sf).select(F.explode("themes").alias("theme"))
    counts = themes.groupBy("theme").agg(F.count("*").alias("n"))
    return counts.select("theme", labels.clean_theme(F.col("theme")).alias("name"), "n")


def _cases(column, values):
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in values.items()) + " END"


@register(
    "code_labels",
    on_events(
        f"""SELECT QuadClass::BIGINT AS quad_class, EventRootCode AS root_code, Actor1Type1Code AS actor_type,
        {_cases('QuadClass', QUAD_CLASS_LABELS)} AS quad_label, {_cases('EventRootCode', ROOT_CODE_LABELS)} AS root_label,
        {_cases('Actor1Type1Code', ACTOR_TYPE_LABELS)} AS actor_label, count(*) AS n FROM ev GROUP BY ALL"""
    ),
)
def _(spark, sf):
    counts = enriched_events(spark, sf).groupBy(
        F.col("QuadClass").alias("quad_class"),
        F.col("EventRootCode").alias("root_code"),
        F.col("Actor1Type1Code").alias("actor_type"),
    ).agg(F.count("*").alias("n"))
    return counts.withColumns(
        {
            "quad_label": labels.quad_class_label(F.col("quad_class")),
            "root_label": labels.root_code_label(F.col("root_code")),
            "actor_label": labels.actor_type_label(F.col("actor_type")),
        }
    )


@register(
    "event_texts",
    on_events(
        """SELECT words AS text, count(*) AS n FROM (SELECT lower(concat_ws(' ', 'actor_' || Actor1CountryCode,
          'actor_' || Actor2CountryCode, 'event_' || EventRootCode,
          CASE WHEN GoldsteinScale < -5 THEN 'tone_highly_negative' WHEN GoldsteinScale < 0 THEN 'tone_negative'
            WHEN GoldsteinScale > 5 THEN 'tone_highly_positive' WHEN GoldsteinScale > 0 THEN 'tone_positive'
            ELSE 'tone_neutral' END)) AS words FROM ev) GROUP BY 1"""
    ),
)
def _(spark, sf):
    words = text.event_text(
        F.col("Actor1CountryCode"), F.col("Actor2CountryCode"), F.col("EventRootCode"), F.col("GoldsteinScale")
    )
    return enriched_events(spark, sf).groupBy(words.alias("text")).agg(F.count("*").alias("n"))


def _count_sql(n, digits):
    return f"""CASE WHEN {n} >= 1000000 THEN printf('%.1f', round({n} / 1e6::DOUBLE, 1)) || 'M'
      WHEN {n} >= 1000 THEN printf('%.{digits}f', round({n} / 1e3::DOUBLE, {digits})) || 'K' ELSE ({n})::VARCHAR END"""


@register(
    "number_texts",
    on_events(
        f"""SELECT cc, CASE WHEN tone IS NULL THEN 'N/A' ELSE printf('%.2f', round(tone, 2) + 0.0) END AS tone,
        printf('%.1f', round(c::DOUBLE / n * 100, 1)) || '%' AS ratio, printf('%.1f', round(c::DOUBLE / n * 100, 1)) AS share,
        {_count_sql('m', 1)} AS mentions, {_count_sql('m * 97', 1)} AS many, {_count_sql('m', 0)} AS axis
        FROM (SELECT ActionGeo_CountryCode AS cc, avg(AvgTone) AS tone, count(*) AS n, sum(NumMentions)::BIGINT AS m,
          count(*) FILTER (QuadClass >= 3) AS c FROM ev GROUP BY 1)"""
    ),
)
def _(spark, sf):
    stats = enriched_events(spark, sf).groupBy(F.col("ActionGeo_CountryCode").alias("cc")).agg(
        F.avg("AvgTone").alias("avg_tone"),
        F.count("*").alias("n"),
        F.sum("NumMentions").alias("m"),
        F.count_if(F.col("QuadClass") >= 3).alias("c"),
    )
    return stats.select(
        "cc",
        labels.tone_text(F.col("avg_tone")).alias("tone"),
        labels.ratio_text(F.col("c").cast("double") / F.col("n")).alias("ratio"),
        labels.share_text(F.col("c"), F.col("n")).alias("share"),
        labels.count_text(F.col("m")).alias("mentions"),
        labels.count_text(F.col("m") * 97).alias("many"),
        labels.count_text(F.col("m"), 0).alias("axis"),
    )


@register(
    "event_gauges",
    on_events(
        f"""SELECT GLOBALEVENTID, {r6('(GoldsteinScale + 10) / 20 * 100')} AS goldstein_percent,
        {score('(GLOBALEVENTID % 11)::DOUBLE / 10', 'GoldsteinScale', 'AvgTone')} AS score,
        CASE WHEN s > 70 THEN 'CRITICAL' WHEN s > 50 THEN 'ELEVATED' WHEN s > 30 THEN 'MODERATE' ELSE 'LOW' END AS band,
        strftime(d + 1, '%Y-%m-%d') AS next_day,
        (year(d + 1) * 10000 + month(d + 1) * 100 + day(d + 1))::BIGINT AS next_number
        FROM (SELECT *, {score('(GLOBALEVENTID % 11)::DOUBLE / 10', 'GoldsteinScale', 'AvgTone')} AS s FROM ev)"""
    ),
)
def _(spark, sf):
    share = (F.col("GLOBALEVENTID") % 11).cast("double") / 10
    points = risk_score(share, F.col("GoldsteinScale"), F.col("AvgTone"))
    next_day = F.date_add(number_day_col(F.col("SQLDATE")), 1)
    return enriched_events(spark, sf).select(
        "GLOBALEVENTID",
        goldstein_percent(F.col("GoldsteinScale")).alias("goldstein_percent"),
        points.alias("score"),
        threat_band(points).alias("band"),
        next_day.alias("next_day"),
        day_number_col(next_day).alias("next_number"),
    )


_POOR = "|".join(text.POOR_BRIEFING_PATTERNS)


@register(
    "poor_briefings",
    f"""SELECT doc_id, regexp_matches(lower(t), '{_POOR}') AS poor FROM (SELECT doc_id, text || ' ' ||
    {pick(('It could REFER to anything.', 'This appears to be coded.', 'Assuming it refers to a port.', 'All calm.'), 'doc_id')}
    AS t FROM documents)""",
)
def _(spark, sf):
    phrase = F.element_at(
        F.array(*(F.lit(p) for p in ("It could REFER to anything.", "This appears to be coded.",
                                     "Assuming it refers to a port.", "All calm."))),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    poor = text.is_poor_briefing(F.concat("text", F.lit(" "), phrase))
    return table(spark, sf, "documents").select("doc_id", poor.alias("poor"))


_BODY = "trim(text, E' \\t\\n\\r\\f\\x0b')"


@register(
    "article_texts",
    f"""SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN length({_BODY}) < 100 THEN NULL
    WHEN length({_BODY}) > 8000 THEN {_BODY}[1:8000] || '...' ELSE {_BODY} END AS t FROM documents)""",
)
def _(spark, sf):
    body = text.article_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(body).alias("chars"), F.md5(body).alias("digest")
    )


# --- media --------------------------------------------------------------------------


_IMAGES, _LINKS = demo_feeds.ARTICLE_IMAGES, demo_feeds.ARTICLE_LINKS
_PAGES = f"""art AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'Untitled') AS title,
    CASE WHEN page_id % 12 = 5 THEN 'Too short.' ELSE html || ' ![pic](' || {pick(_IMAGES, 'page_id + 3')} || ') <IMG src='''
      || {pick(_IMAGES, 'page_id + 4')} || '''> see ' || {pick(_LINKS, 'page_id + 2')} || ' ' END AS content,
    {pick(_IMAGES, 'page_id')} AS image, CASE page_id % 3 WHEN 0 THEN 'Main photo' WHEN 1 THEN 'Site logo' ELSE '' END AS alt,
    CASE WHEN page_id % 2 = 0 THEN page_id % 7 * 100 END AS width,
    CASE WHEN page_id % 2 = 0 THEN page_id % 5 * 150 END AS height, {pick(_LINKS, 'page_id')} AS link FROM pages)"""

# What the score and the embed rule must give for the fixed media links, worked out by hand.
_EMBEDS = {
    "https://www.youtube.com/watch?v=abc": "https://www.youtube.com/embed/abc",
    "https://youtu.be/xyz9?t=3": "https://www.youtube.com/embed/xyz9",
    "https://vimeo.com/1234567": "https://player.vimeo.com/video/1234567",
    "https://x.com/desk/status/42?s=20": "https://twitframe.com/show?url=https%3A%2F%2Fx.com%2Fdesk%2Fstatus%2F42%3Fs%3D20",
    "https://www.youtube.com/shorts/sh0rt/more": "https://www.youtube.com/embed/sh0rt",
    "https://player.vimeo.com/video/99": "https://player.vimeo.com/video/99",
}
_BASE_SCORES = {
    "https://cdn.example.com/photos/story.jpg": 3,
    "https://example.com/images/logo.png": -1,
    "https://example.com/icon.svg": -5,
    "https://example.com/photo.jpg?w=32&h=32": -3,
    "https://d1.cloudfront.net/media/large/hero.webp?width=800": 5,
    "https://gravatar.com/avatar/me": -5,
    "https://example.com/static/banner.gif?size=64": -7,
}
_ASSETS = [u for u, s in _BASE_SCORES.items() if s < 0]


def _match(column, answers):
    quoted = "CASE " + column + " "
    return quoted + " ".join(
        f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in answers.items()
    ) + " END"


_SCORE = f"""{_match('image', _BASE_SCORES)} + CASE alt WHEN 'Main photo' THEN 2 ELSE 0 END
  + CASE WHEN width > 0 AND height > 0 AND least(width, height) <= 80 THEN -2
    WHEN width > 0 AND height > 0 AND greatest(width, height) >= 400 THEN 1 ELSE 0 END"""


@register(
    "image_scores",
    f"""WITH {_PAGES} SELECT page_id, 0::BIGINT AS at, image AS url, ({_SCORE})::BIGINT AS score FROM art
    WHERE image NOT LIKE 'ftp%'""",
)
def _(spark, sf):
    return media.page_images(demo_feeds.article_pages(spark, sf))


@register(
    "asset_images",
    f"""WITH {_PAGES} SELECT page_id, image AS url, image IN {tuple(_ASSETS)} AS is_asset FROM art""",
)
def _(spark, sf):
    images = demo_feeds.article_pages(spark, sf).select("page_id", F.col("images")[0]["url"].alias("url"))
    return images.withColumn("is_asset", urls.is_asset_image(F.col("url")))


@register(
    "embed_links",
    f"WITH {_PAGES} SELECT page_id, link, {_match('link', _EMBEDS)} AS embed FROM art",
)
def _(spark, sf):
    links = demo_feeds.article_pages(spark, sf).select("page_id", F.col("links")[0].alias("link"))
    return links.withColumn("embed", urls.embed_url(F.col("link")))


@register(
    "text_links",
    f"""WITH {_PAGES} SELECT page_id, array_to_string(regexp_extract_all(content, '!\\[[^\\]]*\\]\\((https?://[^)\\s]+)\\)', 1)
      || regexp_extract_all(content, '(?i)<img[^>]+src=[''"](https?://[^''">\\s]+)', 1), '|') AS images,
    array_to_string(regexp_extract_all(content, 'https?://[^\\s)\\]}}>"'']+'), '|') AS links FROM art""",
)
def _(spark, sf):
    content = F.col("content")
    return demo_feeds.article_pages(spark, sf).select(
        "page_id", urls.image_urls_in_text(content).alias("images"), urls.urls_in_text(content).alias("links")
    )


@register(
    "articles",
    f"""WITH {_PAGES}, shown AS (SELECT *, trim(content) AS body FROM art WHERE length(trim(content)) >= 100),
    pictures AS (
      SELECT page_id, 0 AS pos, image AS url, {_SCORE} AS score FROM shown UNION ALL
      SELECT page_id, 1, image, {_match('image', _BASE_SCORES)} FROM (SELECT page_id, {pick(_IMAGES, 'page_id + 3')} AS image
        FROM shown) UNION ALL
      SELECT page_id, 2, image, {_match('image', _BASE_SCORES)} FROM (SELECT page_id, {pick(_IMAGES, 'page_id + 4')} AS image
        FROM shown)),
    web AS (SELECT * FROM pictures WHERE url NOT LIKE 'ftp%'),
    fit AS (SELECT *, max(score) OVER (PARTITION BY page_id) >= 1 AS has_good, max(score) OVER (PARTITION BY page_id, url) AS top FROM web),
    firsts AS (SELECT page_id, url, max(score) AS score, min(pos) FILTER (score = top) AS pos FROM fit
      WHERE score >= 1 OR NOT has_good GROUP BY 1, 2),
    images AS (SELECT page_id, string_agg(url, '|' ORDER BY score DESC, pos) AS images FROM firsts GROUP BY 1),
    links AS (SELECT page_id, 0 AS pos, link FROM shown UNION ALL SELECT page_id, 1, {pick(_IMAGES, 'page_id + 3')} FROM shown
      UNION ALL SELECT page_id, 2, {pick(_IMAGES, 'page_id + 4')} FROM shown
      UNION ALL SELECT page_id, 3, {pick(_LINKS, 'page_id + 2')} FROM shown),
    players AS (SELECT page_id, embed, min(pos) AS pos FROM (SELECT page_id, pos, {_match('link', _EMBEDS)} AS embed FROM links)
      WHERE embed IS NOT NULL GROUP BY 1, 2),
    embeds AS (SELECT page_id, string_agg(embed, '|' ORDER BY pos) AS embeds FROM players GROUP BY 1)
    SELECT s.page_id, title, CASE WHEN length(body) > 8000 THEN body[1:8000] || '...' ELSE body END AS text,
      coalesce(images, '') AS images, coalesce(embeds, '') AS embeds
    FROM shown s LEFT JOIN images i ON i.page_id = s.page_id LEFT JOIN embeds e ON e.page_id = s.page_id""",
)
def _(spark, sf):
    return media.extract_articles(demo_feeds.article_pages(spark, sf))


# --- raw pages ------------------------------------------------------------------------

_BARE = """bare AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
    '<script.*?</script\\s*>', ' ', 'gis'), '<style.*?</style\\s*>', ' ', 'gis') AS b FROM pages)"""


def _decoded(column):
    for reference, character in markup.REFERENCES:
        column = f"replace({column}, '{reference}', {'chr(39)' if character == chr(39) else repr(character)})"
    return column


def _without(column, names):
    for name in names:
        column = f"regexp_replace({column}, '<{name}\\b.*?</{name}\\s*>', chr(10), 'gis')"
    return column


@register(
    "page_media",
    f"""WITH {_BARE}, found AS (SELECT page_id, url, regexp_extract_all(b, '<a\\s+href="([^"]*)"', 1, 'i') AS links FROM bare),
    counted AS (SELECT page_id, url, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS pos FROM found)
    SELECT page_id, pos::BIGINT AS "at", 'link' AS kind, 'a' AS tag, regexp_extract(url, '^https?://[^/?#]*') || {_decoded('link')} AS url,
      '' AS alt, NULL::BIGINT AS width, NULL::BIGINT AS height FROM counted""",
)
def _(spark, sf):
    return media.page_media(table(spark, sf, "pages"))


_BLOCKS = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|article|section|main|header|table|tr|td|th|blockquote|pre|figure|figcaption|body|html"


@register(
    "page_articles",
    f"""WITH {_BARE}, lines AS (SELECT page_id, b, regexp_replace(regexp_replace(
        {_without('b', ('head', 'nav', 'footer', 'aside', 'form', 'svg'))}, '[ \\t\\r\\n\\f]+', ' ', 'g'),
        '</?(?:{_BLOCKS})(?:[\\s/][^>]*)?>', chr(10), 'gi') AS t FROM bare),
      texts AS (SELECT page_id, {_decoded("regexp_replace(regexp_extract(b, '<title[^>]*>(.*?)</title', 1, 'is'), '[ ]+', ' ', 'g')")} AS title,
        trim(regexp_replace(regexp_replace({_decoded("regexp_replace(t, '<[/!a-zA-Z][^>]*>', '', 'g')")}, '[ \u00a0]+', ' ', 'g'),
          ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS body FROM lines)
    SELECT page_id, coalesce(nullif(trim(title), ''), 'Untitled') AS title,
      md5(CASE WHEN length(body) > 8000 THEN body[1:8000] || '...' ELSE body END) AS digest,
      CASE WHEN length(body) > 8000 THEN 8003 ELSE length(body) END AS chars, '' AS images, '' AS embeds FROM texts WHERE length(body) >= 100""",
)
def _(spark, sf):
    articles = media.extract_articles(media.read_pages(table(spark, sf, "pages")))
    return articles.select("page_id", "title", F.md5("text").alias("digest"), F.length("text").alias("chars"), "images", "embeds")
