"""Feeds in landed form, derived from the driver's test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.schema import EVENT_POSITIONS
from newsloom.sources.demo_events import (
    ORGANIZATIONS,
    PERSONS,
    THEMES,
    enriched_events,
    page_key,
    pick,
    table,
)

# Media links the article pages are given, by page id.
ARTICLE_LINKS = (
    "https://www.youtube.com/watch?v=abc",
    "https://youtu.be/xyz9?t=3",
    "https://vimeo.com/1234567",
    "https://x.com/desk/status/42?s=20",
    "https://www.youtube.com/shorts/sh0rt/more",
    "https://news.example.com/plain",
    "https://player.vimeo.com/video/99",
)
ARTICLE_IMAGES = (
    "https://cdn.example.com/photos/story.jpg",
    "https://example.com/images/logo.png",
    "https://example.com/icon.svg",
    "https://example.com/photo.jpg?w=32&h=32",
    "https://d1.cloudfront.net/media/large/hero.webp?width=800",
    "https://gravatar.com/avatar/me",
    "ftp://example.com/photo.jpg",
    "https://example.com/static/banner.gif?size=64",
)
POOR_PHRASES = ("This could refer to many places.", "Without more context, no reading is safe.", "A calm week.")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as 58-field tab-separated lines; every 17th has a bad Goldstein value."""
    events = enriched_events(spark, sf_dir, urls=True)
    names = {at: name for name, at in EVENT_POSITIONS.items()}

    def field(at: int):
        if at not in names:
            return F.lit("")
        text = F.col(names[at]).cast("string")
        if names[at] == "GoldsteinScale":
            text = F.when(F.col("GLOBALEVENTID") % 17 == 0, "n/a").otherwise(text)
        return F.coalesce(text, F.lit(""))

    return events.select(F.concat_ws("\t", *(field(at) for at in range(58))).alias("value"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of events, one per order line, with some unusable confidences."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    keyed = lines.withColumn("page", page_key(pages, F.col("l_partkey")))
    confidence = F.when(F.col("l_partkey") % 19 == 0, "?").otherwise(
        (F.col("l_quantity") * 2).cast("int").cast("string")
    )
    return keyed.join(pages, F.col("page") == F.col("page_id"), "left").select(
        F.col("l_orderkey").alias("GLOBALEVENTID"),
        F.col("url").alias("MentionIdentifier"),
        confidence.alias("Confidence"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("arrival"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity lists of the pages, as delimited strings with offsets and repeats.

    Every fourth page has a second row with other lists, every eighth one without themes.
    """
    key = F.col("page_id")

    def listed(names, step: int):
        first, second = (F.expr(pick(names, at)) for at in ("page_id", f"page_id * {step} + 1"))
        return F.concat(first, F.lit(",12; "), second, F.lit(",80;"), first, F.lit(",7; ;"))

    def rows(pages: DataFrame, themes: Column, steps: tuple[int, int]) -> DataFrame:
        return pages.select(
            F.col("url").alias("DocumentIdentifier"),
            themes.alias("Themes"),
            listed(PERSONS, steps[0]).alias("Persons"),
            listed(ORGANIZATIONS, steps[1]).alias("Organizations"),
        )

    pages = table(spark, sf_dir, "pages")
    again = pages.where(key % 4 == 0)
    return rows(pages, F.when(key % 10 != 0, listed(THEMES, 3)), (5, 2)).unionByName(
        rows(again, F.when(key % 8 != 0, listed(THEMES, 7)), (3, 4))
    )


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed manifest lines, one per page."""
    key = F.col("page_id")
    ending = F.element_at(
        F.array(*(F.lit(e) for e in (".export.CSV.zip", ".mentions.CSV.zip", ".gkg.csv.zip", ".txt"))),
        (key % 4 + 1).cast("int"),
    )
    return table(spark, sf_dir, "pages").select(
        key.alias("line"),
        F.concat(F.lit(" "), key, F.lit("  "), F.md5("url"), F.lit(" http://feed.example/"), key, ending).alias("value"),
    )


def lookup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country lookup lines with a heading, a blank line and lines without a name."""
    key = F.col("n_nationkey")
    line = (
        F.when(key == 0, "CODE\tLABEL")
        .when(key == 1, "")
        .when(key % 9 == 2, F.lower("n_name"))
        .otherwise(F.concat(F.lower("n_name"), F.lit("\t Land "), key, F.lit(" ")))
    )
    return table(spark, sf_dir, "nation").select(line.alias("value"))


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetched articles: whole HTML plus media links that the tables lack."""
    key = F.col("page_id")
    image, text_image = F.expr(pick(ARTICLE_IMAGES, "page_id")), F.expr(pick(ARTICLE_IMAGES, "page_id + 3"))
    content = F.when(key % 12 == 5, "Too short.").otherwise(
        F.concat(
            F.col("html"),
            F.lit(" ![pic]("), text_image, F.lit(") <IMG src='"), F.expr(pick(ARTICLE_IMAGES, "page_id + 4")),
            F.lit("'> see "), F.expr(pick(ARTICLE_LINKS, "page_id + 2")), F.lit(" "),
        )
    )
    alt = F.when(key % 3 == 0, "Main photo").when(key % 3 == 1, "Site logo").otherwise("")
    picture = F.struct(
        image.alias("url"),
        alt.alias("alt"),
        F.when(key % 2 == 0, (key % 7 * 100).cast("int")).alias("width"),
        F.when(key % 2 == 0, (key % 5 * 150).cast("int")).alias("height"),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        content.alias("content"),
        F.array(picture).alias("images"),
        F.array(F.expr(pick(ARTICLE_LINKS, "page_id"))).alias("links"),
    )


def briefing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written briefings: one per nation, some of them unusable, some missing."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(key % 4 != 3).select(
        F.col("n_name").alias("country_code"),
        F.concat(F.lit("On "), F.col("n_name"), F.lit(": "), F.expr(pick(POOR_PHRASES, "n_nationkey"))).alias("text"),
    )
