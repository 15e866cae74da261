"""Article text, pictures and embeds of a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import markup
from newsloom.functions.text import MAX_ARTICLE_CHARS, article_text, strip
from newsloom.functions.urls import embed_url, image_score, image_urls_in_text, is_web_url, urls_in_text

MAX_IMAGES = 10
MAX_EMBEDS = 5
MIN_IMAGE_SCORE = 1
ANY_IMAGE_SCORE = -100

# (url, alt, width, height) of the pictures a page names by itself.
IMAGE_TYPE = "array<struct<url:string,alt:string,width:int,height:int>>"

# The tags that carry media, and the meta names of a page's own picture and video.
MEDIA_TAGS = ("img", "source", "iframe", "video", "a", "meta")
META_IMAGES = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src")
META_VIDEOS = ("og:video", "og:video:url", "og:video:secure_url")


def _media_of(tag: Column) -> Column:
    """Up to three (kind, tag, url, alt, width, height) of one tag's fields; those it lacks have no url."""
    name = tag["tag"]

    def medium(kind: str, url: Column, width: Column | None = None, height: Column | None = None) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(
            F.lit(kind).alias("kind"),
            name.alias("tag"),
            url.alias("url"),
            F.coalesce(tag["alt"], F.lit("")).alias("alt"),
            (none if width is None else width).alias("width"),
            (none if height is None else height).alias("height"),
        )

    # Pages that load pictures late keep the address apart and a placeholder in its place.
    waits = tag["src"].isNull() | (tag["src"] == "") | F.lower(tag["src"]).startswith("data:")
    source = F.when(waits, tag["later"]).otherwise(tag["src"])
    meta = F.lower(tag["about"])
    picture = F.when(name == "img", source).when((name == "meta") & meta.isin(*META_IMAGES), tag["content"])
    embed = (
        F.when(name.isin("iframe", "video"), source)
        .when((name == "source") & tag["largest"].isNull(), tag["src"])
        .when((name == "meta") & meta.isin(*META_VIDEOS), tag["content"])
    )
    return F.array(
        medium("image", picture, tag["width"], tag["height"]),
        medium("image", F.when(name.isin("img", "source"), tag["largest"]["url"]), tag["largest"]["width"]),
        medium("embed", embed),
        medium("link", F.when(name == "a", tag["href"])),
    )


def _with_media(pages: DataFrame) -> DataFrame:
    """Adds `bare`, the page without hidden parts, and `media`, its pictures, embeds and links in page order."""

    def fields(tag: Column) -> Column:
        values = {name: markup.value_of(tag, name) for name in ("src", "alt", "href", "content")}
        sizes = {name: markup.pixels(markup.value_of(tag, name)) for name in ("width", "height")}
        srcset = F.coalesce(markup.value_of(tag, "srcset"), markup.value_of(tag, "data-srcset"))
        later = F.coalesce(markup.value_of(tag, "data-src"), markup.value_of(tag, "data-original"))
        about = F.coalesce(markup.value_of(tag, "property"), markup.value_of(tag, "name"))
        named = {**values, **sizes, "largest": markup.largest(srcset), "later": later, "about": about}
        return F.struct(tag[0]["name"].alias("tag"), *(value.alias(name) for name, value in named.items()))

    def at_home(medium: Column) -> Column:
        return medium.withField("url", markup.resolved(medium["url"], F.col("base")))

    rows = pages.withColumn("bare", F.coalesce(markup.visible(F.col("html")), F.lit("")))
    # A page may name another address that its links start from.
    own = markup.value_of(markup.attributes(F.get(markup.tags(F.col("bare"), "base"), F.lit(0))), "href")
    rows = rows.withColumn("base", markup.address_parts(F.col("url")))
    rows = rows.withColumn("base", markup.address_parts(F.coalesce(markup.resolved(own, F.col("base")), "url")))
    rows = rows.withColumn("media", F.transform(markup.tags(F.col("bare"), *MEDIA_TAGS), markup.attributes))
    rows = rows.withColumn("media", F.transform("media", fields))
    rows = rows.withColumn("media", F.filter(F.flatten(F.transform("media", _media_of)), lambda m: m["url"].isNotNull()))
    return rows.withColumn("media", F.transform("media", at_home)).drop("base")


def page_media(pages: DataFrame) -> DataFrame:
    """Rows (page_id, at, kind, tag, url, alt, width, height) of pages(page_id, url, html): all media the HTML itself names.

    kind is `image` (img, the largest of a srcset, the page's meta picture), `embed` (iframe, video, meta video) or
    `link` (a). Addresses are absolute, seen from the page or from its `base` tag; without either they stay as written.
    `at` counts from 0 in page order. NULL and empty pages give no rows; repeated rows are read one by one.
    """
    found = _with_media(pages.select("page_id", "url", "html"))
    # Of the plain form Spark infers a filter on the list's length, which reads every page a second time.
    rows = found.select("page_id", F.posexplode_outer("media").alias("at", "m")).where("at IS NOT NULL")
    return rows.select("page_id", "at", "m.*")


def read_pages(pages: DataFrame) -> DataFrame:
    """Raw pages(page_id, url, html) as `extract_articles` takes them: (page_id, title, content, images, links).

    The title is the page's, the content its readable text, images and links come from its tags. A page stays one row,
    also one without text, and nothing is shuffled.
    """
    rows = _with_media(pages.select("page_id", "url", "html"))
    title = F.regexp_extract("bare", r"(?is)<title[^>]*>(.*?)(?:</title|\z)", 1)
    images = F.filter("media", lambda m: m["kind"] == "image")
    links = F.filter("media", lambda m: m["kind"] != "image")
    return rows.select(
        "page_id",
        F.btrim(F.regexp_replace(markup.decoded(title), r"\s+", " ")).alias("title"),
        markup.readable(F.col("bare")).alias("content"),
        F.transform(images, lambda m: F.struct(m["url"], m["alt"], m["width"], m["height"])).cast(IMAGE_TYPE).alias("images"),
        links["url"].alias("links"),
    )


def extract_articles(
    pages: DataFrame,
    most_images: int | None = MAX_IMAGES,
    most_embeds: int | None = MAX_EMBEDS,
    most_chars: int | None = MAX_ARTICLE_CHARS,
) -> DataFrame:
    """Articles of pages(page_id, title, content, images, links).

    `images` is an array of (url, alt, width, height), `links` an array of URLs; both may
    be NULL. Pages with too little text are dropped. Everything belongs to one page and
    stays in its row, so nothing is shuffled. An article shows at most `most_images` pictures and
    takes the first `most_embeds` players, before repeats go; text beyond `most_chars` is cut. None sets no limit.
    """

    def first(items: Column, most: int | None) -> Column:
        return items if most is None else F.slice(items, 1, most)

    body = strip(F.col("content"))
    rows = pages.select(
        "page_id",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"),
        article_text(F.col("content"), most_chars).alias("text"),
        body.alias("body"),
        F.coalesce(F.col("images").cast(IMAGE_TYPE), F.array().cast(IMAGE_TYPE)).alias("images"),
        F.coalesce(F.col("links"), F.array().cast("array<string>")).alias("links"),
    ).where(F.col("text").isNotNull())

    named = F.filter("images", lambda image: image["url"] != "")
    in_text = F.transform(
        image_urls_in_text(F.col("body")),
        lambda url: F.struct(
            url.alias("url"),
            F.lit("").alias("alt"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
        ),
    )
    scored = F.transform(
        F.concat(named, in_text.cast(IMAGE_TYPE)),
        lambda image, at: F.struct(
            (-image_score(image["url"], image["alt"], image["width"], image["height"])).alias("penalty"),
            at.alias("at"),
            image["url"].alias("url"),
        ),
    )
    rows = rows.withColumn(
        "ranked", F.array_sort(F.filter(scored, lambda image: is_web_url(image["url"])))
    )

    def best(min_score: int):
        fit = F.filter("ranked", lambda image: image["penalty"] <= -min_score)
        return first(F.array_distinct(fit["url"]), most_images)

    wanted = best(MIN_IMAGE_SCORE)
    embeds = F.filter(
        F.transform(F.concat("links", urls_in_text(F.col("body"))), embed_url),
        lambda url: url.isNotNull(),
    )
    return rows.select(
        "page_id",
        "title",
        "text",
        F.when(F.size(wanted) > 0, wanted).otherwise(best(ANY_IMAGE_SCORE)).alias("images"),
        F.array_distinct(first(embeds, most_embeds)).alias("embeds"),
    )


def page_images(pages: DataFrame) -> DataFrame:
    """Every picture of every page with its score: (page_id, at, url, score)."""
    images = pages.select("page_id", F.posexplode("images").alias("at", "image"))
    scored = images.select("page_id", "at", "image.*").where(is_web_url(F.col("url")))
    score = image_score(F.col("url"), F.col("alt"), F.col("width"), F.col("height"))
    return scored.select("page_id", "at", "url", score.alias("score"))
