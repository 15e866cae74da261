"""URL rules: domains, image URLs and embeddable media."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# What an image or embed URL is recognised by.
EMBED_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "twitter.com", "x.com", "t.co")
IMAGE_HINTS = (
    "feature",
    "featured",
    "hero",
    "cover",
    "article",
    "story",
    "photo",
    "media",
    "main",
    "lead",
    "large",
    "high",
)
IMAGE_PATH_PARTS = ("/jpg/", "/jpeg/", "/png/", "/webp/", "/avif/")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".avif")
ASSET_PATH_STARTS = ("/icons/", "/logos/", "/static/", "/_assets/", "/assets/", "/images/icons/")
ASSET_TOKENS = (
    "logo",
    "icon",
    "sprite",
    "favicon",
    "avatar",
    "badge",
    "thumbnail",
    "thumb",
    "placeholder",
    "pixel",
    "tracking",
    "promo",
    "banner",
)
ASSET_HOSTS = ("gravatar.com", "doubleclick.net", "googlesyndication.com", "adsystem.com")
ASSET_ENDINGS = (".gif", ".svg")
SIZE_KEYS = ("w", "h", "width", "height", "size", "sz")

# Link patterns in article text.
MARKDOWN_IMAGE = r"!\[[^\]]*\]\((https?://[^)\s]+)\)"
HTML_IMAGE = r"(?i)<img[^>]+src=['\"](https?://[^'\">\s]+)"
PLAIN_URL = r"https?://[^\s)\]}>\"']+"


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(word) for word in words)


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(_any_of(words))


def _starts(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(f"^(?:{_any_of(words)})")


def _ends(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(f"(?:{_any_of(words)})$")


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def domain(url: Column) -> Column:
    """Host part of a URL: lower case, every scheme and 'www.' removed."""
    bare = F.lower(url)
    for part in ("https://", "http://", "www."):
        bare = F.replace(bare, F.lit(part), F.lit(""))
    return F.substring_index(bare, "/", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^(?i)https?://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?i)https?://[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i)https?://[^/?#]+"), F.lit(False))


def image_urls_in_text(text: Column) -> Column:
    """Image URLs of an article: markdown images first, then img tags."""
    return F.concat(
        F.regexp_extract_all(text, F.lit(MARKDOWN_IMAGE), 1),
        F.regexp_extract_all(text, F.lit(HTML_IMAGE), 1),
    )


def urls_in_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLAIN_URL), 0)


def _quote(text: Column) -> Column:
    """Percent-encode everything but letters, digits and '_.-~'."""
    encoded = F.url_encode(text)
    for form, percent in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(percent))
    return encoded


def embed_url(url: Column) -> Column:
    """Player URL of a video or post link, NULL for every other URL."""
    site = F.lower(host(url))
    where = path(url)

    video_key = F.regexp_extract(query_string(url), "(?:^|&)v=([^&]+)", 1)
    short_key = F.when(
        where.startswith("/shorts/"),
        F.substring_index(F.substring_index(where, "/shorts/", -1), "/", 1),
    ).otherwise("")
    watch_key = F.when(video_key != "", F.coalesce(F.try_url_decode(video_key), video_key)).otherwise(short_key)
    brief_key = F.regexp_extract(where, "^/*([^/]*)", 1)
    vimeo_key = F.regexp_extract(where, r"/(\d+)", 1)

    def player(prefix: str, key: Column) -> Column:
        return F.when(key != "", F.concat(F.lit(prefix), key))

    known = is_web_url(url) & site.rlike(rf"(?:^|\.)(?:{_any_of(EMBED_HOSTS)})$")
    youtube = F.when(where.startswith("/embed/"), url).otherwise(
        player("https://www.youtube.com/embed/", watch_key)
    )
    vimeo = F.when(
        site.contains("player.vimeo.com") & where.startswith("/video/"), url
    ).otherwise(player("https://player.vimeo.com/video/", vimeo_key))
    post = F.when(
        where.contains("/status/"),
        F.concat(F.lit("https://twitframe.com/show?url="), _quote(url)),
    )
    return F.when(
        known,
        F.when(site.contains("youtube.com"), youtube)
        .when(site.contains("youtu.be"), player("https://www.youtube.com/embed/", brief_key))
        .when(site.contains("vimeo.com"), vimeo)
        .when(site.contains("twitter.com") | site.contains("x.com"), post),
    )


def _query_sizes(url: Column) -> Column:
    """Whole numbers given for the size keys of a query string."""
    values = F.regexp_extract_all(
        query_string(url), F.lit(f"(?:^|&)(?:{'|'.join(SIZE_KEYS)})=([^&]*)"), 1
    )
    numbers = F.filter(values, lambda v: v.rlike(r"^[+-]?\d{1,18}$"))
    return F.transform(numbers, lambda v: v.try_cast("bigint"))


def image_score(url: Column, alt: Column, width: Column, height: Column) -> Column:
    """How likely an image URL is an article picture; higher is better."""
    full, where, site = F.lower(url), F.lower(path(url)), F.lower(host(url))
    caption = F.lower(F.coalesce(alt, F.lit("")))
    sizes = _query_sizes(url)
    sized = F.coalesce((width != 0) & (height != 0), F.lit(False))
    size_points = F.when(sized & (F.least(width, height) <= 80), -2).otherwise(
        _points(sized & (F.greatest(width, height) >= 400), 1)
    )
    terms = [
        _points(_has(where, IMAGE_HINTS), 2),
        _points(_has(where, IMAGE_PATH_PARTS), 1),
        _points(_ends(where, IMAGE_ENDINGS), 1),
        _points(full.contains("sortd-service/imaginary"), 2),
        _points(site.contains("cloudfront.net"), 1),
        _points((caption != "") & ~_has(caption, ASSET_TOKENS), 1),
        _points(_has(caption, IMAGE_HINTS), 1),
        _points(site.isin(*ASSET_HOSTS), -3),
        _points(_starts(where, ASSET_PATH_STARTS), -2),
        _points(_has(where, ASSET_TOKENS), -2),
        _points(_ends(full, ASSET_ENDINGS), -3),
        size_points,
        F.size(F.filter(sizes, lambda n: n <= 64)) * -3,
        F.size(F.filter(sizes, lambda n: n >= 400)),
    ]
    score = terms[0]
    for term in terms[1:]:
        score = score + term
    return score.cast("int")


def is_asset_image(url: Column) -> Column:
    """True for logos, icons, trackers and other page furniture."""
    full, where, site = F.lower(url), F.lower(path(url)), F.lower(host(url))
    return (
        site.isin(*ASSET_HOSTS)
        | _starts(where, ASSET_PATH_STARTS)
        | _has(where, ASSET_TOKENS)
        | _ends(full, ASSET_ENDINGS)
        | F.exists(_query_sizes(url), lambda n: n <= 64)
    )
