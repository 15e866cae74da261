"""Tags, attributes, addresses and text of HTML as column expressions.

A page is read as browsers read it where that bears on its media: comments, scripts, styles and templates hold no tags,
attribute values may be quoted, bare or missing, the first of two equal attributes counts, names ignore case. Patterns
use possessive groups, so neither a long page nor a long tag needs a deep stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Character references that are decoded; others stay as written.
REFERENCES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&#160;", "\u00a0"), ("&amp;", "&"),
)

_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b.*?(?:</\1\s*>|\z)"
_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|)[^>=]*+)*+"""
_ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""
_ASIDE = r"(?is)<(head|nav|footer|aside|form|svg)\b.*?</\1\s*>"
_BLOCK = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|article|section|main|header|table|tr|td|th|blockquote|pre|figure|figcaption|body|html)(?=[\s/>])" + _ATTRIBUTES + ">?"
_TAG = "<[/!a-zA-Z]" + _ATTRIBUTES + ">?"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _with(value: Column, rule: Callable[[Column], Column]) -> Column:
    """`rule` of a value it names several times; the value is computed, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def visible(html: Column) -> Column:
    """The page without comments, scripts, styles and templates; what is left open ends with the page."""
    return F.regexp_replace(html, _HIDDEN, " ")


def decoded(text: Column) -> Column:
    for reference, character in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def tags(html: Column, *names: str) -> Column:
    """The start tags of the given names, in page order, without their closing bracket."""
    return F.regexp_extract_all(html, F.lit(f"(?i)<(?:{'|'.join(names)})(?=[\\s/>]){_ATTRIBUTES}"), F.lit(0))


def attributes(tag: Column) -> Column:
    """[(name, value)] of a tag in lower-cased names, the tag's own name first; an attribute without a value has an empty one."""

    def parted(entry: Column) -> Column:
        bare = F.regexp_replace(entry, r"""^[^\s=]+\s*=?\s*["']?|["']$""", "")
        return F.struct(F.lower(F.regexp_extract(entry, r"^[^\s=]+", 0)).alias("name"), decoded(bare).alias("value"))

    return F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), parted)


def value_of(attributes: Column, name: str) -> Column:
    """Value of the first attribute of that name, NULL without one."""
    return F.get(F.filter(attributes, lambda entry: entry["name"] == name), F.lit(0))["value"]


def pixels(value: Column) -> Column:
    """'640' and '640px' as a number; percentages and the like are NULL."""
    return F.regexp_extract(value, r"^\s*(\d{1,9})(?:px)?\s*$", 1).try_cast("int")


def largest(srcset: Column) -> Column:
    """(size, at, url, width) of the largest picture of a srcset, the first of equals; NULL without one."""

    def candidate(entry: Column, at: Column) -> Column:
        size = F.regexp_extract(entry, r"\s([0-9.]+)[wx]", 1).try_cast("double")
        return F.struct(
            F.coalesce(size, F.lit(1.0)).alias("size"),
            (-at).alias("at"),
            F.regexp_replace(F.regexp_extract(entry, r"^\S+", 0), ",+$", "").alias("url"),
            F.regexp_extract(entry, r"\s(\d{1,9})w", 1).try_cast("int").alias("width"),
        )

    entries = F.regexp_extract_all(srcset, F.lit(r"[^\s,]\S*(?:\s+[0-9.]+[wxh])*"), F.lit(0))
    return F.array_max(F.transform(entries, candidate))


def address_parts(base: Column) -> Column:
    """(address, scheme, origin, path) of an address; what `resolved` needs of the page it stands on."""

    def parts(whole: Column) -> Column:
        return F.struct(
            whole.alias("address"),
            F.regexp_extract(whole, _SCHEME, 0).alias("scheme"),
            F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", 0).alias("origin"),
            F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1).alias("path"),
        )

    return _with(F.coalesce(F.regexp_replace(base, "#.*$", ""), F.lit("")), parts)


def resolved(link: Column, base: Column) -> Column:
    """The address a link on a page leads to, `base` being the page's `address_parts`; dot segments are followed.

    A link with a scheme is taken as it is. Without a base a relative link stays as written.
    """

    def joined(link: Column) -> Column:
        folder = F.regexp_replace(F.concat(base["path"], F.when((base["path"] == "") & (base["origin"] != ""), "/").otherwise("")), "[^/]*$", "")
        return (
            F.when(link.rlike(_SCHEME), link)
            .when(link.startswith("//"), F.concat(base["scheme"], link))
            .when(link.startswith("/"), F.concat(base["origin"], link))
            .when(link.startswith("?"), F.concat(base["origin"], base["path"], link))
            .when((link == "") | link.startswith("#"), F.concat(base["address"], link))
            .otherwise(F.concat(base["origin"], folder, link))
        )

    def clean(whole: Column) -> Column:
        dotted = whole.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/\.\.?(?:[/?#]|$)")
        return F.when(dotted, _without_dots(whole)).otherwise(whole)

    return _with(_with(F.regexp_replace(F.trim(link), r"[\t\r\n]", ""), joined), clean)


def _without_dots(address: Column) -> Column:
    origin = F.regexp_extract(address, r"^[^:]*://[^/?#]*", 0)
    path = F.regexp_extract(address, r"^[^:]*://[^/?#]*/([^?#]*)", 1)
    rest = F.regexp_extract(address, r"[?#].*$", 0)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    ends_open = path.rlike(r"(?:^|/)\.\.?$") & (F.size(parts) > 0)
    return F.concat(origin, F.lit("/"), F.array_join(parts, "/"), F.when(ends_open, "/").otherwise(""), rest)


def readable(html: Column) -> Column:
    """Text of a page from `visible`: blocks on lines of their own, without head, menus, footers, asides and forms."""
    text = F.regexp_replace(html, _ASIDE, "\n")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t\r\n\f]+", " "), _BLOCK, "\n")
    text = F.regexp_replace(decoded(F.regexp_replace(text, _TAG, "")), "[ \u00a0]+", " ")
    return F.btrim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))
