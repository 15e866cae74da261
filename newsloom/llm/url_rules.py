"""URL verdicts: rules by host and path, then block decisions handed on to addresses that redirect to each other.

Addresses are nodes; redirects (meta refresh, or a table of them) and canonical links are edges. Addresses of one
connected component are aliases. An address without a rule is blocked if an alias is and none is explicitly allowed.
Built-in DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.shared import components, lower_ascii

Rule = tuple[str, str]
# The rules the whole table of pages is judged by.
RULES: tuple[Rule, ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

COMMENT = r"(?s)<!--.*?-->"
#: A whole tag; a > inside a quoted value does not end it.
LINK_TAG, META_TAG = (rf"""(?i)<{{name}}\s(?:[^>"']|"[^"]*"|'[^']*')*>""".format(name=name) for name in ("link", "meta"))
CANONICAL = r"(?i)\srel\s*=\s*[\"']?canonical[\"'\s/>]"
REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s/>]"
HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)url\s*=\s*[\"']?([^\"'\s>;]+)"


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty for NULL and without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def resolved(path: Column) -> Column:
    """A path without `.` and `..` segments; an empty one is /."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    open_end = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    walked = F.aggregate(
        F.concat(F.filter(parts, lambda part: part != "."), open_end),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, part)),
    )
    return F.when(path == "", "/").otherwise(F.array_join(walked, "/"))


def address_of(url: Column) -> Column:
    """Host, path and query of a URL, one form for all that name the same: what scheme, default port, dot segments and fragment leave.

    Empty for NULL, without :// and without a host.
    """
    rest = after_scheme(url)
    port = F.when(lower_ascii(F.substring(url, 1, 8)).startswith("https://"), ":443$").otherwise(":80$")
    host = F.regexp_replace(host_of(rest), port, F.lit(""))
    query = F.regexp_extract(rest, r"^[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host == "", "").otherwise(F.concat(host, resolved(path_of(rest)), query))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, NULL if none does; of equally long ones the first by code point.

    `rules` are part of the program, so they stand in the expression and no table is joined.
    """
    found = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found.append(F.when(fits, F.struct(F.lit(-len(rule)).alias("order"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_min(F.array_compact(F.array(*found)))


def link_edges(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Edges (a, b) from each page's address to those its canonical links and its meta refreshes name.

    All such tags outside comments count. Targets may be absolute, start at the scheme, the root or the page's
    directory, or be a query alone. Pages without an address and NULL html give no edges.
    """
    url = F.col(url_column)
    plain = F.regexp_replace(html_column, COMMENT, "")

    def targets(tag: str, marked: str, value: str) -> Column:
        tags = F.filter(F.regexp_extract_all(plain, F.lit(tag), F.lit(0)), lambda found: F.rlike(found, F.lit(marked)))
        return F.transform(tags, lambda found: F.regexp_extract(found, value, 1))

    nothing = F.array().cast("array<string>")
    named = pages.select(
        address_of(url).alias("a"),
        F.substring_index(url, "://", 1).alias("scheme"),
        F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0).alias("host"),
        path_of(after_scheme(url)).alias("path"),
        F.explode(
            F.concat(
                F.when(F.col(html_column).ilike("%canonical%"), targets(LINK_TAG, CANONICAL, HREF)).otherwise(nothing),
                F.when(F.col(html_column).ilike("%refresh%"), targets(META_TAG, REFRESH, TARGET)).otherwise(nothing),
            )
        ).alias("to"),
    ).where((F.col("to") != "") & (F.col("a") != ""))
    to = F.replace("to", F.lit("&amp;"), F.lit("&"))
    root = F.concat("scheme", F.lit("://"), "host")
    directory = F.regexp_extract("path", r"^.*/", 0)
    full = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat("scheme", F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, to))
        .when(F.startswith(to, F.lit("?")), F.concat(root, "path", to))
        .otherwise(F.concat(root, F.when(directory == "", "/").otherwise(directory), to))
    )
    return named.select("a", address_of(full).alias("b")).where("b <> ''")


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, id_column: str = "page_id",
    url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """One row (id, host, path, rule, verdict) per row of `pages`.

    A rule that fits decides, allow or block. Without one an address is blocked if its component holds a blocked address and
    no explicitly allowed one, else allowed. `redirects` are further edges, two columns of URLs. NULL urls and those without
    :// have an empty host and path, no rule and are allowed. NULL html has no links. Columns beside the three are
    ignored; equal rows come out as often as they came in; an empty table gives no rows.
    """
    edges = link_edges(pages, url_column, html_column)
    if redirects is not None:
        a, b = (address_of(F.col(name)) for name in redirects.columns)
        edges = edges.union(redirects.select(a.alias("a"), b.alias("b")).where("a <> '' AND b <> ''"))
    aliases = components(edges)
    decided = aliases.withColumn("verdict", ruled(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    spoilt = (
        decided.groupBy("component")
        .agg(F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed"))
        .where(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)))
    )
    tainted = aliases.join(spoilt, "component").select("node", F.lit("block").alias("handed_on"))
    rest = after_scheme(F.col(url_column))
    judged = pages.select(
        F.col(id_column).alias("id"), host_of(rest).alias("host"), path_of(rest).alias("path"), address_of(F.col(url_column)).alias("node")
    ).withColumn("fits", ruled(F.col("host"), F.col("path"), rules))
    return judged.join(tainted, "node", "left").select(
        "id", "host", "path", "fits.rule", F.coalesce("fits.verdict", "handed_on", F.lit("allow")).alias("verdict")
    )
