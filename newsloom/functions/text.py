"""Text rules: entity lists, event text, article text and briefing checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIN_ARTICLE_CHARS = 100
MAX_ARTICLE_CHARS = 8000

# Phrases that mark a generated briefing as unusable.
POOR_BRIEFING_PATTERNS = (
    r"unable to (determine|verify)",
    r"not a recognized country code",
    r"could refer to",
    r"assuming (it )?refers to",
    r"without more context",
    r"appears to be (a code|coded|nonsensical|cryptic)",
)

_BLANKS = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def entity_list(value: Column, distinct: bool = False) -> Column:
    """'ECONOMY,0.8;POLITICS,0.6;' -> [ECONOMY, POLITICS]; NULL -> [].

    `distinct` also drops repeats and sorts, so that the result does not depend on
    the order of the source list.
    """
    items = F.filter(F.transform(F.split(value, ";"), strip), lambda item: item != "")
    names = F.coalesce(
        F.transform(items, lambda item: F.substring_index(item, ",", 1)), F.array().cast("array<string>")
    )
    return F.array_sort(F.array_distinct(names)) if distinct else names


def goldstein_bucket(goldstein: Column) -> Column:
    return (
        F.when(goldstein < -5, "tone_highly_negative")
        .when(goldstein < 0, "tone_negative")
        .when(goldstein > 5, "tone_highly_positive")
        .when(goldstein > 0, "tone_positive")
        .when(goldstein == 0, "tone_neutral")
    )


def event_text(actor1: Column, actor2: Column, root_code: Column, goldstein: Column) -> Column:
    """Words that describe an event for clustering."""

    def word(prefix: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(prefix), value))

    words = F.lower(
        F.concat_ws(
            " ",
            word("actor_", actor1),
            word("actor_", actor2),
            word("event_", root_code),
            goldstein_bucket(goldstein),
        )
    )
    return F.when(words == "", "unknown_features").otherwise(words)


def is_poor_briefing(text: Column) -> Column:
    return F.lower(text).rlike("|".join(POOR_BRIEFING_PATTERNS))


def article_text(content: Column, most_chars: int | None = MAX_ARTICLE_CHARS) -> Column:
    """Article body: NULL when too short, cut with an ellipsis when longer than `most_chars` (None: never)."""
    body = strip(content)
    whole = F.when(F.length(body) >= MIN_ARTICLE_CHARS, body)
    if most_chars is None:
        return whole
    cut = F.concat(F.substring(body, 1, most_chars), F.lit("..."))
    return F.when((F.length(body) >= MIN_ARTICLE_CHARS) & (F.length(body) > most_chars), cut).otherwise(whole)
