"""Display labels and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.schema import ACTOR_TYPE_LABELS, QUAD_CLASS_LABELS, ROOT_CODE_LABELS

# Theme prefixes, removed in this order.
THEME_PREFIXES = (
    r"WB_\d+_",
    r"CRISISLEX_C\d+_",
    r"CRISISLEX_",
    r"FNCACT_",
    r"EPU_POLICY_",
    r"EPU_",
    r"SOC_",
    r"ENV_",
    r"ECON_",
    r"MED_",
    r"TAX_FNCACT_",
    r"TAX_",
    r"USPEC_",
    r"UNGP_",
)


def _label(code: Column, labels: dict) -> Column:
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.create_map(*pairs)[code]


def quad_class_label(code: Column) -> Column:
    return _label(code, QUAD_CLASS_LABELS)


def root_code_label(code: Column) -> Column:
    return _label(code, ROOT_CODE_LABELS)


def actor_type_label(code: Column) -> Column:
    return _label(code, ACTOR_TYPE_LABELS)


def clean_theme(theme: Column) -> Column:
    """Readable theme name: known prefixes off, underscores to spaces, words capitalised."""
    for prefix in THEME_PREFIXES:
        theme = F.regexp_replace(theme, f"^(?i){prefix}", "")
    words = F.split(F.lower(F.replace(theme, F.lit("_"), F.lit(" "))), "(?<![a-z0-9])(?=[a-z0-9])")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""
    )


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))


def tone_text(tone: Column) -> Column:
    return F.when(tone.isNull(), "N/A").otherwise(_fixed(tone, 2))


def ratio_text(ratio: Column) -> Column:
    return F.concat(_fixed(ratio * 100, 1), F.lit("%"))


def share_text(part: Column, whole: Column) -> Column:
    """Percent of a whole with one digit, '0.0' when the whole is empty."""
    return F.when(whole > 0, _fixed(part.cast("double") / whole * 100, 1)).otherwise("0.0")


def count_text(count: Column, thousand_digits: int = 1) -> Column:
    """1234567 -> 1.2M, 1234 -> 1.2K; axis labels use no digit for thousands."""
    return (
        F.when(count >= 1_000_000, F.concat(_fixed(count / 1e6, 1), F.lit("M")))
        .when(count >= 1_000, F.concat(_fixed(count / 1e3, thousand_digits), F.lit("K")))
        .otherwise(count.cast("string"))
    )
