"""Model names and speed modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger.fixed_values import (
    BRACKET_SUFFIX,
    DATE_SUFFIX,
    NORMAL_COLLABORATION_MODES,
    UNKNOWN_MODEL,
    VARIANT_SUFFIXES,
)

# Every space Unicode knows, with the ASCII separators \x1c-\x1f.
SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_VARIANTS = r"(?i:-(?:" + "|".join(VARIANT_SUFFIXES) + r"))*"
# Everything that goes, in one pass: space in front, and at the end variant suffixes, then one date
# suffix, then one bracket suffix, then space. The look-ahead lets letters and digits pass at once.
_COSMETIC = (
    rf"(?=[-@\[]|[^!-~])(?:^[{SPACES}]+|"
    rf"{_VARIANTS}(?:{DATE_SUFFIX[:-1]})?(?:{BRACKET_SUFFIX[:-1]})?[{SPACES}]*$)"
)
# A dot between digits, in names that start with "claude-": each match goes on where the last one ended.
_DOTTED = r"((?:^claude-|\G(?!^)).*?\d)\.(?=\d)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def model_key(raw: Column) -> Column:
    """Stable key of a model name: cosmetic suffixes off, dotted minor versions dashed.

    One bracket suffix and one date suffix go, then any run of variant suffixes. Names come with every
    single fact, so rules that cannot apply are skipped, and none runs twice.
    """
    name = F.regexp_replace(raw, _COSMETIC, "")
    dashed = F.when(raw.contains("claude-"), F.regexp_replace(name, _DOTTED, "$1-")).otherwise(name)
    # What starts with a letter or digit cannot end up empty.
    first = F.ascii(raw)
    solid = first.between(48, 57) | first.between(65, 90) | first.between(97, 122)
    key = F.when(solid, dashed).otherwise(F.regexp_replace(dashed, "^$", UNKNOWN_MODEL))
    return F.coalesce(key, F.lit(UNKNOWN_MODEL))


def session_mode(speed: Column) -> Column:
    """Mode of a session event from its speed text (null or empty when the log has none)."""
    return (
        F.when(speed.isNull() | (speed == ""), "unknown")
        .when(F.lower(speed).contains("fast"), "fast")
        .otherwise("normal")
    )


def rollout_mode(model: Column, collaboration_mode: Column) -> Column:
    """Mode of a rollout: a fast model wins, an unrecognised collaboration mode stays unknown."""
    kind = F.lower(strip(collaboration_mode))
    return (
        F.when(model.rlike(r"(?i)-fast\b"), "fast")
        .when(kind.contains("fast"), "fast")
        .when(kind.isin(*NORMAL_COLLABORATION_MODES), "normal")
        .otherwise("unknown")
    )
