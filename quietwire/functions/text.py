"""Text columns: log lines, alert descriptions, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quietwire import config as C

# Characters shown as '?': controls, formats, unassigned, and separators other than the space.
NOT_PRINTABLE = (
    r"[\p{C}\p{Zl}\p{Zp}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
)


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture group; null where the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def printable_only(text: Column, n: int | None = None) -> Column:
    """The text, or its first ``n`` characters, with '?' for what cannot be printed."""
    return F.regexp_replace(text if n is None else F.substring(text, 1, n), NOT_PRINTABLE, "?")


def redact(text: Column, n: int | None = None) -> Column:
    """Blank out secrets and replace what cannot be printed; with ``n``, cut longer text first."""
    cut = text
    if n is not None:
        cut = F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
    blanked = reduce(
        lambda acc, word: F.regexp_replace(acc, rf"(?iU){word}[=:]\s*\S+", "[REDACTED]"),
        C.SENSITIVE_WORDS,
        cut,
    )
    return F.regexp_replace(blanked, NOT_PRINTABLE, "?")


def target_port(description: Column) -> Column:
    return group_or_null(description, r"(?i)port\s+(\d+)").try_cast("int")


def features_json(names: tuple[str, ...] = C.FEATURE_NAMES) -> Column:
    return F.to_json(F.struct(F.array(*[F.col(n) for n in names]).alias("features")))


def features_from_json(raw: Column) -> Column:
    return F.from_json(raw, "features array<double>").getField("features")
