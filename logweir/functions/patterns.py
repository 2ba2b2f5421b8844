"""Checks of regular expressions before they reach a task."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from logweir.errors import ValidationError


def checked_pattern(spark: SparkSession, pattern: str) -> str:
    """Return ``pattern``, or raise if Spark's regex engine rejects it.

    The match is on two literals over a one-row relation, so it is folded on the
    driver: a bad pattern fails here and not in the tasks of a long scan.
    """
    try:
        spark.sql("SELECT 'x' RLIKE :pattern", args={"pattern": pattern}).collect()
    except PySparkException as error:
        raise ValidationError(f"invalid regular expression: {pattern!r}") from error
    return pattern


# Escapes that stand for no text of their own.
TEXTLESS = "dDwWsSbBAzZ"


def _after_class(pattern: str, at: int) -> int | None:
    """The place behind a character class that begins at ``at``; ``None`` if it is nested."""
    at += 2 if pattern.startswith("[^", at) else 1
    first = at
    while at < len(pattern):
        if pattern[at] == "\\":
            if pattern[at + 1 : at + 2] == "Q":
                return None
            at += 2
            continue
        if pattern[at] == "[" or pattern.startswith("&&", at) or (pattern[at] == "]" and at == first):
            return None
        if pattern[at] == "]":
            return at + 1
        at += 1
    return None


def _after_group(pattern: str, at: int) -> int | None:
    """The place behind a group that begins at ``at``; ``None`` if it sets flags."""
    depth = 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            if pattern[at + 1 : at + 2] == "Q":
                return None
            at += 2
        elif char == "[":
            behind = _after_class(pattern, at)
            if behind is None:
                return None
            at = behind
        else:
            if char == "(":
                if pattern.startswith("(?", at) and pattern[at + 2 : at + 3] not in (*":=!<>",):
                    return None
                depth += 1
            elif char == ")":
                depth -= 1
            at += 1
            if not depth:
                return at
    return None


def required_texts(pattern: str) -> list[list[str]] | None:
    """Texts a match of ``pattern`` contains: all those of one of the lists.

    One list per top-level alternative. Of groups, classes and repeated characters nothing is
    taken. ``None`` where that cannot be told: flags, nested classes, quotes, references.
    """
    branches: list[list[str]] = [[]]
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            branches[-1].append(run)
        run = ""

    at = 0
    while at < len(pattern):
        char = pattern[at]
        behind: int | None = at + 1
        if char == "\\":
            escaped = pattern[at + 1 : at + 2]
            behind = at + 2
            if escaped in TEXTLESS and escaped:
                close()
            elif not escaped or (escaped.isascii() and escaped.isalnum()):
                return None
            else:
                run += escaped
        elif char in "?*{":
            # The character before it may be missing.
            run = run[:-1]
            close()
            if char == "{":
                behind = pattern.find("}", at) + 1 or None
        elif char in "+.^$":
            close()
        elif char in "([":
            close()
            behind = (_after_group if char == "(" else _after_class)(pattern, at)
        elif char == "|":
            close()
            branches.append([])
        else:
            run += char
        if behind is None:
            return None
        at = behind
    close()
    return branches
