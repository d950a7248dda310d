"""Text expressions that encoders and experiments ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prompted(text: Column | str, prompt: str = "") -> Column:
    """The text behind a prompt; a null text is empty."""
    return F.concat(F.lit(prompt), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def no_url(text: Column | str) -> Column:
    """A space before a text that begins with http, so that an encoder does not take it for an address."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.startswith("http"), F.concat(F.lit(" "), t)).otherwise(t)


def slug(name: Column | str) -> Column:
    """Lower case; runs of all but a-z and 0-9 become one hyphen, none at the ends."""
    t = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-|-$", "")


def numbers_sha256(numbers: Column | str) -> Column:
    """SHA-256 of an array's numbers in decimal, joined by commas."""
    n = F.col(numbers) if isinstance(numbers, str) else numbers
    return F.sha2(F.array_join(n.cast("array<string>"), ","), 256)
