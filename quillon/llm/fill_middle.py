"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries and dealt out in another order between sentinels.

One automaton scans a text for its events: the ASCII characters that change the class from word to space, and the sentinels. A gap between
two spaces is a word, so the events alone give the number of units and where each ends; no unit is ever built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import unused, with_text_columns

#: White space, and the marks before prefix, suffix and middle.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SENTINELS = ("<P>", "<S>", "<M>")
SPACE, MARK = 0, 1
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def event_automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in SPACES:
        out.add_word(c, SPACE)
    for s in SENTINELS:
        out.add_word(s, MARK)
    out.make_automaton()
    return out


def unit_ends(text: str, events: ahocorasick.Automaton) -> tuple[np.ndarray, bool]:
    """Where each unit ends, in code points, and whether a sentinel occurs. A unit is a word with the white space before it, or the white space at the end."""
    found = np.array(list(events.iter(text)), np.int64).reshape(-1, 2)
    spaces = found[found[:, 1] == SPACE, 0]
    edges = np.append(spaces, len(text))
    before = np.append(-1, spaces)
    ends = edges[edges - before > 1]  # a gap of word characters ends at this edge
    if len(spaces) and spaces[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(spaces) < len(found)


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on the seed and the document's id alone."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def middle_out(text: str, key: str, events: ahocorasick.Automaton, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, characters of the middle, output) of one text."""
    ends, marked = unit_ends(text, events)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    at = lambda rank: int(ends[rank - 1]) if rank else 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = at(a), at(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of ``docs`` (all by default) with n, form, prefix_chars, middle_chars and output.

    ``rate`` of a hundred texts are transformed, ``spm_rate`` of a hundred of these with the suffix first. The choice depends on seed and id
    alone: rows that repeat an id and text come out alike, each row stays. A null text is empty; an empty text, and one that holds a
    sentinel, stays plain; a null id draws as an empty one. Texts of any length are scanned whole. An empty table gives an empty one; kept
    columns of the new names are replaced. One pass, no shuffle.
    """
    key = unused("fim_key", docs)
    body = unused("fim_pair", docs)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.split()[0] for f in FIELDS.split(", ")}]
    #: id and text travel as one string, parted by the first character that no number holds.
    rows = docs.withColumn(key, F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).withColumn(body, F.concat(F.length(key).cast("string"), F.lit(":"), F.col(key), F.coalesce(F.col(f"`{text}`"), F.lit(""))))

    def make() -> Callable[[list[str]], list]:
        events = event_automaton()

        def compute(pairs: list[str]) -> list:
            out = []
            for pair in pairs:
                size, _, rest = pair.partition(":")
                out.append(middle_out(rest[int(size) :], rest[: int(size)], events, seed, rate, spm_rate))
            columns = list(zip(*out, strict=True)) or [()] * 5
            return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]

        return compute

    return with_text_columns(rows, make, FIELDS, body, keep=kept)


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from output and form. Each sentinel of a transformed text occurs once: its parts hold none, and none can arise where they meet."""
    parts = F.split(output, "|".join(SENTINELS), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
