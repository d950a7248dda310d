"""URL filter: a weighted vocabulary matched by an Aho-Corasick automaton, beside allow and block rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import UPPER, lower_ascii, unused

STRICT, SOFT = 1.0, 0.4
#: Terms of the vocabulary. One strict term rejects a url; a soft one only with others.
STRICT_TERMS = ("porn", "xxx", "viagra", "casino", "cheap-pills", "free-money", "adult-video", "escort-service", "betting-tips", "crack-download")
SOFT_TERMS = ("cheap", "pills", "free", "money", "adult", "sex", "nude", "bet", "poker", "loan", "warez", "crack", "keygen", "torrent", "replica", "discount")
VOCABULARY: dict[str, float] = {**dict.fromkeys(STRICT_TERMS, STRICT), **dict.fromkeys(SOFT_TERMS, SOFT)}
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton(vocabulary: Mapping[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms in a lower-cased url. A hit counts only where no ASCII letter or digit touches it."""
    strict: set[str] = set()
    soft: set[str] = set()
    for end, (term, weight) in terms.iter(url):
        start = end - len(term) + 1
        if (start and url[start - 1] in ALNUM) or (end + 1 < len(url) and url[end + 1] in ALNUM):
            continue
        (strict if weight >= STRICT else soft).add(term)
    return strict, soft


def url_hits(url: Column, vocabulary: Mapping[str, float] = VOCABULARY) -> Column:
    """Struct of n_strict and n_soft: how many distinct terms occur in the url; a null url has none. The vocabulary is a parameter and travels in the closure."""
    own = dict(vocabulary)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms, table = automaton(own) if own else None, str.maketrans(UPPER, UPPER.lower())
        for urls in batches:
            found = [hits(u.translate(table), terms) if u and terms else ((), ()) for u in urls]
            yield pd.DataFrame({"n_strict": [len(a) for a, _ in found], "n_soft": [len(b) for _, b in found]}, dtype="int32")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(count, "n_strict int, n_soft int")(url)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, or null. A rule (host, path, verdict) fits its host and all subdomains where the path starts with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, url: str = "url", rules: Iterable[tuple[str, str, str]] = (), vocabulary: Mapping[str, float] = VOCABULARY, least_soft: int = 2) -> DataFrame:
    """``pages`` with host, path, rule, n_strict, n_soft and verdict.

    The longest fitting rule decides; where none fits, a url is blocked on one strict term or on ``least_soft`` distinct soft ones.
    Null, empty and schemeless urls have an empty host and path and no rule; a null one has no hits and is allowed. Repeated rows are
    judged alike, each row stays, an empty table gives an empty one, and input columns of the same names are replaced. One pass, no shuffle.
    """
    names = ("host", "path", "rule", "n_strict", "n_soft", "verdict")
    u = F.col(f"`{url}`")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    found, rule = F.col(hit := unused("hits", pages)), F.col(fits := unused("fitting", pages))
    out = pages.select(*kept, host_of(u).alias("host"), path_of(u).alias("path"), url_hits(u, vocabulary).alias(hit))
    judged = F.when((found["n_strict"] > 0) | (found["n_soft"] >= least_soft), F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumn(fits, rule_for(F.col("host"), F.col("path"), list(rules)))
    return out.select(*kept, "host", "path", rule["rule"].alias("rule"), found["n_strict"].alias("n_strict"), found["n_soft"].alias("n_soft"), F.coalesce(rule["verdict"], judged).alias("verdict"))
