"""Secret scan: base patterns, and weak credential parts that count only where complementary parts lie in one scope. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import unused

#: Kind -> (pattern, group whose length is tested, its least length). All groups but group 1 of a pattern with a tested group 2 are non-capturing.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak parts: nothing by themselves. ident: identifiers of accounts; key: long runs of mixed letters and digits; endpoint: where they are used.
WEAK = {
    "ident": (r"""\b(?:A[SR]IA[A-Z0-9]{12,}|AKIA[A-Z0-9]{8,15}\b|(?i:client_id|user(?:name)?|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._-]{3,})""", 0, 1),
    "key": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+", 0, 20),
    "endpoint": (r"\b(?:https?|ftp|jdbc:[a-z]{1,16}|postgres(?:ql)?|mysql|redis|amqp)://[A-Za-z0-9._:@/-]{3,}", 0, 8),
}
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "key": "secret", "endpoint": "endpoint"}
#: The roles that make a weak part count when one of them is in its scope.
COMPLEMENTS = {"ident": ("secret",), "key": ("ident",), "endpoint": ("ident", "secret")}
SCOPE = 160
#: More than any position in a text.
FAR = 1 << 40
MARK, STAND_IN = "\x01", "\x02"


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches of the pattern: even entries lie between matches, odd ones are matches; null without a match."""
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1))


def found_spans(docs: DataFrame, key: str = "_key", text: str = "_text") -> DataFrame:
    """Rows (key, kind, start, end) of all matches long enough, leftmost and non-overlapping per kind; code points, end exclusive."""
    t = F.translate(F.col(text), MARK, STAND_IN)  # no pattern holds either of the two, and both are one code point
    parts = [F.struct(F.lit(kind).alias("kind"), pieces(t, spec[0]).alias("cut")) for kind, spec in (BASE | WEAK).items()]
    rows = docs.select(key, F.explode(F.filter(F.array(*parts), lambda p: p["cut"].isNotNull())).alias("p")).select(key, "p.kind", F.posexplode("p.cut").alias("i", "cut"))
    size = F.length("cut")
    tested = F.lit(True)
    for kind, (pattern, group, least) in (BASE | WEAK).items():
        tested = F.when(F.col("kind") == kind, F.length(F.regexp_extract("cut", pattern, group)) >= least).otherwise(tested)
    order = W.partitionBy(key, "kind").orderBy("i")
    rows = rows.withColumn("again", F.coalesce(F.lag("i").over(order) == F.col("i"), F.lit(False)))  # of a repeated row
    before = F.coalesce(F.sum(F.when(F.col("again"), 0).otherwise(size)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before).withColumn("end", F.col("start") + size).where((F.col("i") % 2 == 1) & tested & ~F.col("again"))
    return rows.select(key, "kind", F.col("start").cast("long"), F.col("end").cast("long"))


def role_of(kind: Column) -> Column:
    out = F.lit("secret")
    for k, role in ROLE.items():
        out = F.when(kind == k, F.lit(role)).otherwise(out)
    return out


def with_linked(spans: DataFrame, key: str = "_key", scope: int = SCOPE) -> DataFrame:
    """The base spans, and the weak spans that overlap no base span and have a complementary part at most ``scope`` code points from edge to edge.

    One sort of each text's edges, without a join: a span asks at its edges, and answers at its own for the others. Three sweeps lie ``FAR``
    apart on one line: what overlaps (0), what begins behind a span's end (1), what ends before its start (2). The frames of the last two
    hold few parts because parts of a kind do not overlap; spans of any length are met.
    """
    base = F.col("kind").isin(*BASE)
    edge = lambda sweep, at, asks: F.struct((F.lit(sweep * FAR) + at).alias("point"), F.lit(sweep).alias("sweep"), F.lit(asks).alias("asks"))
    first, last = F.col("start"), F.col("end")
    of_base = F.array(edge(0, last - 1, True), edge(0, first, False), edge(1, first, False), edge(2, last, False))
    of_weak = F.array(edge(0, last - 1, True), edge(1, last, True), edge(1, first, False), edge(2, first, True), edge(2, last, False))
    rows = spans.select(key, "kind", "start", "end", F.explode(F.when(base, of_base).otherwise(of_weak)).alias("e")).select(key, "kind", "start", "end", "e.*")
    order = W.partitionBy(key).orderBy("point")
    answer = lambda role: F.max(F.when(~F.col("asks") & (role_of(F.col("kind")) == role), 1))
    frames = {0: order.rangeBetween(W.unboundedPreceding, 0), 1: order.rangeBetween(0, scope), 2: order.rangeBetween(-scope, 0)}
    rows = rows.withColumn("till", F.max(F.when(~F.col("asks") & (F.col("sweep") == 0), F.col("end"))).over(frames[0]))
    roles = sorted({r for some in COMPLEMENTS.values() for r in some})
    near = lambda role: F.when(F.col("sweep") == 1, answer(role).over(frames[1])).when(F.col("sweep") == 2, answer(role).over(frames[2])).isNotNull()
    rows = rows.withColumns({f"near_{r}": near(r) for r in roles})
    fits = F.lit(False)
    for kind, some in COMPLEMENTS.items():
        for r in some:
            fits = fits | ((F.col("kind") == kind) & F.col(f"near_{r}"))
    covered = (F.col("sweep") == 0) & F.coalesce(F.col("till") > F.col("start"), F.lit(False))
    found = rows.where("asks").groupBy(key, "kind", "start", "end").agg(F.max(fits).alias("fits"), F.max(covered).alias("covered"))
    return found.where(base | (F.col("fits") & ~F.col("covered"))).select(key, "kind", "start", "end")


def has_some(text: Column) -> Column:
    """Whether anything can be found in a text: a base match, or weak parts that could complement each other."""
    has = {kind: text.rlike(spec[0]) for kind, spec in (BASE | WEAK).items()}
    some = F.lit(False)
    for kind in BASE:
        some = some | has[kind]
    for kind, other in sorted({tuple(sorted((k, o))) for k, roles in COMPLEMENTS.items() for o in WEAK if o != k and ROLE[o] in roles}):
        some = some | (has[kind] & has[other])
    return F.coalesce(some, F.lit(False))


def kept_spans(rows: DataFrame, scope: int) -> DataFrame:
    """(_key, all): the base spans and the linked weak ones of each (_key, _text), by start and then kind."""
    kept = with_linked(found_spans(rows), scope=scope)
    rank = F.lit(len(KINDS))
    for i, kind in enumerate(KINDS):
        rank = F.when(F.col("kind") == kind, F.lit(i)).otherwise(rank)
    return kept.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("all"))


def key_of(doc_id: str, text: str = "_text") -> Column:
    """Copies of a text under other ids have other keys, so they spread. The id's length, or a mark for null, keeps id and text apart."""
    i = F.col(f"`{doc_id}`").cast("string")
    return F.sha2(F.concat(F.coalesce(F.concat(F.length(i).cast("string"), F.lit(":"), i), F.lit("-")), F.col(text)), 256)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans, found (array of kind, start, end).

    Base spans always stay; weak ones join only when linked. Null and empty texts have no spans; texts of any length are scanned whole. A
    null id stays null. Rows that repeat id and text give equal results; rows that share an id but differ in text are kept apart. Other
    columns are not read. An empty table gives an empty one. Only rows with a match are exploded, keyed by id and text, so copies spread.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("_text")).withColumn("_key", key_of("doc_id"))
    by_text = kept_spans(rows.where(has_some(F.col("_text"))), scope)
    spelled = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = rows.select("doc_id", "_key").join(by_text, "_key", "left").withColumn("all", F.coalesce("all", F.array().cast(by_text.schema["all"].dataType)))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.size(F.filter("all", lambda s: s["kind"].isin(*WEAK))).cast("long").alias("n_linked"),
        F.sha2(spelled(F.filter("all", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        spelled(F.col("all")).alias("spans"),
        F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"),
    )


def mask_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE, mask: str = "*") -> DataFrame:
    """``docs`` with every span that ``scan_secrets`` reports replaced by as many ``mask`` characters. Rows, columns and text lengths stay.

    Texts in which nothing can be found, null and empty ones among them, pass straight through; only the others are shuffled.
    """
    body, own, key, spans = F.col(f"`{text}`"), unused("text", docs), unused("key", docs), unused("spans", docs)
    some = has_some(body)
    rows = docs.where(some).withColumn(own, body).withColumn(key, key_of(doc_id, own))
    by_text = kept_spans(rows.select(F.col(key).alias("_key"), F.col(own).alias("_text")), scope).toDF(key, spans)
    blank = lambda s: F.repeat(F.lit(mask), (s["end"] - s["start"]).cast("int"))
    masked = lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"].cast("int")), blank(s), F.substring(acc, s["end"].cast("int") + 1, F.length(acc)))
    new = F.when(F.col(spans).isNull(), body).otherwise(F.aggregate(spans, body, masked)).alias(text)
    out = rows.join(by_text, key, "left").select(*(new if c == text else F.col(f"`{c}`") for c in docs.columns))
    return docs.where(~some).unionByName(out)
