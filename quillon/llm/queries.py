"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod, discard, remove, shared_dir, written
from quillon.llm.fill_middle import fill_in_middle, restored
from quillon.llm.hnsw import nearest_neighbours
from quillon.llm.lm import score_language
from quillon.llm.merkle import folded, leaf_of, merkle_manifest
from quillon.llm.ngram_join import ngram_components
from quillon.llm.packing import pack_documents
from quillon.llm.piece_bpe import round_trips
from quillon.llm.quality import fit_quality, score_quality
from quillon.llm.secret_scan import scan_secrets
from quillon.llm.threshold_search import exact_top_k
from quillon.llm.toxicity import fit_toxicity, held_out, score_toxicity
from quillon.llm.url_filter import SOFT_TERMS, STRICT_TERMS, filter_urls
from quillon.llm.warc import assembled, page_captures, read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


#: The two operands' integer products, without null or non-finite vectors.
EXACT_TOP_K_SQL = """
    WITH e AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
    QUALIFY rank <= 20"""


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


#: Shingle lists, an equi-join on shingles, and the closure of the links.
NGRAM_JOIN_SQL = """
    WITH RECURSIVE t AS (
        SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM t),
    u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM met WHERE 100 * common >= 75 * (total - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.g)"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"), lambda i: crc_mod(i, 7) == 2)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs), keep=["doc_id"])


def op8_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that its base patterns alone decide."""
    return op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_spans_sql() -> str:
    """Matches and what lies between them give each match's place."""
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (("assign", assign, f"length(regexp_extract(m, '{assign}', 2)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24"))
    cut = lambda k, pattern: f"SELECT doc_id, uid, '{k}' AS kind, unnest(range(len(ms))) AS i, unnest(ms) AS m, bs FROM (SELECT doc_id, uid, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS bs FROM d)"
    rows = " UNION ALL ".join(f"SELECT doc_id, uid, kind, {n} AS nth, s, s + length(m) AS e FROM (SELECT *, list_sum([length(x) FOR x IN bs[:i + 1]]) + coalesce(sum(length(m)) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ({cut(k, p)})) WHERE {good}" for n, (k, p, good) in enumerate(kinds))
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS uid, coalesce(text, '') AS t FROM documents), r AS ({rows})
    SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, nth), '')) AS base_sha256 FROM d LEFT JOIN r USING (uid) GROUP BY d.doc_id, d.uid"""


#: Fixed values: (host, path, verdict).
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules=URL_RULES).drop("url")


def url_filter_sql() -> str:
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h + p}'" for h, p, _ in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for h, p, v in rules) + " WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END"
    count = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    h AS (SELECT page_id, {low("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, {low("url")} AS low FROM u),
    n AS (SELECT page_id, host, path, ({count(STRICT_TERMS)})::INT AS n_strict, ({count(SOFT_TERMS)})::INT AS n_soft FROM h)
    SELECT page_id, host, path, {rule} AS rule, n_strict, n_soft, {verdict} AS verdict FROM n"""


MANIFEST = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bare = F.translate("text", "\n", "")
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, leaf_of([bare if c == "text" else F.col(c) for c in MANIFEST]))
    manifest = merkle_manifest(docs.withColumn("tampered", tampered), columns=MANIFEST, keep=("doc_id", "tampered"))
    proof = F.sha2(F.array_join(F.flatten(F.transform("proof", lambda s: s["siblings"])), "").cast("binary"), 256)
    out = manifest.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels by runs of three, twice: in each source, then over the sources; and each row's way up, with its siblings and its folded digest.
MERKLE_SQL = r"""
    WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '') AS grp FROM documents),
    f AS (SELECT doc_id, grp, source, lang, n_chars, text, replace(text, chr(10), '') AS bare,
            list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])::BIGINT),
              lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT) & 1 AS odd FROM d),
    l AS (SELECT doc_id, grp, sha256(concat({own}, {text})) AS leaf, CASE WHEN odd = 1 THEN sha256(concat({own}, {bare})) ELSE sha256(concat({own}, {text})) END AS told,
            row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, sha256(concat({own}, {text}))) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM f),
    t AS (SELECT grp, 0 AS level, idx, n, leaf AS h FROM l
      UNION ALL SELECT grp, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY grp, level, idx // 3, n),
    s AS (SELECT grp, level AS depth, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT 0 AS level, idx, n, subroot AS h FROM s
      UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 3, n),
    nodes AS (SELECT grp, level, idx, h, depth FROM t JOIN s USING (grp)),
    runs AS (SELECT grp, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM t GROUP BY ALL),
    tops AS (SELECT level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM u GROUP BY ALL),
    w AS (SELECT l.doc_id, l.grp, l.leaf, l.told AS here, l.idx, 0 AS level, s.depth, s.idx AS place, s.subroot, '' AS others, l.idx AS own, s.n AS sources FROM l JOIN s USING (grp)
      UNION ALL SELECT w.doc_id, w.grp, leaf, sha256(concat(array_to_string(hs[:idx % 3], ''), here, array_to_string(hs[idx % 3 + 2:], ''))), idx // 3, w.level + 1, depth, place, subroot,
        others || array_to_string(hs[:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], ''), own, sources FROM w JOIN runs r ON r.grp = w.grp AND r.level = w.level AND r.run = idx // 3 WHERE w.level < depth),
    v AS (SELECT doc_id, grp, leaf, own, subroot, here, others, place AS idx, 0 AS level, sources AS n FROM w WHERE level = depth
      UNION ALL SELECT doc_id, grp, leaf, own, subroot, sha256(concat(array_to_string(hs[:idx % 3], ''), here, array_to_string(hs[idx % 3 + 2:], ''))),
        others || array_to_string(hs[:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], ''), idx // 3, v.level + 1, (n + 2) // 3 FROM v JOIN tops r ON r.level = v.level AND r.run = idx // 3 WHERE n > 1)
    SELECT doc_id, leaf, subroot, r.h AS root, sha256(others) AS proof_sha256, here AS folded_root, here = r.h AS verified FROM v, (SELECT h FROM u WHERE n = 1) r WHERE v.n = 1"""
for _name in ("own", "text", "bare"):
    _spelled = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in (MANIFEST[:-1] if _name == "own" else [_name])]
    MERKLE_SQL = MERKLE_SQL.replace("{" + _name + "}", ", ".join(_spelled))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    records = written(read_warc(spark, path).drop("payload"), "warc-records")  # parsed once; sizes and digests are those of the payloads read
    remove(spark, path)
    out = page_captures(assembled(records))
    discard(records)
    return out


WARC_SQL = r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS head FROM p),
    d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || hex[i * 5 + 1:i * 5 + 5])::BIGINT) AS w FROM h)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((w[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1]), '') AS payload_digest,
      CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


FILL_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
    c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
            least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
    p AS (SELECT doc_id, n, form, text, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_hnsw_search": op8_hnsw_search,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc": op12_warc,
    "op13_fill_in_middle": op13_fill_in_middle,
    "secret_base_spans": secret_base_spans,
}
ORACLE_SQL: dict[str, str] = {"op3_exact_top_k": EXACT_TOP_K_SQL, "op4_ngram_jaccard_join": NGRAM_JOIN_SQL, "op10_url_filter": url_filter_sql(), "op11_merkle_manifest": MERKLE_SQL, "op12_warc": WARC_SQL, "op13_fill_in_middle": FILL_SQL, "secret_base_spans": base_spans_sql()}
