"""The Merkle manifest, WARC archives and fill-in-the-middle against plain versions, with the edge cases of their contracts."""

import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm.fill_middle import draws, event_automaton, fill_in_middle, restored, unit_ends
from quillon.llm.merkle import Combiner, children, depth, folded, joined, leaf_of, merkle_manifest
from quillon.llm.queries import MANIFEST
from quillon.llm.warc import assembled, page_captures, read_warc, records_of, write_warc

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    """[(row, leaf, subroot, root, siblings)] of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            out += run[: i % 3] + run[i % 3 + 1 :]
            i //= 3
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    own = {s: tree([leaf(r) for r in trees[s]]) for s in names}
    tops = tree([own[s][-1][0] for s in names])
    return [(r, leaf(r), own[s][-1][0], tops[-1][0], way(own[s], i) + way(tops, j)) for j, s in enumerate(names) for i, r in enumerate(trees[s])]


@pytest.mark.parametrize("sizes", [(1,), (4, 1, 3), (700, 2, 9, 28), (3000,)])
def test_manifest_against_a_plain_tree(spark, sizes):
    rows = [(1000 * s + i if i % 50 else 1000 * s, [None, "a", "é", "", "z"][s % 5], "x", i, "" if i % 7 == 0 else None if i % 11 == 0 else f"é\n{i}", "clash", "g") for s, n in enumerate(sizes) for i in range(n)]
    rows += rows[:1] * 3  # repeated rows
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = merkle_manifest(docs, columns=MANIFEST, keep=("doc_id", "grp")).withColumn("again", folded(F.col("leaf"), F.col("proof"))).collect()
    want = sorted((r[0], leaf, sub, root, tuple(way)) for r, leaf, sub, root, way in plain_manifest(rows))
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(x for s in r["proof"] for x in s["siblings"])) for r in got) == want
    assert all(r["again"] == r["root"] and r["grp"] == "g" for r in got)


def test_manifest_with_null_ids_and_an_empty_table(spark):
    rows = [(None, None, None, None, None, "", ""), (None, None, None, None, "", "", ""), (5, "s", "l", 1, "t", "", "")]
    got = merkle_manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"]) for r in got) == sorted(x[1:4] for x in plain_manifest(rows))
    assert merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_any_change_of_a_row_fails_its_proof(spark):
    docs = spark.createDataFrame([(i, "s", "l", 1, f"a\nb{i}", "", "") for i in range(40)], DOCS)
    told = docs.withColumn("told", leaf_of([F.translate("text", "\n", "") if c == "text" else F.col(c) for c in MANIFEST]))
    got = merkle_manifest(told, columns=MANIFEST, keep=("doc_id", "told"))
    assert got.where(folded(F.col("told"), F.col("proof")) == F.col("root")).count() == 0


def test_events_in_any_order_finish_every_parent_once():
    import random

    for n in (1, 2, 3, 4, 10, 81, 100):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        order = list(range(n))
        random.Random(n).shuffle(order)
        own, done = Combiner(), []
        for i in order:
            done += own.add("g", n, 0, i, leaves[i])
        assert not list(own.rest()) and len({(d[2], d[3]) for d in done}) == len(done)
        level, want = leaves, 0
        while len(level) > 1:
            level = [joined(level[i : i + 3]) for i in range(0, len(level), 3)]
            want += len(level)
        assert len(done) == want and (n == 1 or joined(max(done, key=lambda d: d[2])[5]) == level[0])
        assert max([d[2] for d in done], default=0) == depth(n)
    assert children(4, 1, 1) == 1 and children(4, 2, 0) == 2 and children(4, 3, 0) == 0


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    h1, h2, h3, h4 = draws(42, "" if doc_id is None else str(doc_id))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, " ", "a", " a ", "é😀 \t\n b c  d  ", "x" * 5000, "a b " * 4000, "has <S> inside", "<<P ends <", "ends with < ", "\x0b\x0c\r", "<P", "word <M", "1:2:3"]


def test_middles_against_a_regular_expression(spark):
    rows = [(i, t, "kept", "clash") for i, t in enumerate(TEXTS * 12)] + [(None, "null id a b c", "kept", "clash"), (-7, "minus a b", "kept", "clash")]
    rows += rows[5:7]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, more string, form string")).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted(((r["doc_id"], r["back"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key)
    assert have == sorted(((i, t or "", *plain_middle(i, t)) for i, t, _, _ in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"} and all(r["more"] == "kept" for r in got)
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_events_alone_give_the_unit_ends():
    events = event_automaton()
    for t in TEXTS:
        ends, marked = unit_ends(t or "", events)
        at, want = 0, []
        for u in UNITS.findall(t or ""):
            at += len(u)
            want.append(at)
        assert ends.tolist() == want and marked == any(s in (t or "") for s in ("<P>", "<S>", "<M>"))


PAGES = "page_id long, url string, html string, spread string, n long"
HTML = ["", None, "<p>é😀</p>", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "line\nline\r\n\r\nline", "x" * 200_000, "\r\n\r\n"]


def warc_rows(spark, tmp_path, rows, **how):
    path = str(tmp_path / "warc")
    write_warc(spark.createDataFrame(rows, PAGES), path, **how)
    return path, page_captures(assembled(read_warc(spark, path))).collect()


def test_archives_keep_every_page(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/p q\r\n{i}" if i % 4 else None, HTML[i % len(HTML)], "x", 1) for i in range(90, 20, -1)]
    path, got = warc_rows(spark, tmp_path, rows)
    first = {}
    for i, _, h, *_ in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        head = first[h or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == head else "revisit", None if i == head else head))
    assert sorted(tuple(r) for r in got) == sorted(want)
    nested = assembled(read_warc(spark, path)).collect()
    assert len(nested) == len(rows) and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in nested)
    assert all(r["response"]["declared"] == r["response"]["payload_digest"] for r in nested if r["response"]["type"] == "response")
    assert {bytes(r["response"]["payload"]).decode() for r in nested if r["response"]["payload"] is not None} == {h or "" for h in HTML}
    assert all(re.fullmatch(r"[^\s]+", r["response"]["target_uri"]) for r in nested)


def test_repeated_pages_null_ids_and_small_payloads(spark, tmp_path):
    rows = [(7, "u", "same", "x", 1)] * 5 + [(3, "v", "same", "x", 1)] * 3 + [(None, "w", "same", "x", 1), (None, "w", "other", "x", 1), (1, "s", "ab", "x", 1), (2, "s", "ab", "x", 1), (2, "s", "ab", "x", 1)]
    _, got = warc_rows(spark, tmp_path, rows, revisit_bytes=3)
    same = [r for r in got if r["payload_bytes"] == 4]
    assert len(got) == len(rows) and [r["page_id"] for r in same if r["record_type"] == "response"] == [3]
    assert all(r["refers_to"] == 3 for r in same if r["record_type"] == "revisit") and len(same) == 9
    assert [r["record_type"] for r in got if r["payload_bytes"] == 2] == ["response"] * 3
    assert [r["record_type"] for r in got if r["payload_bytes"] == 5] == ["response"]


def test_an_empty_table_of_pages(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_warc(spark.createDataFrame([], PAGES), path)
    assert page_captures(assembled(read_warc(spark, path))).collect() == []


def test_many_pages_with_one_payload_are_looked_up(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "hot" if i % 2 else f"own {i}", "x", 1) for i in range(4000)]
    _, got = warc_rows(spark, tmp_path, rows)
    assert len(got) == 4000 and sum(r["refers_to"] == 1 for r in got) == 1999


def made(kind, name, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"{k.replace('_', '-')}: {v}" for k, vs in headers.items() for v in (vs if isinstance(vs, list) else [vs])), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_transactions_are_assembled_whoever_names_whom(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    kind = {"Content-Type": "application/http; msgtype=response"}
    notes = {"Content-Type": "application/warc-fields"}
    parts = [
        made("warcinfo", "<i>", b"software: x\r\n", **notes),
        made("metadata", "<m1>", b"page_id: 1\r\n", **{"WARC-Concurrent-To": "<q1>"}, **notes),  # reaches its response over the request
        made("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", **{"WARC-Concurrent-To": "<r1>", "Content-Type": "application/http"}),
        made("response", "<r1>", http, **kind),
        made("response", "<r2>", http + b"2", **{"WARC-Concurrent-To": ["<q2>", "<m2>"]}, **kind),  # names the others itself
        made("request", "<q2>", b"GET / HTTP/1.1\r\n\r\n", **{"Content-Type": "application/http"}),
        made("metadata", "<m2>", b"page_id: 2\r\n", **notes),
        made("revisit", "<r3>", b"HTTP/1.1 200 OK\r\n\r\n", **{"WARC-Refers-To": "<r1>"}, **kind),
        made("metadata", "<m3>", b"page_id: 3\r\n", **{"WARC-Concurrent-To": "<r3>"}, **notes),
        made("metadata", "<m9>", b"page_id: 9\r\n", **{"WARC-Concurrent-To": "<nowhere>"}, **notes),
    ]
    place = tmp_path / "archives"
    place.mkdir()
    (place / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[::2]))
    (place / "b.warc").write_bytes(b"".join(parts[1::2]))
    captures = assembled(read_warc(spark, str(place)))
    got = {r["capture_id"]: r for r in captures.collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>"}
    assert [x["record_id"] for x in got["<r1>"]["requests"]] == ["<q1>"] and [x["record_id"] for x in got["<r2>"]["requests"]] == ["<q2>"] and got["<r3>"]["requests"] is None
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in page_captures(captures).where("page_id <> 3").collect()) == [(1, 4, None), (2, 5, None)]
    assert [(r["payload_bytes"], r["refers_to"]) for r in page_captures(captures).where("page_id = 3").collect()] == [(4, 1)]


def test_cut_off_archives_raise():
    whole = made("response", "<r>", b"0123456789")
    assert [bytes(b) for _, b in records_of(whole * 2)] == [b"0123456789"] * 2
    for bad in (whole[:-8], b"noise" + whole):
        with pytest.raises(ValueError):
            list(records_of(bad))
