"""Toxicity on held-out rows, WARC records, and the pipeline against its stages in plain Python."""

import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tesserae.llm import queries, toxicity, warc

SF = "/root/testdata/sf0.01"


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "ko", "ti", "re", "shu", "nel"]) for _ in range(r.randint(1, 4))) for _ in range(600)]
    bad = ["vildrask", "grumpofel", "zetterbonk"]
    docs = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(30, 300))]
        if toxic := i % 4 == 0:
            for _ in range(max(2, len(t) // 25)):
                t.insert(r.randrange(len(t)), r.choice(bad))
        docs.append((i, " ".join(t), int(toxic)))
    return docs


def test_toxicity_separates_held_out_rows(spark):
    docs = corpus(900, 1)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in docs], "doc_id long, toxic int")
    model = toxicity.fit_from(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(got[i].score, k) for i, _, k in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert min(s for s, k in held if k) > max(s for s, k in held if not k) or np.mean([(s >= 0.3) == k for s, k in held]) > 0.95
    again = toxicity.fit_from(df, labels.unionByName(labels.where("false")))
    assert np.allclose(again.weights, model.weights)


def test_toxicity_weighs_weaker_markers():
    """A language whose toxic documents all have a marker that a tenth of its ordinary ones have too: likelier by less than the strong markers."""
    r = random.Random(5)
    word = lambda parts: "".join(r.choice(parts) for _ in range(r.randint(2, 4)))
    wide, small = [[word(p) for _ in range(500)] for p in (["ba", "ko", "ti", "re", "nel"], ["ach", "ung", "ver", "sch", "ein"])]

    def text(k, toxic):
        out = [r.choice(small if k else wide) for _ in range(120)]
        if toxic or k and r.random() < 0.1:
            out[60:60] = ["zufrimbelt" if k else "vildrask"] * 4
        return " ".join(out).encode()

    model = toxicity.fit([text(k, True) for _ in range(60) for k in (0, 0, 1)], [text(k, False) for _ in range(300) for k in (0, 1, 1, 1)])
    s = toxicity.Scorer(model)
    toxic, clean = s.scores([text(1, True) for _ in range(60)]), s.scores([text(1, False) for _ in range(300)])
    assert (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2 > 0.85


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (None, 1), (7, None), (10, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit_from(odd, labels), toxicity.fit_from(odd, labels.where("false")), toxicity.fit_from(empty, labels)):
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert toxicity.score(empty, model).count() == 0
        assert toxicity.reject(odd, model, 2.0).columns == odd.columns and toxicity.reject(odd, model, 2.0).count() == odd.count()


def test_warc_derivatives(spark, tmp_path):
    html = "<html><title> A\n b </title><script>x<y</script><p>One &amp; <b>two</b></p><!-- no --><div>three<br>four</div><a href='u'>l</a>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derive(warc.responses_of(pages)).collect()
    assert len(rows) == 6
    one = {r.warc_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block == "A b\nOne & two\nthree\nfour\nl"
    assert "title: A b\r\n" in one["metadata"].block and "links: 1\r\n" in one["metadata"].block and one["metadata"].refers_to in one["metadata"].block
    assert one["conversion"].refers_to == one["metadata"].refers_to != one["conversion"].record_id and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", one["conversion"].record_id)
    head = b"HTTP/1.1 404 Gone\r\nContent-Type: text/html\r\nX-Own: 1"
    body = head + b"\r\n\r\n" + html.encode()
    record = lambda kind, b: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("warcinfo", b"x")) + gzip.compress(record("response", body)))
    (tmp_path / "b.warc").write_bytes(record("response", body) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    read = warc.read_responses(spark, str(tmp_path))
    assert read.count() == 2 and {r.source_id for r in read.collect()} == {"<urn:uuid:1>"}
    out = warc.derive(read)
    assert all("source-status: HTTP/1.1 404 Gone\r\n" in r.block and "X-Own: 1" in r.http_headers for r in out.where("warc_type = 'metadata'").collect())
    warc.write_records(out, str(tmp_path / "out"))
    raw = [bytes(r.warc) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(h["warc-type"] for x in raw for h, _ in warc.parse(x)) == ["conversion", "conversion", "metadata", "metadata"]


def test_warc_keeps_source_headers_and_bytes(spark, tmp_path):
    def record(i, body, *fields):
        block = "\r\n".join(("HTTP/1.1 200 OK", *fields)).encode() + b"\r\n\r\n" + body
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Date: 2020-02-0{i}T00:00:00Z\r\nWARC-Payload-Digest: sha1:D{i}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    latin, packed = "<p>café</p>".encode("latin-1"), gzip.compress("<p>größe</p>".encode())
    one, two, three = record(1, latin, "Content-Type: text/html; charset=ISO-8859-1", "X-Own: 1"), record(2, packed, "Content-Encoding: gzip"), record(3, b"4\r\n<p>a\r\n5\r\nb</p>\r\n0\r\n\r\n", "Transfer-Encoding: chunked")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(one + b"a bad line\r\n" + two + b"WARC/1.1\r\nContent-Length: no\r\n\r\n" + three)
    read = warc.read_responses(spark, str(tmp_path / "in"))
    rows = {r.source_id: r for r in read.collect()}
    assert [(rows[f"<urn:uuid:{i}>"].payload, rows[f"<urn:uuid:{i}>"].source_payload_digest) for i in (1, 2, 3)] == [("<p>café</p>", "sha1:D1"), ("<p>größe</p>", "sha1:D2"), ("<p>ab</p>", "sha1:D3")]
    assert bytes(rows["<urn:uuid:2>"].body) == packed
    names = warc.write_files(warc.derive(read), str(tmp_path / "out"))
    found = [x for n in names for x in warc.parse((tmp_path / "out" / n).read_bytes())]
    assert len(found) == 6 and all(n.endswith(".warc.gz") for n in names)
    h, block = next((h, b) for h, b in found if h["warc-type"] == "conversion" and h["warc-refers-to"] == "<urn:uuid:1>")
    assert block.decode() == "café" and h["warc-date"] == "2020-02-01T00:00:00Z" and h["warc-source-declared-payload-digest"] == "sha1:D1"
    assert h["warc-source-payload-digest"] == "sha256:" + hashlib.sha256(latin).hexdigest() and "X-Own: 1" in h["warc-source-http-header"]
    damaged = bytearray(gzip.compress(one) + gzip.compress(two))
    damaged[40:60] = b"\xff" * 20
    assert [h["warc-record-id"] for h, _ in warc.parse(bytes(damaged))][-1] == "<urn:uuid:2>"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    at = [list(rel.columns).index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_pipeline_stages(spark):
    """The pipeline's last rows against each stage in plain Python, from what the stages before kept."""
    import corpus_pipeline as P
    from tests.llm.test_dedup import brute_removed, slow_fingerprint  # noqa: F401

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(P.STAGES)
    model = toxicity.fit_from(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    one = stage["toxicity"](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == {k for k, s in scores.items() if s < P.TOXIC_FROM} and one.columns == list(P.COLUMNS)
    two = stage["quality_rules"](spark, one, sf)
    text = {r.doc_id: r.text for r in one.collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)

    def fails(t):
        w = split(t)
        win = list(zip(w, w[1:], w[2:], strict=False))
        hit = {i + d for i, x in enumerate(win) if win.count(x) > 1 for d in range(3)}
        return len(w) < 50 or 100 * len(hit) > 50 * len(w)

    good = {k for k, t in text.items() if not fails(t)}
    assert {r.doc_id for r in two.collect()} <= good and two.count() >= 0.9 * len(good)
    three = stage["simhash_near_dedup"](spark, two, sf)
    fp = {r.doc_id: slow_fingerprint(r.text) for r in two.collect()}
    kept = {r.doc_id for r in three.collect()}
    reach = {k: {j for j in fp if bin(fp[j] ^ fp[k]).count("1") <= 2} for k in fp}
    for k in fp:
        seen, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += reach[x]
        assert (k in kept) == (k == min(seen))
    four = stage["suffix_array_dedup"](spark, three, sf)
    before = sorted((r.doc_id, r.text.encode()) for r in three.collect())
    want = brute_removed(before)
    after = {r.doc_id: r for r in four.collect()}
    assert set(after) == kept
    for k, t in before:
        assert after[k].n_chars == len(after[k].text)
        assert len(after[k].text.encode()) <= len(t) - want[k][1] and len(after[k].text.encode()) >= len(t) - want[k][1] - 6 * want[k][2]
    library = Tokenizer.from_file(queries.VOCABULARY)
    rows = stage["packing"](spark, four, sf).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {k: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in after.items()}
    assert P.run(spark, sf).count() == len(rows)


def test_pipeline_keeps_one_row_of_each_component(spark, odd):
    """Copies without an id, repeated rows that lead, and two texts under one id of which one is a copy."""
    import corpus_pipeline as P

    r = random.Random(12)
    a, b, c, d = (" ".join(f"w{r.randrange(900)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a), (1, b), (1, b), (2, c), (7, c), (7, d), (8, d), (None, b), (9, ""), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = dict(P.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert out.columns == list(P.COLUMNS)
    assert sorted(map(repr, ((x.doc_id, x.text) for x in out.collect()))) == sorted(map(repr, [(None, a), (1, b), (2, c), (7, d), (9, "")]))
    from tesserae.llm import simhash

    assert simhash.first_rows(odd).columns == odd.columns
