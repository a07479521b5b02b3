"""Each query of the subpackage as registered: columns and types of its contract, a row a row, and what can be said of the rows without the operator."""

import re
import zlib

import pyarrow.parquet as pq
import pytest

from tesserae.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_embedding_near_dup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_paragraph_dedup": {"doc_id": "bigint", "first_word": "int", "n_words": "int", "line": "boolean", "component_id": "bigint", "kept": "boolean"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_warc_derivatives": {"page_id": "bigint", "warc_type": "string", "record_id": "string", "refers_to": "string", "block": "string"},
    "op8_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_suffix_array_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}


def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {k: kinds.get(k) for k in CONTRACT[name]} == CONTRACT[name]
    rows = df.collect()
    assert rows and list(df.columns)[0] == next(iter(CONTRACT[name]))
    if name in ("op1_toxicity", "op5_simhash", "op6_token_counts", "op8_bpe_round_trip", "op9_suffix_array_dedup", "op10_quality_rules"):
        assert sorted(r.doc_id for r in rows) == sorted(texts())
    if name == "op1_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    if name == "op6_token_counts":
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    if name in ("op2_embedding_near_dup", "op5_simhash"):
        first = {}
        for r in rows:
            first[r.component_id] = min(first.get(r.component_id, r[0]), r[0])
        assert all(k == v for k, v in first.items())


def test_quality_against_plain_python(spark):
    """Every column of the rules, and the prior, the shrunk rates and the verdicts, worked out one by one from the texts."""
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want, hosts = {}, {}
    for r in docs:
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        n, symbols = len(words), len(re.findall(r"[#*$%&|<>]", t))
        base = n < 50 or 100 * len(again) > 50 * n
        want[r["doc_id"]] = (n, sum(map(len, words)), symbols, dup, len(again), base)
        hosts.setdefault(r["source"] or "", []).append((base, 10 * symbols > n, 20 * dup > n))
    total = sum(map(len, hosts.values()))
    ok = dict.fromkeys(hosts, True)
    for rule in range(3):
        m = sum(x[rule] for xs in hosts.values() for x in xs) / total
        s = sum(len(xs) * (sum(x[rule] for x in xs) / len(xs) - m) ** 2 for xs in hosts.values())
        v = (s - (len(hosts) - 1) * m * (1 - m)) / (total - sum(len(xs) ** 2 for xs in hosts.values()) / total)
        weight = 1e6 if v <= 0 or m in (0, 1) else min(1e6, max(2, m * (1 - m) / v - 1))
        for h, xs in hosts.items():
            ok[h] &= (sum(x[rule] for x in xs) + m * weight) / (len(xs) + weight) <= 0.5
    host = {r["doc_id"]: r["source"] or "" for r in docs}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_quality_rules(spark, SF).collect()}
    assert got == {k: (*x, not x[-1] and ok[host[k]]) for k, x in want.items()}
