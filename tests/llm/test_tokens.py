"""Token operators against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import bpe_trie, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ids_of = lambda t: LIBRARY.encode(t, add_special_tokens=False).ids
PARTS = ["a", "B", "é", " ", "  ", "\n", "'", "'s", "'re", "1", "²", "!", "<|endoftext|>", "<|", "漢", "\xa0", " ", "\x1c", "\x85", "_", "the", " of", "́"]


def texts(n=400):
    r = random.Random(5)
    return ["", " ", "a  b", "it's we're !!'re", "\n\n b", "x<|endoftext|>y"] + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 25))) for _ in range(n)]


def test_trie_encodes_and_decodes_as_the_library():
    e, ts = bpe_trie.encoder(PATH), texts()
    for t, ids in zip(ts, e.encode(ts), strict=True):
        assert ids == ids_of(t)
        assert e.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == t


def test_broken_utf8_decodes_as_the_library():
    ids = ids_of("漢字")[:1] + ids_of(" é")[:2]
    assert bpe_trie.encoder(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", texts(120))
def test_every_prefix_and_budget(text):
    index = token_counts.PrefixIndex(text, PATH)
    want = [len(ids_of(text[:k])) for k in range(len(text) + 1)]
    assert [index.count(k) for k in range(len(text) + 1)] == want
    for budget in (0, 1, 2, 5):
        assert index.fit(budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_queries_over_odd_rows(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((r.doc_id or -1, len(ids_of(r.text or ""))) for r in rows)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(odd, PATH).collect()) == want
    got = bpe_trie.round_trip(odd, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)
    back = bpe_trie.decode(bpe_trie.encode(odd, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in rows)
    assert not token_counts.token_counts(empty, PATH).count() and not bpe_trie.round_trip(empty, PATH).count()
    assert token_counts.prefix_counts(odd, PATH).count() == len(rows)


@pytest.mark.parametrize("window,n", [(8, 40), (16, 300), (64, 1500)])
def test_plan_is_best_fit_decreasing(window, n):
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, window + 1, n)
    bins = []
    for x in sorted(lengths.tolist(), reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            bins[min(fits, key=lambda b: (bins[b], b))] -= x
        else:
            bins.append(window - x)
    filled, seen = {}, np.zeros(window + 1, int)
    for length, rank, use, each, first, offset in packing.plan(np.bincount(lengths, minlength=window + 1), window):
        assert rank == seen[length]
        seen[length] += use * each
        for k in range(use):
            filled.setdefault(first + k, []).extend((offset + j * length, length) for j in range(each))
    assert (seen == np.bincount(lengths, minlength=window + 1)).all() and len(filled) == len(bins)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_packing_keeps_every_id_once(odd, empty):
    rows = packing.pack(odd.where("doc_id is not null and doc_id not in (1, 11)"), PATH, 64).collect()
    want = {r.doc_id: ids_of(r.text or "") + [0] for r in odd.where("doc_id is not null and doc_id not in (1, 11)").collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for k, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[k])
            assert p.ids_crc32 == zlib.crc32(np.array(want[k][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[k])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(odd, PATH, 64).count() > len(rows)
    assert packing.pack(empty, PATH, 64).count() == 0
