"""Near-duplicate and substring operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tesserae.llm import common, embedding_dedup, paragraph_dedup, quality, simhash, suffix_dedup


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 1299), (7, 7)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000} and got[5000] == 1000
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 700):
        t = " ".join(r.choice(["The", "cat", "É", "sat\ton", "x\x1cy"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_vantage_points_find_all_pairs():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([(c := rng.integers(0, 1 << 63, 300, dtype=np.uint64)), c ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), c ^ np.uint64(5)]))
    found = set()
    for at, leaf, hit in simhash.pairs_within(simhash.Node(fps, 8), fps, 2):
        q, k = np.nonzero(hit)
        found |= {(int(a), int(b)) for a, b in zip(fps[at[q]], leaf[k], strict=True)}
    want = {(int(a), int(b)) for a in fps for b in fps[np.bitwise_count(fps ^ a) <= 2]}
    assert found == want


def test_simhash_components(spark, odd, empty, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = {}
    for g in range(30):
        t = [r.choice(words) for _ in range(120)]
        for k in range(4):
            u = list(t)
            u[r.randrange(120)] = "edit"
            texts[g * 10 + k] = " ".join(u)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(simhash, "SHARD", 20)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    fp = {k: slow_fingerprint(t) for k, t in texts.items()}
    groups = Groups(texts)
    for a in texts:
        for b in texts:
            if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2:
                groups.join(a, b)
    assert got == {k: (f"{fp[k]:016x}", groups.find(k)) for k in texts}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {x.component_id for x in rows if x.doc_id in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(empty).count() == 0


def brute_removed(docs):
    seen, out = set(), {}
    for i, t in docs:
        cut = bytearray(len(t))
        for p in range(len(t) - 99):
            if (w := t[p : p + 100]) in seen:
                cut[p : p + 100] = b"\1" * 100
            seen.add(w)
        out[i] = (len(t), sum(cut), len(re.findall(rb"\x01+", bytes(cut))), hashlib.sha256(bytes(c for c, x in zip(t, cut, strict=True) if not x)).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_is_exact(spark, seed, monkeypatch):
    r = random.Random(seed)
    alphabet = ["ab", "abcdefgh ", "xyzé漢\n", "a\x00"][seed]
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [text(r.randint(60, 300)) for _ in range(6)]
    docs = []
    for i in range(60):
        x = ""
        for _ in range(r.randint(1, 6)):
            p = r.choice(passages) if r.random() < 0.6 else text(r.randint(1, 150))
            x += p[r.randint(0, len(p)) :] if r.random() < 0.3 else p
        docs.append((i, "b" * 400 if i % 20 == 7 else docs[3][1] if i % 15 == 9 else x))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_removed([(i, t.encode()) for i, t in docs])
    for least in (1000, 0):  # with every anchor that has several contexts as a hot one, too
        monkeypatch.setattr(suffix_dedup, "LEAST_HOT", least)
        monkeypatch.setattr(suffix_dedup, "HOT_KEYS", 500 if least else 1 << 40)
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(df).collect()}
        assert got == want


def test_queue_pops_in_order_from_disk():
    rng = np.random.default_rng(1)
    kind = np.dtype([("key", "S9"), ("x", "<i8")])
    rows = np.empty(5000, kind)
    rows["x"] = np.arange(5000)
    rows["key"] = suffix_dedup._key(rng.integers(0, 40, 5000), rng.integers(0, 256, 5000).astype(np.uint8))
    for run in (37, 999, 10_000):
        queue = suffix_dedup.DiskQueue(kind, run)
        for i in range(0, 5000, 123):
            queue.push(rows[i : i + 123])
        got = np.concatenate(list(queue.blocks()))
        assert (got["key"][1:] >= got["key"][:-1]).all() and sorted(got["x"]) == list(range(5000)) and (rows["key"][got["x"]] == got["key"]).all()


def hot_contexts(n, seed=3):
    """Contexts that share one anchor: few different bytes, so that windows are equal at many places, and some whole contexts twice."""
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        dlo, dhi = r.randint(0, 84), 0
        dhi = r.randint(0, dlo)
        side = lambda k: bytes(97 + (r.random() < 0.02) for _ in range(k))
        t = side(84) + b"0123456789abcdef" + side(84)
        rows.append((7 << 60, 0, r.randrange(n), r.randrange(3), 1000 + 300 * i, dlo, dhi))
        texts.append(t[84 - dlo : 84 - dhi + 100])
    return rows, texts


def marks_by_brute_force(rows, texts):
    seen, out = {}, {}
    for (_, _, doc, tag, pos, dlo, dhi), t in zip(rows, texts, strict=True):
        for d in range(dhi, dlo + 1):
            seen.setdefault((d, t[dlo - d : dlo - d + 100]), []).append((doc, tag, pos))
    for (d, _), who in seen.items():
        for doc, tag, pos in who:
            if (doc, tag, pos) != min(who):
                out.setdefault((doc, tag), set()).update(range(pos - d, pos - d + 100))
    return out


def covered(marks):
    out = {}
    for block in marks.blocks():
        for x in block:
            out.setdefault((int(x["doc"]), int(x["tag"])), set()).update(range(x["start"], x["end"]))
    return out


@pytest.mark.parametrize("run,block", [(40, 16), (64, 500), (10_000, 33)])
def test_induction_from_disk_is_exact(monkeypatch, run, block):
    """Queues and blocks far smaller than the one anchor's contexts, cut by slices or not, against brute force."""
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows, texts = hot_contexts(700)
    want = marks_by_brute_force(rows, texts)
    assert len(want) > 50
    parts = [x for r, t in zip(rows, texts, strict=True) for x in suffix_dedup._slices(r, t)]
    for rs, ts in ((rows, texts), zip(*parts, strict=True)):
        queue, marks = suffix_dedup.DiskQueue(suffix_dedup.FIRST), suffix_dedup.Marks()
        queue.push(suffix_dedup.at_anchors(np.array(list(rs), suffix_dedup.ANCHOR), b"".join(ts)))
        suffix_dedup.equal_windows(queue, marks)
        assert covered(marks) == want


def test_shard_ten_times_its_memory(monkeypatch):
    """4,000 contexts of one anchor where queues sort 400 records: exact, and nothing larger is ever in memory."""
    monkeypatch.setattr(suffix_dedup, "RUN", 400)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 400)
    most = []

    class Watched(suffix_dedup.DiskQueue):
        def blocks(self):
            for block in super().blocks():
                most.append(len(block))
                yield block

        def _sorted(self):
            rows = super()._sorted()
            most.append(len(rows))
            return rows

    monkeypatch.setattr(suffix_dedup, "DiskQueue", Watched)
    rows, texts = hot_contexts(4000, 5)
    queue, marks = Watched(suffix_dedup.FIRST), suffix_dedup.Marks()
    for i in range(0, 4000, 200):
        queue.push(suffix_dedup.at_anchors(np.array(rows[i : i + 200], suffix_dedup.ANCHOR), b"".join(texts[i : i + 200])))
    suffix_dedup.equal_windows(queue, marks)
    assert covered(marks) == marks_by_brute_force(rows, texts)
    assert max(most) <= 2 * 400


def test_suffix_dedup_odd_rows(odd, empty):
    rows = suffix_dedup.digests(odd).collect()
    assert len(rows) == odd.count()
    nulls = [x for x in rows if x.doc_id is None]
    assert nulls[0].n_removed > 0  # rows without an id come last
    assert [x.n_removed for x in rows if x.doc_id == 6] == [0]
    assert {x.n_removed for x in rows if x.doc_id == 11} == {len(" ".join(f"passage{i}" for i in range(60)))}
    kept = suffix_dedup.remove(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert suffix_dedup.digests(empty).count() == 0 and suffix_dedup.remove(empty).count() == 0


def test_long_text_in_chunks():
    r = random.Random(9)
    t = bytes(r.randrange(256) for _ in range((1 << suffix_dedup.CHUNK_BITS) + 5000))
    pos, lo, hi, h = suffix_dedup.anchors(t)
    covered = np.zeros(len(t) - 99, int)
    for a, b in zip(lo, hi, strict=True):
        covered[a : b + 1] += 1
    assert (covered == 1).all() and (pos >= hi).all() and (pos <= lo + 84).all()


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 16))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.07, base * 3, base[:3]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (905, base[0].tolist() + [0.0]), (0, base[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "x")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    real = [(i, np.array(x)) for i, x in rows if x and len(x) == 16 and None not in x and np.isfinite(x).all() and any(x)]
    unit = np.array([x / np.linalg.norm(x) for _, x in real])
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    groups = Groups(range(len(real)))
    for a, b in zip(*np.nonzero(link), strict=True):
        groups.join(int(a), int(b))
    low = {}
    for k, (i, _) in enumerate(real):
        low[groups.find(k)] = min(low.get(groups.find(k), 10**9), i)
    want = [(i, int(link[k].sum()), low[groups.find(k)]) for k, (i, _) in enumerate(real)] + [(i, 0, i) for i in (900, 901, 902, 903, 904, 905)]
    assert got == sorted(want)


def test_quantisation_bound_and_dense_tiles():
    rng = np.random.default_rng(6)
    u = embedding_dedup.unit(rng.normal(size=(300, 1100)))
    q, s, e = embedding_dedup.quantise(u)
    gap = np.abs(u @ u.T - embedding_dedup.int8_product(q, q) * s[:, None] * s)
    assert (gap <= e[:, None] + e * (1 + e[:, None]) + 1e-9).all()
    close = np.ones((200, 8)) + rng.normal(size=(200, 8)) * 0.3
    mult = np.ones(200, dtype=np.int64)
    unit = embedding_dedup.unit(close)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert (embedding_dedup.tile(close, 0, mult, 0.95).n == want).all()
    half = embedding_dedup.tile(close, 80, mult, 0.95)
    assert (half.n[:80] == (unit[:80] @ unit[80:].T >= 0.95).sum(axis=1)).all()


def test_paragraphs(spark, odd, empty, monkeypatch):
    r = random.Random(8)
    line = lambda n: [f"v{r.randrange(400)}" for _ in range(n)]
    docs, lines = [], []
    for g in range(25):
        base = line(60)
        for k in range(3):
            near = list(base)
            near[r.randrange(60)] = f"edit{k}"
            lines.append(near if k else base)
    for i, w in enumerate(lines):
        docs.append((i, "short line\n" + " ".join(w) + "\n" + " ".join(line(40))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(paragraph_dedup, "BLOCK", 3)
    got = {(x.doc_id, x.paragraph): x.component_id for x in paragraph_dedup.near_duplicates(df).where("line").collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    groups = Groups(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.join(a, b)
    want = {}
    for i in range(len(lines)):
        want.setdefault(groups.find(i), set()).add((i, 1))
    have = {}
    for k, c in got.items():
        have.setdefault(c, set()).add(k)
    assert sorted(map(sorted, have.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
    rows = paragraph_dedup.near_duplicates(odd).collect()
    assert {x.doc_id for x in rows} >= {6, 7, 8, 11, None} and sum(x.kept for x in rows) == len({(x.line, x.component_id) for x in rows})
    assert paragraph_dedup.near_duplicates(empty).count() == 0


def test_passages_in_lines_and_over_lines(spark):
    """Every passage of 50 words that two documents share gives rows for both, wherever it stands and however it is wrapped; windows against brute force."""
    r = random.Random(21)
    line = lambda n: [f"v{r.randrange(9000)}" for _ in range(n)]
    docs = []
    for g in range(30):
        passage = line(50 + g)
        wrapped = "\n".join(" ".join(passage[i : i + 9]) for i in range(0, len(passage), 9))
        docs += [(3 * g, " ".join(line(g) + passage + line(40))), (3 * g + 1, " ".join(line(7)) + "\n" + wrapped.upper() + "\n" + " ".join(line(9))), (3 * g + 2, " ".join(line(60)) + "\n\n" + " ".join(line(19)))]
    docs += [(None, docs[0][1]), (500, " ".join(docs[2][1].split()[:45]))]
    got = paragraph_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id for x in got} == {i for i, _ in docs if i is None or i % 3 < 2 or i in (2, 500)}
    seen = {}
    for i, t in docs:
        words, h, _, windows = paragraph_dedup.units(t.encode())
        want = {min(range(k, k + 31), key=lambda j: (int(h[j]) >> 24, j)) for k in range(len(h) - 30)}
        assert {a for _, a in windows} == {a for a in want if a + 20 <= len(words)}
        for _, a in windows:
            seen.setdefault(b" ".join(words[a : a + 20]), []).append((i is None, i or 0, a))
    want = {x: k == 0 for xs in seen.values() if len(xs) > 1 for k, x in enumerate(sorted(xs))}
    assert {(x.doc_id is None, x.doc_id or 0, x.first_word): x.kept for x in got if not x.line} == want


def test_paragraph_columns_ties_and_lengths(spark):
    """Equal rows tie: one of each component is kept by (doc_id, first word); lines under min_words stay unless asked for; a whole line of copies in one document counts."""
    one, short = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(9))
    rows = spark.createDataFrame([(4, one + "\n" + short + "\n" + one), (9, short), (9, None), (None, "")], "doc_id long, text string")
    got = paragraph_dedup.near_duplicates(rows).where("line").collect()
    assert sorted((x.doc_id, x.paragraph, x.first_word, x.n_words, x.kept) for x in got) == [(4, 0, 0, 30, True), (4, 2, 39, 30, False)]
    got = paragraph_dedup.near_duplicates(rows, min_words=5).where("line").collect()
    assert sorted((x.doc_id, x.paragraph, x.kept) for x in got) == [(4, 0, True), (4, 1, True), (4, 2, False), (9, 0, False)]


def test_quality_counts_and_hosts(spark, odd, empty):
    t = "a b c a b c # x%\nline one here\nline one here\n\n \nend"
    assert quality.counts(t.encode()) == (15, 34, 2, 1, 12)
    assert quality.counts(b"") == (0, 0, 0, 0, 0)
    good, bad = " ".join(f"w{i}" for i in range(80)), "no"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(400)] + [(1000 + i, good if i % 10 else bad, "good") for i in range(400)] + [(5000, bad, "tiny"), (5001, good, None)]
    m = quality.measures(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    hosts = {r.host: r for r in quality.host_verdicts(m).collect()}
    assert not hosts["bad"].host_ok and hosts["good"].host_ok
    assert 0.4 < hosts["tiny"].shrunk_rate < 0.95  # one document hardly moves it off the mean
    kept = {r.doc_id: r.kept for r in quality.quality_rules(m).collect()}
    assert not kept[0] and not kept[1] and not kept[1000] and kept[1001] and kept[5001] == (hosts[""].host_ok)
    measured = quality.measures(odd)
    assert quality.quality_rules(measured).count() == odd.count()
    assert quality.quality_rules(quality.measures(empty)).count() == 0
