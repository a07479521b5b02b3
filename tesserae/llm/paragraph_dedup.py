"""Substring dedup by paragraphs: MinHash banding, exact Jaccard on colliding paragraphs, clusters by connected components.

Two kinds of paragraphs are compared, each with its like. A line of min_words words or more is one as its author set it: its set is
that of its 5-word shingles in lower case, and with BANDS bands of ROWS rows two lines of Jaccard 0.8 collide with probability
1 - (1 - 0.8**4)**16 = 0.9998. A passage inside a longer line, or one that is wrapped otherwise, is found by windows: of any REACH
shingles in a row of a text, whatever its lines, the least-hashed one, a MinHash of one row, begins a paragraph of WINDOW words.
So a passage of REACH + WINDOW - 1 = 50 words has one and the same window wherever it stands. A window has 16 shingles, of which
0.8 lets one at most differ, so windows collide and link where they are equal.

Equal paragraphs are one node from the start. Each band key with several nodes is a candidate set; sets with the same members are
verified once. A set is compared through an index of its shingles; one of more than BLOCK nodes or BLOCK_BYTES bytes is cut into
tiles of two blocks each, so no task gets an unbounded set, and no pair is emitted or lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Forest, connected_components, cut, join_unique, small_batches, texts_of

SIZE, MIN_WORDS, THRESHOLD = 5, 20, 0.8
REACH, WINDOW = 31, 20
BANDS, ROWS, BLOCK, BLOCK_BYTES = 16, 4, 2000, 8_000_000
#: Entries of postings that are counted at once; nodes that a task remembers to have sent.
POSTINGS, SEEN = 1_000_000, 500_000
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the shingles in order; of the whole sequence if there are fewer words."""
    if len(words) <= SIZE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(SIZE)), strict=False))), np.uint64, len(words) - SIZE + 1)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(hashes(words))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit keys, a row of BANDS for the MinHash of each set of hashes (repeats do no harm)."""
    least = np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint32).max, dtype=np.uint32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(flat), 4096):
        x = flat[i : i + 4096, None] * _A + _B
        own = owner[i : i + 4096]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        least[own[at]] = np.minimum(least[own[at]], np.minimum.reduceat(x, at, axis=0))
    least = least.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    key = np.full((len(sets), BANDS), 0x9E3779B97F4A7C15, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ least[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key


def anchors(h: np.ndarray, reach: int) -> np.ndarray:
    """Positions that are the least-hashed, of equal ones the first, among some reach shingles in a row; among all if there are fewer."""
    n = len(h)
    if n <= reach:
        return np.array([int(h.argmin())]) if n else np.zeros(0, np.int64)
    low, out, step = np.uint64(24), [], (1 << 24) - reach
    for at in range(0, n - reach + 1, step):
        part = h[at : at + step + reach - 1]
        least = part >> low << low | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        out.append(np.unique(least & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    return np.unique(np.concatenate(out))


def similar(sets: list[np.ndarray], side: np.ndarray):
    """For each member, the earlier members (of the other side, if there are two) whose Jaccard with it reaches the threshold."""
    size = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, start = np.unique(np.concatenate(sets)[order], return_index=True)
    posting, end = member[order], np.r_[start[1:], len(order)]
    two = len(np.unique(side)) > 1
    for i, x in enumerate(sets):
        k = np.searchsorted(values, x)
        both = np.zeros(i, np.int64)
        for part in np.split(k, np.flatnonzero(np.diff(np.cumsum(end[k] - start[k]) // POSTINGS)) + 1):
            both += np.bincount(np.concatenate([posting[a:b] for a, b in zip(start[part], end[part], strict=True)]), minlength=len(sets))[:i]
        hit = both >= THRESHOLD * (size[:i] + size[i] - both)
        yield i, np.flatnonzero(hit & (side[:i] != side[i]) if two else hit)


def units(text: bytes, min_words: int = MIN_WORDS):
    """(words, hashes of the shingles, lines, windows) of a text: lines as (line, first word, words), windows as (line, first word)."""
    words: list[bytes] = []
    lines, starts = [], []
    for k, line in enumerate(text.lower().split(b"\n")):
        own = line.split()
        if len(own) >= min_words:
            lines.append((k, len(words), len(own)))
        starts.append(len(words))
        words += own
    h = hashes(words) if len(words) >= SIZE else np.zeros(0, np.uint64)
    at = anchors(h, REACH)
    at = at[at + WINDOW <= len(words)]
    return words, h, lines, list(zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist(), strict=True))


NAMES = ("doc_id", "text", "paragraph", "first_word", "n_words", "node", "line", "body", "bands")
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))


def _paragraphs(min_words: int):
    """Rows of NAMES: text is a hash of it, line tells lines from windows; a line's body and bands go once a task and node."""

    def flush(rows, sets):
        new = [i for i, r in enumerate(rows) if r[7] is not None]
        keys = [None] * len(rows)
        if new:
            for i, x in zip(new, bands(sets).view(np.int64), strict=True):
                keys[i] = x
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((*zip(*rows, strict=True), keys), KINDS, strict=True)], names=list(NAMES))

    def run(batches):
        name, seen = xxhash.xxh3_64_intdigest, set()
        for batch in batches:
            rows, sets = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tag = name(text) - (1 << 63)
                words, h, lines, windows = units(text, min_words)
                for k, at, n in lines:
                    body = b" ".join(words[at : at + n])
                    node = name(body) - (1 << 63)
                    if new := node not in seen:
                        seen.add(node)
                        sets.append(h[at : at + n - SIZE + 1] if n > SIZE else hashes(words[at : at + n]))
                    rows.append((doc, tag, k, at, n, node, True, body if new else None))
                for k, at in windows:
                    rows.append((doc, tag, k, at, WINDOW, name(b" ".join(words[at : at + WINDOW]), 1) - (1 << 63), False, None))
                if len(rows) >= 20_000:
                    yield flush(rows, sets)
                    rows, sets = [], []
            if rows:
                yield flush(rows, sets)
            if len(seen) > SEEN:
                seen.clear()

    return run


def _verify(batches):
    """Rows sorted by group and tile to links: (a, b) of a spanning forest of the pairs that reach the threshold."""

    def flush(rows):
        if len(rows) < 2:
            return
        forest, found, nodes = Forest(), [], [r[0] for r in rows]
        for i, hits in similar([shingles(r[2].split(b" ")) for r in rows], np.array([r[1] for r in rows])):
            found += [(nodes[i], nodes[j]) for j in hits.tolist() if forest.join(nodes[i], nodes[j])]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    last, rows = None, []
    for batch in batches:
        for key, lo, hi, node, side, body in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (key, lo, hi) != last:
                yield from flush(rows)
                last, rows = (key, lo, hi), []
            rows.append((node, side, body))
    yield from flush(rows)


def _candidates(paras: DataFrame) -> DataFrame:
    """(bucket, node, n): the nodes of each band key that has several, n of them; of keys with the same nodes one."""
    member = paras.where("bands is not null").select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    key = Window.partitionBy("bucket")
    before, most, least = F.lag("node").over(key.orderBy("node")), F.max("node").over(key), F.min("node").over(key)
    rows = member.select("bucket", "node", before.alias("before"), most.alias("most"), least.alias("least"))
    hit = cut(rows.where("most <> least and (before is null or before <> node)").select("bucket", "node"), "buckets")
    same = hit.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return join_unique(hit, cut(same.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "sets"), "bucket")


def _links(paras: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, tile by tile, of the pairs of lines that reach the threshold."""
    body = paras.where("body is not null").groupBy("node").agg(F.first("body").alias("body"))
    sets = cut(_candidates(paras).join(body, "node"), "sets")
    sizes = sets.groupBy("bucket").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("body")) / BLOCK_BYTES)).alias("blocks"))
    dealt = join_unique(sets.drop("n"), cut(sizes, "sizes"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", F.col("block").alias("side"), "body")
    return tiles.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node").mapInArrow(_verify, "a long, b long")


def near_duplicates(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, first_word, n_words, line, component_id, kept: a row for each paragraph that has near-duplicates, in its document or others.

    paragraph is the line, from 0, in which it begins, first_word its first word in the text, line whether it is a whole line or a
    window; words of rows that aren't kept are what goes. kept is true for one paragraph of a component, the first by (doc_id,
    first_word). A null id is after all others. Lines and texts under min_words and WINDOW words, and null texts, give no rows; repeated rows
    repeat their paragraphs.
    """
    schema = "doc_id long, text long, paragraph int, first_word int, n_words int, node long, line boolean, body binary, bands array<long>"
    paras = cut(small_batches(texts_of(df, id_col, text_col)).mapInArrow(_paragraphs(min_words), schema), "paragraphs")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "first_word", "text")
    counts = paras.groupBy("line", "node").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    linked = counts.where("line").join(connected_components(_links(paras)), "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    named = cut(linked.select("node", "line", "n", "first", "component_id").union(counts.where("not line and n > 1").select("node", "line", "n", "first", F.col("node").alias("component_id"))).where("line or n > 1"), "named")
    classes = named.groupBy("line", "component_id").agg(F.sum("n").alias("members"), F.min("first").alias("lead")).where("members > 1")
    nodes = cut(named.select("line", "node", "n", "component_id").join(classes.drop("members"), ["line", "component_id"]), "classes")
    rows = paras.select("doc_id", "text", "paragraph", "first_word", "n_words", F.col("line"), "node")
    found = join_unique(rows.withColumn("node", F.struct("line", "node")), nodes.select(F.struct("line", "node").alias("node"), "n", "component_id", "lead"), "node")
    return found.select("doc_id", "paragraph", "first_word", "n_words", "line", "component_id", (F.col("lead") == order).alias("kept"))
