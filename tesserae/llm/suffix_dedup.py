"""Exact removal of repeated substrings by external induced sorting of the suffixes of content-cut shards.

Every byte goes that lies in a string of LENGTH bytes which also starts earlier. A window of LENGTH bytes belongs to its anchor, the
least-hashed GRAM bytes in it, so equal windows have equal anchors at equal places wherever they stand, and a shard (a range of
anchor hashes) has all of them. Anchors are the first level of names: an anchor with its context, the bytes of all windows that
belong to it, is named by a 64-bit hash, and of equal names only the earliest goes on. Tasks do this before they send anything, so
a passage in a third of all documents reaches its shard once a task. What is left are contexts that share an anchor and differ.

There a disk-backed priority queue takes the suffixes that begin at anchors and gives them back in order, with the common prefix of
neighbours. The order induces that of the suffixes one byte to the left, level by level: each suffix, a tuple that carries the bytes
to its left, is pushed under (anchor, byte before it, place in the order) with its common prefix with the last one under that byte,
which is one more than the least since then; the next level pops them in order. Neighbours with LENGTH bytes in common are equal
windows. Sorting stops where no window can be equal any more.

Nothing in a shard is held whole: blobs are read as they come, queues keep RUN records in memory and sorted runs of them on the
task's own disk, and all passes go block by block. An anchor with a large share of all contexts is cut by the bytes around it.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import HOT_KEYS, LEAST_HOT, cut, lean, small_batches

LENGTH, GRAM = 100, 16
SPAN = LENGTH - GRAM + 1
#: Positions of a text that are hashed at once; the low bits of a key hold the position.
CHUNK_BITS = 20
#: Anchors that a task gathers before it names and sends them; records that a queue sorts in memory; records of a block.
GATHER, RUN, BLOCK = 1_500_000, 250_000, 50_000
#: Runs that a queue merges at once; more are merged into one first.
RUNS = 64
#: Parts by place in the window that the contexts of a hot anchor are cut into.
SLICES = 8
#: Shards to a shuffle partition.
SHARDS = 3
#: The order of a document without an id: after all others.
LAST = (1 << 63) - 1
ANCHOR = np.dtype([("h", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("dlo", "u1"), ("dhi", "u1")])
MARK = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4")])
#: What queues hold: a key whose bytes are in order, and the record. RIGHT is the key's part after the anchor's hash: LENGTH bytes and their number.
RIGHT = LENGTH + 1
NAMED = np.dtype([("key", "S32"), ("row", ANCHOR)])
MARKED = np.dtype([("key", "S16"), ("row", MARK)])
PLACE = [("group", "<u8"), ("lcp", "u1"), ("dlo", "u1"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("left", "u1", (SPAN - 1,))]
FIRST = np.dtype([("key", f"S{8 + RIGHT}"), *PLACE])
SUFFIX = np.dtype([("key", "S17"), *PLACE])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    a = b[:-1] | b[1:].astype(np.uint16) << np.uint16(8)
    a = a[:-2] | a[2:].astype(np.uint32) << np.uint32(16)
    return a[:-4] | a[4:].astype(np.uint64) << np.uint64(32)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, first and last window, and hash of each anchor of a text. Of equal hashes in a window the leftmost counts."""
    text, out = np.frombuffer(raw, dtype=np.uint8), []
    step = (1 << CHUNK_BITS) - LENGTH
    for at in range(0, max(0, len(text) - LENGTH + 1), step):
        w = _words(text[at : at + step + LENGTH - 1])
        h = _mix(w[:-8] * np.uint64(0x9E3779B97F4A7C15) + _mix(w[8:]))
        low = np.uint64(CHUNK_BITS)
        least = h >> low << low | np.arange(len(h), dtype=np.uint64)
        for s in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-s], least[s:])
        least = np.minimum(least[: -(SPAN - 64)], least[SPAN - 64 :])
        a = (least & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        hi = np.r_[lo[1:], len(a)] - 1
        out.append((a[lo] + at, lo + at, hi + at, h[a[lo]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def pack(rows: np.ndarray) -> bytes:
    """Column by column, so that it compresses."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(rows[k]).tobytes() for k in rows.dtype.names))


def unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for k in kind.names:
        size = n * kind[k].itemsize
        out[k] = np.frombuffer(raw, kind[k], n, at)
        at += size
    return out


def first_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest anchor of each context, in order of hash and context; marks for the others (a repeated row of one document is no other)."""
    rows = rows[np.lexsort((rows["pos"], rows["tag"], rows["doc"], rows["ctx"], rows["h"]))]
    new = np.r_[True, (rows["ctx"][1:] != rows["ctx"][:-1]) | (rows["h"][1:] != rows["h"][:-1])][: len(rows)]
    lead = rows[new][np.cumsum(new) - 1] if len(rows) else rows
    other = ~new & ((rows["doc"] != lead["doc"]) | (rows["tag"] != lead["tag"]) | (rows["pos"] != lead["pos"]))
    return rows[new], marks_of(rows[other], rows["pos"][other] - rows["dlo"][other].astype(np.uint32), rows["pos"][other] - rows["dhi"][other].astype(np.uint32) + np.uint32(LENGTH))


def marks_of(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks of a document that touch or overlap become one."""
    order = np.lexsort((start, rows["tag"], rows["doc"]))
    doc, tag, start, end = rows["doc"][order], rows["tag"][order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return np.empty(0, MARK)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    group = np.cumsum(new) - 1
    far = np.maximum.accumulate(end + (group << 33)) - (group << 33)  # the farthest end so far within the document
    new[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(new)
    out = np.empty(len(at), MARK)
    out["doc"], out["tag"], out["start"], out["end"] = doc[at], tag[at], start[at], far[np.r_[at[1:], len(doc)] - 1]
    return out


class DiskQueue:
    """A priority queue for bulk use: records of a type with a field key are pushed, then popped in order of the key, in blocks.

    At most run records are in memory: beyond that sorted runs go to the task's own disk and are merged block by block.
    """

    def __init__(self, kind: np.dtype, run: int | None = None):
        self.kind, self.run = kind, run or RUN
        self.parts: list[np.ndarray] = []
        self.size = self.pushed = 0
        self.files: list = []

    def push(self, rows: np.ndarray) -> None:
        self.pushed += len(rows)
        for i in range(0, len(rows), self.run):
            self.parts.append(rows[i : i + self.run])
            self.size += len(self.parts[-1])
            if self.size >= self.run:
                self._spill()

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.parts) if self.parts else np.empty(0, self.kind)
        self.parts, self.size = [], 0
        return rows[np.argsort(np.ascontiguousarray(rows["key"]), kind="stable")]

    def _spill(self) -> None:
        self._write([self._sorted()])
        if len(self.files) >= RUNS:
            files, self.files = self.files, []
            self._write(self._merged(files))

    def _write(self, blocks) -> None:
        f = tempfile.TemporaryFile()
        for rows in blocks:
            rows.tofile(f)
        f.seek(0)
        self.files.append(f)

    def blocks(self):
        if not self.files:
            rows = self._sorted()
            return (rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK))
        if self.size:
            self._write([self._sorted()])
        return self._merged(self.files)

    def _merged(self, files: list):
        most = max(1, min(BLOCK, self.run) // len(files))
        read = lambda f: np.frombuffer(f.read(most * self.kind.itemsize), self.kind)
        heads = {f: read(f) for f in files}
        while heads:
            bound = min(h["key"][-1] for h in heads.values())
            taken = []
            for f, h in list(heads.items()):
                n = int(np.searchsorted(np.ascontiguousarray(h["key"]), bound, "right"))
                if n:
                    taken.append(h[:n])
                    heads[f] = h[n:] if n < len(h) else read(f)
                    if not len(heads[f]):
                        del heads[f]
                        f.close()
            rows = np.concatenate(taken)
            yield rows[np.argsort(np.ascontiguousarray(rows["key"]), kind="stable")]


def _key(*columns: np.ndarray) -> np.ndarray:
    """Numbers and bytes side by side, as strings in the same order; signed numbers are shifted."""
    parts = []
    for c in columns:
        if c.ndim == 1:
            c = c ^ np.int64(-(1 << 63)) if c.dtype.kind == "i" else c
            c = np.ascontiguousarray(c.astype(c.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(c), -1)
        parts.append(c)
    out = np.ascontiguousarray(np.concatenate(parts, axis=1))
    return out.view(f"S{out.shape[1]}").ravel()


def _keyed(kind: np.dtype, key: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), kind)
    out["key"], out["row"] = key, rows
    return out


class Marks:
    """Marks of a shard in a queue; those of a document that touch or overlap come out as one."""

    def __init__(self):
        self.queue = DiskQueue(MARKED)

    def add(self, marks: np.ndarray) -> None:
        if len(marks):
            self.queue.push(_keyed(MARKED, _key(marks["doc"], marks["tag"], marks["start"]), marks))

    def blocks(self):
        open_ = np.empty(0, MARK)
        for block in self.queue.blocks():
            rows = np.concatenate((open_, block["row"]))
            rows = marks_of(rows, rows["start"], rows["end"])
            open_ = rows[-1:]
            if len(rows) > 1:
                yield rows[:-1]
        if len(open_):
            yield open_


def _dealt(rows: np.ndarray, shards: int):
    """(shard, blob) of rows that have h."""
    shard = rows["h"] % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    for s in range(shards):
        if bounds[s] < bounds[s + 1]:
            yield s, pack(rows[order[bounds[s] : bounds[s + 1]]])


def _batch(rows, names) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for k, x in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def _send_anchors(shards: int):
    """Documents to anchors, named and reduced within the task, dealt to shards."""

    def flush(parts, task):
        rows, marks = first_of(np.concatenate(parts))
        out = [(s, 0, b) for s, b in _dealt(rows, shards)]
        if len(marks):
            out.append((task % shards, 1, pack(marks)))
        return _batch(out, ("shard", "kind", "blob"))

    def run(batches):
        from pyspark import TaskContext

        parts, size, task = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc, tag, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pos, lo, hi, h = anchors(raw)
                if len(pos):
                    rows = np.empty(len(pos), ANCHOR)
                    rows["h"], rows["doc"], rows["tag"], rows["pos"], rows["dlo"], rows["dhi"] = h, doc, tag, pos, pos - lo, pos - hi
                    name = xxhash.xxh3_64_intdigest
                    rows["ctx"] = np.fromiter((name(raw[i:j]) for i, j in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)), np.uint64, len(pos))
                    parts.append(rows)
                    size += len(rows)
                    if size >= GATHER:
                        yield flush(parts, task)
                        parts, size = [], 0
        if parts:
            yield flush(parts, task)

    return run


FOUND = "doc long, tag long, start long, end long, dlo int, dhi int, h long"


def _found(marks: np.ndarray, rest: np.ndarray | None = None) -> pa.RecordBatch:
    rest = np.empty(0, ANCHOR) if rest is None else rest
    nulls = np.r_[np.ones(len(marks), bool), np.zeros(len(rest), bool)]
    col = lambda m, r, kind: pa.array(np.concatenate((m, r)).astype(kind))
    none = np.zeros(len(marks), np.int64)
    return pa.record_batch({
        "doc": col(marks["doc"], rest["doc"], np.int64), "tag": col(marks["tag"], rest["tag"], np.int64), "start": col(marks["start"], rest["pos"], np.int64), "end": col(marks["end"], rest["pos"], np.int64),
        "dlo": col(none, rest["dlo"], np.int32), "dhi": col(none, rest["dhi"], np.int32), "h": pa.array(np.concatenate((none, rest["h"].view(np.int64))), mask=nulls),
    })


def named(queue: DiskQueue, marks: Marks):
    """Anchors in order of hash, context and place: marks for contexts that came before; yields the first of each context where a hash has several."""
    lead, pending, more = np.empty(0, ANCHOR), np.empty(0, ANCHOR), False
    for block in queue.blocks():
        rows = np.concatenate((lead, block["row"]))
        new = np.r_[True, (rows["ctx"][1:] != rows["ctx"][:-1]) | (rows["h"][1:] != rows["h"][:-1])]
        first = rows[new][np.cumsum(new) - 1]
        other = ~new & ((rows["doc"] != first["doc"]) | (rows["tag"] != first["tag"]) | (rows["pos"] != first["pos"]))
        r = rows[other]
        marks.add(marks_of(r, r["pos"] - r["dlo"].astype(np.uint32), r["pos"] - r["dhi"].astype(np.uint32) + np.uint32(LENGTH)))
        # the lead that the last block ended with is the first row here, and pending already
        leads = np.concatenate((pending, rows[new][len(lead) :]))
        same = np.r_[more, leads["h"][1:] == leads["h"][:-1]]
        several = same[:-1] | same[1:]
        if several.any():
            yield leads[:-1][several]
        lead, pending, more = rows[new][-1:], leads[-1:], bool(same[-1])
    if more:
        yield pending


def _name_shards(batches):
    """Blobs of anchors to marks and open anchors."""
    queue, marks = DiskQueue(NAMED), Marks()
    for batch in batches:
        for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if kind:
                marks.add(unpack(blob, MARK))
            else:
                rows = unpack(blob, ANCHOR)
                queue.push(_keyed(NAMED, _key(rows["h"], rows["ctx"], rows["doc"], rows["tag"], rows["pos"]), rows))
    for rest in named(queue, marks):
        yield _found(np.empty(0, MARK), rest)
    for block in marks.blocks():
        yield _found(block)


def _slices(row: tuple, context: bytes):
    """The parts of a hot anchor's context by place in the window: those between d0 and d1 bytes left of the anchor have the bytes around it in common that all of them hold, which name the part."""
    h, _, doc, tag, pos, dlo, dhi = row
    step = -(-SPAN // SLICES)
    for d0 in range(0, SPAN, step):
        d1 = min(d0 + step, SPAN) - 1
        lo, hi = min(dlo, d1), max(dhi, d0)
        if lo >= hi:
            name = xxhash.xxh3_64_intdigest(context[dlo - d0 : dlo - d1 + LENGTH], d0)
            yield (name, 0, doc, tag, pos, lo, hi), context[dlo - lo : dlo - hi + LENGTH]


def _send_contexts(shards: int, hot: set[int]):
    """Texts with their open anchors to blobs of contexts, dealt to shards."""

    def flush(found):
        rows, texts = np.array([r for r, _ in found], ANCHOR), [t for _, t in found]
        shard = rows["h"] % np.uint64(shards)
        out = []
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            for i in range(0, len(at), 20_000):
                part = at[i : i + 20_000]
                out.append((int(s), zstandard.ZstdCompressor(level=1).compress(np.uint64(len(part)).tobytes() + rows[part].tobytes() + b"".join(texts[k] for k in part.tolist()))))
        return _batch(out, ("shard", "blob"))

    def run(batches):
        found = []
        for batch in batches:
            for doc, tag, raw, rest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for x in rest:
                    row = (x["h"] % (1 << 64), 0, doc, tag, x["start"], x["dlo"], x["dhi"])
                    context = raw[x["start"] - x["dlo"] : x["start"] - x["dhi"] + LENGTH]
                    if x["h"] in hot:
                        found += _slices(row, context)
                    else:
                        found.append((row, context))
                    if len(found) >= GATHER // 8:
                        yield flush(found)
                        found = []
        if found:
            yield flush(found)

    return run


def at_anchors(rows: np.ndarray, contexts: bytes) -> np.ndarray:
    """Records of the suffixes that begin at these anchors. contexts: one after the other, dlo - dhi + LENGTH bytes each."""
    text = np.frombuffer(contexts, np.uint8)
    dlo, dhi = rows["dlo"].astype(np.int64), rows["dhi"].astype(np.int64)
    at = np.cumsum(dlo - dhi + LENGTH) - (dlo - dhi + LENGTH) + dlo  # of the anchor itself
    out = np.zeros(len(rows), FIRST)
    right = np.zeros((len(rows), RIGHT), np.uint8)
    for k in range(LENGTH):
        has = np.flatnonzero(LENGTH - dhi > k)
        right[has, k] = text[at[has] + k]
    right[:, LENGTH] = LENGTH - dhi
    for k in range(SPAN - 1):
        has = np.flatnonzero(dlo > k)
        out["left"][has, k] = text[at[has] - k - 1]
    out["key"], out["group"] = _key(rows["h"], right), rows["h"]
    for k in ("dlo", "doc", "tag", "pos"):
        out[k] = rows[k]
    return out


def _with_prefixes(blocks):
    """The blocks with the common prefix of each record with the one before it, 0 where the anchor is another."""
    before = np.zeros((0, 8 + RIGHT), np.uint8)
    for block in blocks:
        block = block.copy()
        key = np.concatenate((before, np.ascontiguousarray(block["key"]).view(np.uint8).reshape(len(block), -1)))
        diff = key[1:, : 8 + LENGTH] != key[:-1, : 8 + LENGTH]
        shared = np.where(diff.any(axis=1), diff.argmax(axis=1), 8 + LENGTH).astype(np.int64) - 8
        lcp = np.clip(np.minimum(shared, np.minimum(key[1:, -1], key[:-1, -1])), 0, None)
        block["lcp"] = lcp if len(before) else np.r_[0, lcp]
        before = key[-1:]
        yield block


class Runs:
    """Neighbours with LENGTH bytes in common, block by block: marks for all but the earliest of them."""

    def __init__(self, marks: Marks):
        self.marks, self.open = marks, np.empty(0, SUFFIX)

    def add(self, block: np.ndarray, lcp: np.ndarray, d: int) -> None:
        """The records of a block in order. What the last block ended with is its earliest so far and stands before them."""
        carried = len(self.open)
        names = ["doc", "tag", "pos"]
        rows = np.concatenate((self.open[names], block[names]))
        begin = np.r_[np.ones(carried, bool), lcp < LENGTH]
        begin[0] = True
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((rows["pos"], rows["tag"], rows["doc"]))] = np.arange(len(rows))
        run, starts = np.cumsum(begin) - 1, np.flatnonzero(begin)
        by_rank = np.empty(len(rows), np.int64)
        by_rank[rank] = np.arange(len(rows))
        first = by_rank[np.minimum.reduceat(rank, starts)]
        lead = rows[first][run]
        hit = (rows["doc"] != lead["doc"]) | (rows["tag"] != lead["tag"]) | (rows["pos"] != lead["pos"])
        if hit.any():
            start = rows["pos"][hit].astype(np.int64) - d
            self.marks.add(marks_of(rows[hit], start, start + LENGTH))
        self.open = rows[first[-1:]]


def induce(blocks, d: int, marks: Marks) -> DiskQueue:
    """One level: the records of suffixes that begin d bytes before their anchors, in order, to the queue of those one byte further left."""
    out, runs = DiskQueue(SUFFIX), Runs(marks)
    group, least = None, np.full(256, -1, np.int64)  # of the last anchor so far: the least prefix since each byte was pushed, -1 if it wasn't
    block, ahead, at = None, None, 0
    stream = iter(blocks)
    block = next(stream, None)
    while block is not None:
        ahead = next(stream, None)
        lcp = block["lcp"].astype(np.int64)
        runs.add(block, lcp, d)
        # who can still have an equal window further left: enough bytes there, and enough in common with a neighbour
        after = np.r_[lcp[1:], 0 if ahead is None else int(ahead["lcp"][0])]
        keep = np.flatnonzero((block["dlo"] > d) & (np.maximum(lcp, after) + block["dlo"] - d >= LENGTH))
        kept = block[keep]
        byte, mine = kept["left"][:, d].astype(np.int64), kept["group"]
        to = np.lexsort((byte, mine))
        same = (mine[to[1:]] == mine[to[:-1]]) & (byte[to[1:]] == byte[to[:-1]])
        prefix = np.zeros(len(keep), np.int64)
        if same.any():
            pairs = np.stack((keep[to[:-1][same]] + 1, keep[to[1:][same]] + 1), 1).ravel()
            prefix[to[1:][same]] = np.minimum.reduceat(np.r_[lcp, 0], pairs)[::2] + 1
        if group is not None and len(keep):
            first = to[np.r_[True, ~same]]
            first = first[mine[first] == group]
            first = first[least[byte[first]] >= 0]
            prefix[first] = np.minimum(least[byte[first]], np.minimum.accumulate(lcp)[keep[first]]) + 1
        # what the next block needs to know of the last anchor
        last = int(block["group"][-1])
        if last == group:
            least = np.where(least >= 0, np.minimum(least, lcp.min()), -1)
        else:
            group, least = last, np.full(256, -1, np.int64)
        own = np.flatnonzero(mine == np.uint64(last))
        since = np.r_[np.minimum.accumulate(lcp[::-1])[::-1][1:], 255]
        least[byte[own]] = since[keep[own]]  # of equal bytes the last assignment stands
        if len(keep):
            new = np.empty(len(kept), SUFFIX)
            for k in ("group", "dlo", "doc", "tag", "pos", "left"):
                new[k] = kept[k]
            new["lcp"] = prefix
            new["key"] = _key(mine, byte.astype(np.uint8), np.arange(at, at + len(keep), dtype=np.uint64))
            out.push(new)
            at += len(keep)
        block = ahead
    return out


def equal_windows(queue: DiskQueue, marks: Marks) -> None:
    """Marks of the windows of these anchors (records of at_anchors) that an earlier one of them has too."""
    blocks = _with_prefixes(queue.blocks())
    for d in range(SPAN - 1):
        after = induce(blocks, d, marks)
        if after.pushed < 2:
            return
        blocks = after.blocks()
    runs = Runs(marks)
    for block in blocks:
        runs.add(block, block["lcp"].astype(np.int64), SPAN - 1)


def _sort_shards(batches):
    queue, marks = DiskQueue(FIRST), Marks()
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw, np.uint64, 1)[0])
            queue.push(at_anchors(np.frombuffer(raw, ANCHOR, n, 8), raw[8 + n * ANCHOR.itemsize :]))
    equal_windows(queue, marks)
    for block in marks.blocks():
        yield _found(block)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as (doc_id, text binary, row struct of all columns but the text, marks array of (start, end)); marks overlap and have no order.

    Earlier is: a smaller id, then, among rows that share an id, a smaller crc32 of the text; rows that share both are one document
    and aren't earlier than each other. Rows without an id come last. Null text: empty. Texts shorter than LENGTH lose nothing.
    """
    spark = small_batches(df).sparkSession
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.crc32(text).alias("tag"), text.alias("text"), F.struct(F.lit(0).alias("_"), *[c for c in df.columns if c != text_col]).alias("row"))
    sent = docs.where(F.length("text") >= LENGTH).select("doc", "tag", "text").mapInArrow(lean(_send_anchors(shards)), "shard int, kind int, blob binary")
    found = cut(sent.repartition("shard").select("kind", "blob").mapInArrow(lean(_name_shards), FOUND), "anchors")
    counts = found.where("h is not null").groupBy("h").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = {r.h for r in counts.where(F.col("n") > max(LEAST_HOT, total // HOT_KEYS)).select("h").collect()}
    rest = found.where("h is not null").groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "start", "dlo", "dhi")).alias("rest"))
    open_ = docs.join(rest, ["doc", "tag"], "left").where("rest is not null").select("doc", "tag", "text", "rest")
    more = open_.mapInArrow(lean(_send_contexts(shards, hot)), "shard int, blob binary").repartition("shard").select("blob").mapInArrow(lean(_sort_shards), FOUND)
    marks = found.where("h is null").unionByName(more).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    return docs.join(marks, ["doc", "tag"], "left").select("doc", "text", "row", "marks")


def merged(marks) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in marks or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[at[i] : at[i + 1]] for i in range(0, len(at), 2))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a row."""

    def run(batches):
        for batch in batches:
            out = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = merged(marks)
                kept = without(text, runs)
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            if out:
                n, removed, k, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(k, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = spans(df.select(id_col, text_col), id_col, text_col).select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), "text", "marks")
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the repeated bytes cut from its texts (a character cut in part goes as a whole); all other columns stay."""

    def run(batches):
        for batch in batches:
            kept = [without(t, merged(m)).decode("utf-8", "ignore") for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["row", "kept"])

    rows = spans(df, id_col, text_col).select("row", "text", "marks")
    out = rows.mapInArrow(lean(run), T.StructType([rows.schema["row"], T.StructField("kept", T.StringType())]))
    return out.select(*[F.col("kept").alias(text_col) if c == text_col else F.col(f"row.{c}").alias(c) for c in df.columns])
