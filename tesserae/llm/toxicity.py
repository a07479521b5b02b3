"""Toxicity by compression distance: windows of a text are compressed with a zstandard dictionary trained on ordinary text and
with ones that also hold what toxic texts add; what each of those saves, window by window, is the evidence.

A toxic dictionary holds the stretches of words whose byte grams are likelier in toxic documents, the likeliest last, where they are
nearest to the text. There is one for each tier of likelihood ratios: a marker that ordinary texts have too, as those of a language
with few labelled rows do, goes into a weaker tier, and the calibration weighs the tiers. The fit, on the driver, sees a bounded sample of
labelled rows: MAX_TOXIC and MAX_ORDINARY rows of up to FIT_BYTES each, half for the dictionaries and half for the calibration.
Scoring covers every whole text. Matches are six bytes or longer, so that chance matches in either dictionary save nothing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_rows, small_batches, texts_of

#: Bounds of the fitting sample.
MAX_TOXIC, MAX_ORDINARY, FIT_BYTES = 2400, 6000, 32_000
WINDOW = 256
ORDINARY_BYTES, TOXIC_BYTES = 1024, 4096
GRAM, MATCH = 5, 6
#: A gram counts as toxic if it is in so many toxic documents at least, as a share; a tier has those that are more than so many times likelier there.
LEAST_SHARE, TIERS = 0.01, (12.0, 5.0, 2.5)
FEATURES = 4 * len(TIERS)
#: A word stretch goes into a dictionary if so many toxic documents have it, as a share.
SAMPLE_SHARE = 0.006


@dataclass
class Model:
    ordinary: bytes
    toxic: tuple[bytes, ...]  # one a tier
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the constant first


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=MATCH, window_log=15, hash_log=12, chain_log=12, search_log=4, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.plain, self.both = model, compressor(model.ordinary), [compressor(t + model.ordinary) for t in model.toxic]

    def features(self, text: bytes) -> list[float]:
        """For each tier, bytes that its dictionary saves: mean over windows, most, mean of the three most, share of windows with three or more."""
        raw = text.decode("utf-8", "replace").lower().encode()
        windows = [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]
        if not windows:
            return [0.0] * FEATURES
        plain, out = [len(self.plain.compress(w)) for w in windows], []
        for both in self.both:
            saved = sorted((n - len(both.compress(w)) for n, w in zip(plain, windows, strict=True)), reverse=True)
            top = saved[:3]
            out += [sum(saved) / len(saved), float(saved[0]), sum(top) / len(top), sum(x >= 3 for x in saved) / len(saved)]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.both:
            return probability(np.zeros((len(texts), FEATURES)), self.model)
        return probability(np.array([self.features(t) for t in texts]).reshape(-1, FEATURES), self.model)


def probability(x: np.ndarray, m: Model) -> np.ndarray:
    z = m.weights[0] + ((x - m.mean) / m.scale) @ m.weights[1:]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _grams(text: bytes) -> set[bytes]:
    out: set[bytes] = set()
    for w in set(text.split()):
        w = b" " + w + b" "
        out.update(w[i : i + GRAM] for i in range(len(w) - GRAM + 1))
    return out


def _stretches(text: bytes, good):
    for w in text.split():
        w = b" " + w + b" "
        start, end = 0, -1
        for i in range(len(w) - GRAM + 1):
            if w[i : i + GRAM] in good:
                if end < i:
                    if end > 0:
                        yield w[start:end]
                    start = i
                end = i + GRAM
        if end > 0:
            yield w[start:end]


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary's bytes; too few samples for the trainer stand for themselves."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _tier(texts: list[bytes], ratio: dict[bytes, float]) -> bytes:
    """The stretches that these grams make, likeliest last, up to TOXIC_BYTES; ratio has the tier's grams."""
    seen = Counter(x for t in texts for x in set(_stretches(t, ratio.keys())) if len(x) >= MATCH)
    least = max(2, SAMPLE_SHARE * len(texts))
    best = {x: max(ratio.get(x[i : i + GRAM], 0.0) for i in range(len(x) - GRAM + 1)) for x, n in seen.items() if n >= least}
    out = b""
    for x in sorted(best, key=lambda x: (-best[x], x)):
        if x not in out and len(out) + len(x) <= TOXIC_BYTES:
            out = x + out
    return out


def fit(toxic: list[bytes], ordinary: list[bytes], odds: float | None = None) -> Model:
    """odds: toxic to ordinary among all labelled rows, for the constant; None: as in the samples. Without texts of both kinds every score is the share of toxic ones."""
    low = lambda ts: [t.decode("utf-8", "replace").lower().encode() for t in ts]
    toxic, ordinary = low(toxic), low(ordinary)
    if not toxic or not ordinary:
        flat = 20.0 if toxic else -20.0
        return Model(b"", (), np.zeros(FEATURES), np.ones(FEATURES), np.r_[flat, np.zeros(FEATURES)])
    half = lambda xs: (xs[: (len(xs) + 1) // 2], xs[(len(xs) + 1) // 2 :] or xs)
    (t1, t2), (o1, o2) = half(toxic), half(ordinary)
    in_t, in_o = Counter(), Counter()
    for t in t1:
        in_t.update(_grams(t))
    for t in o1:
        in_o.update(_grams(t))
    ratio = {g: n / len(t1) / ((in_o[g] + 0.5) / len(o1)) for g, n in in_t.items() if n >= max(2, LEAST_SHARE * len(t1))}
    tiers = tuple(_tier(t1, {g: r for g, r in ratio.items() if low < r <= high}) for low, high in zip(TIERS, (np.inf, *TIERS), strict=False))
    model = Model(_train([t[i : i + WINDOW] for t in o1 for i in range(0, len(t), WINDOW)], ORDINARY_BYTES, 64, 8), tiers, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    s = Scorer(model)
    x = np.array([s.features(t) for t in t2 + o2])
    y = np.r_[np.ones(len(t2)), np.zeros(len(o2))]
    odds = len(toxic) / len(ordinary) if odds is None else odds
    w = np.where(y == 1, odds * len(o2) / len(t2), 1.0)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = logistic((x - model.mean) / model.scale, y, w)
    return model


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a ridge on all but the constant."""
    x = np.c_[np.ones(len(x)), x]
    beta, pull = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (w * (y - p)) - pull * beta
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(pull + 1e-9), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit_from(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> Model:
    """The model from labelled rows that are not held out (crc32 of the id as text, mod 4, is 2). The sampled ids, MAX_TOXIC + MAX_ORDINARY at most, are broadcast into one scan of the texts."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    if held_out:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    by = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    take = lambda kind, n: rows.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = take(1, MAX_TOXIC).unionByName(take(0, MAX_ORDINARY))
    # one text for each id and label, so what comes to the driver is bounded: (MAX_TOXIC + MAX_ORDINARY) * FIT_BYTES, 269 MB at the very most
    texts = texts_of(docs).where(F.length("text").between(1, FIT_BYTES)).join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted(((r.doc_id, r.toxic, bytes(r.text)) for r in texts.collect()), key=lambda r: (hash_order(r[0]), r))
    odds = by[1] / by[0] if by.get(0) and by.get(1) else None
    return fit([t for _, k, t in found if k], [t for _, k, t in found if not k], odds)


def hash_order(i: int) -> int:
    """A fixed shuffle of ids, so that both halves of the sample are alike."""
    return (i * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 20


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row a row, over whole texts. Null and empty texts get the score of no evidence; repeated rows score alike."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        s = Scorer(held.value)

        def step(cols):
            p = s.scores(cols["text"].to_pylist())
            return {"doc_id": cols["doc_id"], "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

        return step

    return map_rows(texts_of(docs, id_col, text_col), make, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay. One pass: the verdict joins nothing back."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        s = Scorer(held.value)
        at = schema.names.index("text")
        for batch in batches:
            if batch.num_rows:
                p = s.scores([(t or "").encode() for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(p < threshold))

    return small_batches(docs).mapInArrow(run, schema)
