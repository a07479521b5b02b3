"""Quality rules by document and by host.

A pass over each text counts what the rules need. Failures of each rule are then summed by host, each host's rate is shrunk towards
that of all hosts by a beta prior fitted to them (empirical Bayes, method of moments), a host is refused where the rate of a rule is
too high, and the verdict comes back to its documents. Only the base rules refuse a document by itself: the others, symbols and
repeated lines, are too common in single good documents and tell something of hosts that fail them throughout.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, map_rows, small_batches

SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: A host is refused where its shrunk failure rate is over this; one with few documents stays near the rate of all hosts.
HOST_RATE = 0.5
#: The least and most documents that a prior counts for.
PRIOR = (2.0, 1e6)
SALTS = 64
#: Refused hosts that are broadcast, once counted; more go by a salted join.
BROADCAST_HOSTS = 10_000


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's UTF-8 bytes."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words))
    if not text.isascii():
        joined = np.frombuffer(b"".join(words), dtype=np.uint8)
        chars = int(np.count_nonzero((joined & 0xC0) != 0x80))
    seen: set[bytes] = set()
    dup = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line and not line.isspace():
                seen.add(line)
    return n, chars, len(SYMBOLS.findall(text)), dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i : i + 3] = b"\1\1\1"
            hit[j : j + 3] = b"\1\1\1"
    return sum(hit)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. Null text: no words; null host: the host ''."""
    host = F.col(host) if isinstance(host, str) else host
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def step(cols):
            found = np.array([counts(t) for t in cols["text"].to_pylist()], dtype=np.int64)
            return {"doc_id": cols["doc_id"], "host": cols["host"]} | {k: pa.array(found[:, i]) for i, k in enumerate(names)}

        return step

    out = map_rows(rows, make, "doc_id long, host string, " + ", ".join(f"{k} long" for k in names))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


#: Failures that are summed by host, as conditions on a row of measures: the base rules, a symbol for ten words, a repeated line for twenty.
RULES = {"base": "base_failed", "symbols": "10 * n_symbols > n_words", "dup_lines": "20 * n_dup_lines > n_words"}


def host_verdicts(measured: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """host, docs, failed (of the base rules), a rate_ for each of RULES, shrunk_rate (the highest), host_ok.

    For each rule the prior's mean m is the failure rate of all documents; its weight comes from how much more host rates vary about
    m than chance lets them.
    """
    k = lambda r: F.col(f"failed_{r}")
    partial = measured.groupBy("host", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("docs"), *[F.count_if(F.expr(x)).alias(f"failed_{r}") for r, x in RULES.items()])
    hosts = partial.groupBy("host").agg(F.sum("docs").alias("docs"), *[F.sum(k(r)).alias(f"failed_{r}") for r in RULES])
    n = F.col("n")
    whole = hosts.agg(F.sum("docs").cast("double").alias("n"), F.count("*").cast("double").alias("h"), *[F.sum(k(r)).cast("double").alias(f"k_{r}") for r in RULES])
    whole = whole.select("h", "n", *[F.when(n > 0, F.col(f"k_{r}") / n).otherwise(0.0).alias(f"m_{r}") for r in RULES])
    off = lambda r: k(r) / F.col("docs") - F.col(f"m_{r}")
    spread = hosts.join(F.broadcast(whole)).agg(F.sum(F.col("docs").cast("double") * F.col("docs")).alias("n2"), *[F.sum(F.col("docs") * off(r) * off(r)).alias(f"s_{r}") for r in RULES])
    prior = whole.join(F.broadcast(spread)).select(*[x for r in RULES for x in (F.col(f"m_{r}"), prior_weight(F.col("h"), n, F.col(f"m_{r}"), F.col(f"s_{r}"), F.col("n2")).alias(f"w_{r}"))])
    rates = {r: (k(r) + F.col(f"m_{r}") * F.col(f"w_{r}")) / (F.col("docs") + F.col(f"w_{r}")) for r in RULES}
    rows = hosts.join(F.broadcast(prior)).select("host", "docs", k("base").alias("failed"), *[x.alias(f"rate_{r}") for r, x in rates.items()])
    return rows.withColumn("shrunk_rate", F.greatest(*[F.col(f"rate_{r}") for r in RULES])).withColumn("host_ok", F.col("shrunk_rate") <= host_rate)


def prior_weight(h: Column, n: Column, m: Column, s: Column, n2: Column) -> Column:
    """Documents the prior counts for: m(1-m)/v - 1 with v the variance between hosts, s = sum n_h (p_h - m)^2, n2 = sum n_h^2."""
    v = (s - (h - 1) * m * (1 - m)) / F.when(n - n2 / n > 0, n - n2 / n).otherwise(1.0)
    return F.when((h < 2) | (v <= 0) | (m <= 0) | (m >= 1), F.lit(PRIOR[1])).otherwise(F.greatest(F.lit(PRIOR[0]), F.least(F.lit(PRIOR[1]), m * (1 - m) / F.when(v > 0, v).otherwise(1.0) - 1)))


def quality_rules(measured: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """measured plus kept: false where the document itself fails or its host is refused.

    A few rows a host; the join salts both sides, so a host with a third of the rows is dealt over SALTS tasks. Every measured row
    comes back, repeated ones and those with a null id too.
    """
    verdict = host_verdicts(measured, host_rate).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return rows.join(verdict.select("host", "salt", "host_ok", "shrunk_rate"), ["host", "salt"], "left").withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("salt")


def filter_rows(docs: DataFrame, refused_hosts: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs without rows that fail the document rules or are of a refused host (column host); all columns stay. Documents go in one pass; refused hosts are counted, and broadcast if they are few."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                n, _, _, _, repeated = counts((t or "").encode())
                keep.append(n >= 50 and 100 * repeated <= 50 * n)
            if keep:
                yield batch.filter(pa.array(keep))

    passed = small_batches(docs).mapInArrow(run, docs.schema)
    refused_hosts = cut(refused_hosts, "refused")
    host = F.coalesce(passed[host_col], F.lit(""))
    if refused_hosts.count() <= BROADCAST_HOSTS:
        return passed.join(F.broadcast(refused_hosts), host == refused_hosts["host"], "left_anti").select(*docs.columns)
    salted = refused_hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return passed.join(salted, (host == salted["host"]) & (F.pmod(F.xxhash64(passed[text_col]), F.lit(SALTS)) == salted["_salt"]), "left_anti").select(*docs.columns)
