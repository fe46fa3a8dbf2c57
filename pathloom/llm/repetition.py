"""How much of a text repeats what the same text said before.

A text is reduced to its letters and digits in lower case; a character is repeated if it lies in a stretch of
``span`` characters that also starts at an earlier place. The exact share comes from rolling hashes of all
stretches (every repeat is then compared character by character).

Where only texts above a share are wanted, a short-circuit cascade runs first. Each rule rejects only texts that
cannot reach the share, so the result is exact in any order: a stretch of ``span`` repeated characters contains
``span - g + 1`` g-grams that are no first occurrences, so a text with too few such g-grams is out. The number
of distinct g-grams is bounded from below by the bits set in a hashed bitmap, without sorting. Cost and
selectivity of the rules are measured by every task on a sample, its first ``SAMPLE_DOCS`` whole texts, and the rules
are then ordered by rejections per cost among what the rules before them leave over; nothing is read twice.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.tokenizer import spread

SPAN = 40
SAMPLE_DOCS = 100  # texts on which a task measures the rules
_OTHER = re.compile(r"[\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def reduce_text(text: str | None) -> str:
    return _OTHER.sub("", text.lower()) if text else ""


def _codes(s: str) -> np.ndarray:
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    c = (c + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return c ^ (c >> np.uint64(32))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_B), k, 1 << 64))


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of ``k`` characters, from stretches of powers of two."""
    h, size, done, out = codes, 1, 0, None
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                n = len(codes) - k + 1
                piece = h[done : done + n]
                out = piece.copy() if out is None else out * _power(size) + piece
                done += size
            if size * 2 > k:
                return out
            h = h[:-size] * _power(size) + h[size:]
            size *= 2


def repeated_share(s: str, span: int = SPAN) -> float:
    """The exact share of repeated characters of a reduced text."""
    n = len(s)
    if n <= span:
        return 0.0
    codes = _codes(s)
    h = grams(codes, span)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    first = np.empty(len(h), "int64")
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.flatnonzero(first < np.arange(len(h)))
    for k in range(span):  # the hash is only a hint
        again = again[codes[again + k] == codes[first[again] + k]]
    if not len(again):
        return 0.0
    edge = np.zeros(n + 1, "int64")
    np.add.at(edge, again, 1)
    np.add.at(edge, again + span, -1)
    return float((np.cumsum(edge[:-1]) > 0).sum() / n)


def _too_short(span: int) -> Callable[[str, float], bool]:
    return lambda s, at_least: len(s) <= span


def _few_repeats(g: int, span: int) -> Callable[[str, float], bool]:
    def rule(s: str, at_least: float) -> bool:
        n = len(s)
        if n <= span:
            return True
        h = grams(_codes(s), g)
        bits = 1 << int(np.ceil(np.log2(8 * len(h))))
        seen = np.zeros(bits, bool)
        seen[((h ^ (h >> np.uint64(29))) & np.uint64(bits - 1)).astype("int64")] = True
        return len(h) - int(seen.sum()) < at_least * n * (span - g + 1) / span - 1e-6

    return rule


def rules(span: int = SPAN) -> dict[str, Callable[[str, float], bool]]:
    return {"short": _too_short(span)} | {f"grams_{g}": _few_repeats(g, span) for g in (8, 16, 24) if g < span}


def order_rules(measured: list[list[tuple[float, bool]]], names: list[str]) -> list[str]:
    """Rule names by rejections per second among what the rules before them leave over. ``measured``: for each sampled
    text, (seconds, rejects) of each rule. Rules that reject nothing more are dropped."""
    left, todo, out = measured, dict(enumerate(names)), []
    while left and todo:
        rate = {i: sum(m[i][1] for m in left) / max(sum(m[i][0] for m in left), 1e-9) for i in todo}
        best = max(rate, key=rate.get)
        if rate[best] <= 0:
            break
        out.append(todo.pop(best))
        left = [m for m in left if not m[best][1]]
    return out or names[:1]


class Cascade:
    """The rules, measured on the first texts and then in the order found."""

    def __init__(self, at_least: float, span: int, sample: int = SAMPLE_DOCS):
        self.at_least, self.named, self.sample = at_least, rules(span) if at_least > 0 else {}, sample
        self.measured: list[list[tuple[float, bool]]] = []
        self.order: list[Callable[[str, float], bool]] | None = None

    def rejects(self, s: str) -> bool:
        if not self.named:
            return False
        if self.order is not None:
            return any(rule(s, self.at_least) for rule in self.order)
        verdicts = []
        for rule in self.named.values():
            begun = time.perf_counter()
            hit = bool(rule(s, self.at_least))
            verdicts.append((time.perf_counter() - begun, hit))
        self.measured.append(verdicts)
        if len(self.measured) >= self.sample:
            self.order = [self.named[n] for n in order_rules(self.measured, list(self.named))]
        return any(hit for _, hit in verdicts)


def repetition(docs: DataFrame, at_least: float = 0.0, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``doc_id, n_chars, share``: letters and digits, and the share that repeats earlier text.

    With ``at_least`` > 0 only documents of that share or more are returned, and the cascade spares the others the
    exact count. Null and empty texts have share 0. Whole texts are read, however long.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cascade = Cascade(at_least, span)
        for d in batches:
            out = []
            for i, t in zip(d["doc_id"], d["text"]):
                s = reduce_text(t if isinstance(t, str) else None)
                if cascade.rejects(s):
                    continue
                share = repeated_share(s, span)
                if share >= at_least:
                    out.append((i, len(s), share))
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "share"]).astype({"doc_id": object, "n_chars": "int64", "share": "float64"})

    out = spread(rows).mapInPandas(run, "doc_id string, n_chars long, share double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
