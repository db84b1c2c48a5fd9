"""Evaluation texts leaking into training text: winnowed fingerprints, joined and extended.

Of every ``window`` consecutive hashes of k-word runs the least is kept, on both sides, so each shared span of at least
k + window - 1 words has a kept hash in common.  The fingerprints (hash, text, position) of documents and items are joined on the hash;
each common one is a hit, which is extended word by word in both directions; a document and an item are reported once an extended
span has ``least`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import shingles, word_hashes
from webloom.plans.workspace import size_of, staged

BROADCAST_BYTES = 32 << 20


def winnowed(words: np.ndarray, counts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of all texts, with the position in ``words`` at which the run begins.  Texts of fewer runs than the window keep their least."""
    runs, per = shingles(words, counts, k)
    if not len(runs):
        return runs, np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), per)
    begin = np.arange(len(runs)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(np.cumsum(counts) - counts, per)
    keep = np.zeros(len(runs), bool)
    first = np.cumsum(per) - per
    short = np.flatnonzero((per > 0) & (per < window))
    for i in short:
        keep[first[i] + int(np.argmin(runs[first[i] : first[i] + per[i]]))] = True
    if len(runs) >= window:
        views = np.lib.stride_tricks.sliding_window_view(runs, window)
        whole = np.flatnonzero(owner[: len(views)] == owner[window - 1 :])
        for at in range(0, len(whole), 1 << 18):
            w = whole[at : at + (1 << 18)]
            keep[w + np.argmin(views[w], axis=1)] = True
    return runs[keep], begin[keep]


def leaks(df: DataFrame, ident: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 12, k: int = 5) -> DataFrame:
    """Pairs (ident, item) of documents and items that share at least ``least`` consecutive words, each once.

    Words are longest runs of letters and digits after lower-casing and dropping accents.  Null idents and texts on either side
    are left out, texts of fewer words than ``least`` can't match, repeated rows count once; an empty side gives no rows.

    The items' fingerprints are broadcast if they take ``BROADCAST_BYTES`` at most; if not, both sides are shuffled by hash.  Only the
    texts of documents and items with a common fingerprint are read again, to extend their hits.
    """
    window = least - k + 1
    if window < 1:
        raise ValueError("least must be at least k")
    docs = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    tests = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("item_text")).distinct()
    idtype, itemtype = docs.schema["ident"].dataType.simpleString(), tests.schema["item"].dataType.simpleString()

    def prints(name: str, column: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                words, counts = word_hashes(b[column].tolist(), accents=False)
                kept, at = winnowed(words, counts, k, window)
                ends = np.cumsum(counts)
                of = np.searchsorted(ends, at, "right")
                cuts = np.searchsorted(of, np.arange(len(b) + 1))
                at = (at - (ends - counts)[of]).astype(np.int32)
                kept = kept.view(np.int64)
                yield pd.DataFrame({name: b[name].values, "hash": [kept[x:y] for x, y in zip(cuts, cuts[1:])], "at": [at[x:y] for x, y in zip(cuts, cuts[1:])]})

        return run

    def spread(prints: DataFrame, name: str, at: str) -> DataFrame:
        return prints.select(name, F.explode(F.arrays_zip("hash", "at")).alias("x")).select(name, F.col("x.hash").alias("hash"), F.col("x.at").alias(at))

    small = lambda x: F.broadcast(x) if size_of(x) <= BROADCAST_BYTES else x
    known = staged(spread(tests.mapInPandas(prints("item", "item_text"), f"item {itemtype}, hash array<long>, at array<int>"), "item", "iat").distinct(), "item-prints")
    hits = spread(docs.mapInPandas(prints("ident", "text"), f"ident {idtype}, hash array<long>, at array<int>"), "ident", "dat").join(small(known), "hash")
    hits = staged(hits.groupBy("ident", "item").agg(F.collect_set(F.struct("dat", "iat")).alias("hits")), "hits")
    asked = staged(hits.select("ident").distinct(), "documents-hit")
    texts = docs.join(small(asked), "ident", "left_semi").distinct()
    both = hits.join(texts, "ident").join(tests, "item")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dwords, dcounts = word_hashes(b["text"].tolist(), accents=False)
            iwords, icounts = word_hashes(b["item_text"].tolist(), accents=False)
            n = np.array([len(x) for x in b["hits"]], np.int64)
            row = np.repeat(np.arange(len(b)), n)
            d0, d1 = (np.cumsum(dcounts) - dcounts)[row], np.cumsum(dcounts)[row]
            i0, i1 = (np.cumsum(icounts) - icounts)[row], np.cumsum(icounts)[row]
            d = d0 + np.array([h["dat"] for x in b["hits"] for h in x], np.int64)
            i = i0 + np.array([h["iat"] for x in b["hits"] for h in x], np.int64)
            span = np.zeros(len(d), np.int64)
            for step, j in ((1, 0), (-1, 1)):
                alive = np.arange(len(d))
                while len(alive) and j <= least:
                    x, y = d[alive] + step * j, i[alive] + step * j
                    ok = (x >= d0[alive]) & (x < d1[alive]) & (y >= i0[alive]) & (y < i1[alive])
                    alive, x, y = alive[ok], x[ok], y[ok]
                    alive = alive[dwords[x] == iwords[y]]
                    span[alive] += 1
                    j += 1
            good = np.unique(row[span >= least])
            yield pd.DataFrame({"ident": b["ident"].values[good], "item": b["item"].values[good]})

    found = both.mapInPandas(extend, f"ident {idtype}, item {itemtype}")
    return found.distinct().select(F.col("ident").alias(ident), F.col("item").alias(item))
