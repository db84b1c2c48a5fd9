"""Filling containers of fixed capacity with whole texts.

The plan depends only on how many pieces there are of each size, so it is made on the driver from a histogram of at most
``capacity`` rows, whatever the number of texts: pieces above a third of the capacity are matched greedily, two at most in a
container (the largest with the largest that fits beside it); smaller ones, largest first, go to the container with the least room
that suffices; what fits nowhere opens new containers.  Steps are made for all pieces of a size and all containers of a room at once,
as runs: "the pieces of size s ranked i to j go to containers c, c+1, ...".  Each piece then finds its container by its rank among the
pieces of its size, which comes from prefix sums over partitions, not from a global sort.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.workspace import staged

# Fixed value: the published word pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, ranks, first container) that place every piece of the histogram, and the number of containers."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    placed = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    rooms: list[tuple[int, int, int]] = []  # (room, first container, containers), sorted
    used = 0

    def put(size: int, n: int, container: int) -> None:
        runs.append((size, placed[size], n, container))
        placed[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            k = bisect_left(large, min(size, capacity - size) + 1) - 1
            while k >= 0 and (left[large[k]] < (2 if large[k] == size else 1)):
                k -= 1
            mate = large[k] if k >= 0 else None
            n = left[size] if mate is None else left[size] // 2 if mate == size else min(left[size], left[mate])
            put(size, n, used)
            if mate is not None:
                put(mate, n, used)
            room = capacity - size - (mate or 0)
            if room:
                insort(rooms, (room, used, n))
            used += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect_left(rooms, (size, -1, 0))
            if k == len(rooms):
                n = -(-left[size] // (capacity // size))
                room, first = capacity, used
                used += n
            else:
                room, first, n = rooms.pop(k)
            take = min(n, left[size])
            put(size, take, first)
            if room > size:
                insort(rooms, (room - size, first, take))
            if take < n:
                insort(rooms, (room, first + take, n - take))
    return runs, used


def packed(df: DataFrame, ident: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces and their containers: columns ident, piece (INT, from 0), tokens (INT), container (BIGINT).

    A text of at most ``capacity`` tokens is one piece; a longer one is cut into pieces of ``capacity`` tokens and a last one of
    what is left.  Null and empty texts have no tokens: they get one row with 0 tokens and no container.  Repeated rows are packed
    each for itself; rows with a null ident too; an empty table gives no rows.  vocabulary: a file of a public tokenizer (a token in base
    64 and its rank a line) that the driver can read; it goes to the tasks by broadcast.
    """
    spark = df.sparkSession
    texts = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    idtype = texts.schema["ident"].dataType.simpleString()

    if not 0 < capacity < 2**19:
        raise ValueError("capacity: 1 to 524287")
    with open(vocabulary, "rb") as f:  # read where the job is made; tasks need no file
        words = spark.sparkContext.broadcast(f.read())

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, words.value.splitlines())}
        tok = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            total = np.array([len(tok.encode_ordinary(t)) if t else 0 for t in b["text"]], np.int64)
            pieces = np.maximum(-(-total // capacity), 1)
            row = np.repeat(np.arange(len(b)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(total[row] - piece * capacity, capacity)
            seq = seen[size] + pd.Series(size).groupby(size).cumcount().to_numpy() if len(size) else size
            seen += np.bincount(size, minlength=capacity + 1)
            yield pd.DataFrame({"ident": b["ident"].values[row], "piece": piece.astype(np.int32), "tokens": size.astype(np.int32), "part": part, "seq": seq})

    pieces = staged(texts.mapInPandas(measure, f"ident {idtype}, piece int, tokens int, part int, seq long"), "pieces")
    counts = pieces.where("tokens > 0").groupBy("tokens", "part").agg(F.count("*").alias("n"))
    runs, _ = plan({r["tokens"]: r["n"] for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}, capacity)
    runs.sort()
    sent = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 4)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("tokens", "part", before.alias("before")), ["tokens", "part"], "left").select("ident", "piece", "tokens", (F.col("before") + F.col("seq")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, first, _, container = sent.value
        key = size * np.int64(2) ** 44 + first  # 2^44 pieces of one size are more than 16 TB of tokens
        for b in batches:
            at = np.full(len(b), -1, np.int64)
            has = b["rank"].notna().to_numpy()
            if has.any():
                rank, tokens = b["rank"].to_numpy()[has].astype(np.int64), b["tokens"].to_numpy()[has].astype(np.int64)
                k = np.searchsorted(key, tokens * np.int64(2) ** 44 + rank, "right") - 1
                at[has] = container[k] + rank - first[k]
            yield pd.DataFrame({"ident": b["ident"], "piece": b["piece"], "tokens": b["tokens"], "container": pd.Series(at, dtype="Int64").where(at >= 0)})

    return ranked.mapInPandas(place, f"ident {idtype}, piece int, tokens int, container long").withColumnRenamed("ident", ident)
