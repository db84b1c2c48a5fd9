"""Near-duplicate records: a binary trie self-join of bit sketches, then an exact check.

Each text becomes a sketch of one-bit minhashes over its word runs, in which two texts of Jaccard similarity J differ in about
(1-J)/2 of the bits.  Sketches are sharded by bands of full minhashes (a band is the root path of the trie that must agree); inside
a shard, and over all shards of a task at once, pairs of trie nodes are walked together, bit by bit; the differing bits add up and
a pair is left as soon as they exceed the budget.  A shard of more than ``block`` members is split into blocks, each pair of
blocks a task of its own, so that no shard is bound to one task and none is capped.

With 24 bands of 3 minhashes, a pair of similarity 0.7 shares a shard with probability 1 - (1 - 0.7^3)^24 = 0.99996, and the
budget of 42 of 128 bits lies 5.6 standard deviations above the 19.2 bits in which such a pair differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import mix, shingles, word_hashes
from webloom.plans.workspace import size_of, staged

BITS, BANDS, ROWS, BUDGET, BLOCK = 128, 24, 3, 42, 20_000
BROADCAST_BYTES = 32 << 20
_SLICE = 1 << 20


def _sketch(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Per text: class key, number of runs, sketch bytes and band keys (null for texts of fewer than k words)."""
    n = max(BITS, BANDS * ROWS)
    rng = np.random.Generator(np.random.PCG64(7))
    mul = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for whole in batches:
        for at in range(0, len(whole), 256):
            b = whole.iloc[at : at + 256]
            texts = b["text"].tolist()
            words, counts = word_hashes(texts)
            ends = np.cumsum(counts)
            keys = [xxhash.xxh3_128_digest(words[e - c : e].tobytes()) if c >= k else b"s" + xxhash.xxh3_128_digest(t) for t, c, e in zip(texts, counts.tolist(), ends.tolist())]
            runs, per = shingles(words, counts, k)
            has = np.flatnonzero(per)
            sketch, bands = [None] * len(b), [None] * len(b)
            if len(has):
                starts = np.concatenate([[0], np.cumsum(per[has])[:-1]])
                least = np.empty((n, len(has)), np.uint64)
                for j in range(n):
                    x = runs * mul[j] + add[j]
                    least[j] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
                bits = np.packbits((mix(least[:BITS]) & np.uint64(1)).astype(np.uint8).T, axis=1)
                band = np.zeros((BANDS, len(has)), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least[r : BANDS * ROWS : ROWS])
                band += np.arange(BANDS, dtype=np.uint64)[:, None]
                band = band.T.astype(np.int64)
                for p, i in enumerate(has):
                    sketch[i], bands[i] = bits[p].tobytes(), band[p]
            yield pd.DataFrame({"ident": b["ident"].values, "key": keys, "runs": per, "sketch": sketch, "bands": bands})


def _product(alo: np.ndarray, an: np.ndarray, blo: np.ndarray, bn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of [alo, alo+an) x [blo, blo+bn), row by row, with the row each comes from."""
    n = an * bn
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, alo[row] + k // bn[row], blo[row] + k % bn[row]


def trie_pairs(shard: np.ndarray, sketch: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i before j, of rows of one shard whose sketches (rows of bytes) differ in at most ``budget`` bits.

    Rows must be sorted by shard and then by sketch: each trie node is then a range of rows.  Node pairs are held in arrays and
    taken from a stack in slices of bounded size, so memory doesn't grow with a shard's number of pairs.
    """
    n, width = sketch.shape
    if n < 2:
        return
    bits = np.unpackbits(sketch, axis=1)
    words = np.ascontiguousarray(np.pad(sketch, ((0, 0), (0, -width % 8)))).view(np.uint64)
    width *= 8
    new = np.concatenate([[True], shard[1:] != shard[:-1]])
    levels = [np.flatnonzero(new)]  # first rows of the nodes of each depth
    for d in range(width):
        new[1:] |= bits[1:, d] != bits[:-1, d]
        levels.append(np.flatnonzero(new))
    roots = np.concatenate([levels[0], [n]])
    many = np.flatnonzero(np.diff(roots) > 1)
    lo, hi = roots[many], roots[many + 1]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        leaf = (ahi - alo == 1) & (bhi - blo == 1) if depth < width else np.ones(len(alo), bool)
        if leaf.any():
            own = leaf & (alo == blo)
            _, i, j = _product(alo[leaf], (ahi - alo)[leaf], blo[leaf], (bhi - blo)[leaf])
            ok = i < j if own.any() else np.ones(len(i), bool)
            i, j = i[ok], j[ok]
            near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= budget
            if near.any():
                yield np.minimum(i, j)[near], np.maximum(i, j)[near]
            if leaf.all():
                continue
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        firsts = np.concatenate([levels[depth + 1], [n]])
        ac, bc = np.searchsorted(firsts, alo), np.searchsorted(firsts, blo)
        an, bn = np.searchsorted(firsts, ahi) - ac, np.searchsorted(firsts, bhi) - bc
        cut = np.searchsorted(np.cumsum(an * bn), _SLICE, "right") + 1
        if cut < len(alo):
            stack.append((depth, alo[cut:], ahi[cut:], blo[cut:], bhi[cut:], err[cut:]))
            alo, blo, ac, an, bc, bn, err = (x[:cut] for x in (alo, blo, ac, an, bc, bn, err))
        row, a, b = _product(ac, an, bc, bn)
        e = err[row] + (bits[firsts[a], depth] ^ bits[firsts[b], depth])
        ok = (e <= budget) & ((alo[row] != blo[row]) | (a <= b))
        ok &= (a != b) | (firsts[a + 1] - firsts[a] > 1)
        a, b, e = a[ok], b[ok], e[ok]
        if len(a):
            stack.append((depth + 1, firsts[a], firsts[a + 1], firsts[b], firsts[b + 1], e))


def _join(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """Candidate pairs of one task: whole shards at a time, those of several batches together."""

    def pairs(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raw = np.frombuffer(b"".join(b["sketch"]), np.uint8).reshape(len(b), -1)
        shard = pd.MultiIndex.from_frame(b[["band", "cell_a", "cell_b"]]).factorize()[0]
        order = np.lexsort((*raw.T[::-1], shard))
        ids, block, across = b["ident"].values[order], b["block"].values[order], (b["cell_a"] != b["cell_b"]).values[order]
        for i, j in trie_pairs(shard[order], raw[order], budget):
            ok = ~across[i] | (block[i] != block[j])
            i, j = i[ok], j[ok]
            yield pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    rest, size = [], 0
    for b in batches:
        if b.empty:
            continue
        rest.append(b)
        size += len(b)
        if size >= 50_000:
            whole = pd.concat(rest)
            tail = (whole[["band", "cell_a", "cell_b"]] == whole[["band", "cell_a", "cell_b"]].iloc[-1]).all(axis=1).values
            yield from pairs(whole[~tail]) if not tail.all() else ()
            rest, size = [whole[tail]], 0
    if rest:
        yield from pairs(pd.concat(rest))


def similar_pairs(df: DataFrame, ident: str, text: str, k: int = 5, least: float = 0.8, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Classes and links of near-duplicate texts.

    Two texts are linked if the Jaccard similarity of their sets of runs of k words is at least ``least`` (0.7 or more, for which the
    bands and the budget are made).  Texts of equal word sequence form a class, named by its least ident; texts of fewer
    than k words have no runs and form classes of identical texts only.  Returns (classes, links): classes has one row per row of df
    with ident and class ``rep``; links has pairs of class names, a < b, with similarity ``jaccard``.  Null idents and null texts are
    left out; repeated rows fall in one class; an empty table gives empty results.
    """
    if not 0.7 <= least <= 1:
        raise ValueError("least: 0.7 to 1")
    rows = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    idtype = rows.schema["ident"].dataType.simpleString()
    sketches = staged(rows.mapInPandas(lambda it: _sketch(it, k), f"ident {idtype}, key binary, runs long, sketch binary, bands array<long>"), "sketches")
    by_key = sketches.groupBy("key").agg(F.min("ident").alias("rep"))
    classes = sketches.select("ident", "key").join(by_key, "key").select("ident", "rep")
    heads = sketches.groupBy("key").agg(F.min_by(F.struct("ident", "sketch", "bands"), "ident").alias("h")).select("h.*").where("sketch is not null")
    banded = heads.select("ident", "sketch", F.explode("bands").alias("band"))
    hot = staged(banded.groupBy("band").count().where(F.col("count") > block), "hot-shards")
    if hot.isEmpty():
        cells = banded.select("ident", "sketch", "band", *[F.lit(0).alias(c) for c in ("block", "cell_a", "cell_b")])
    else:
        parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
        cells = banded.join(hot, "band", "left").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("ident"), F.col("parts")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = cells.select("ident", "sketch", "band", "block", F.least("block", "other").alias("cell_a"), F.greatest("block", "other").alias("cell_b"))
    keys = ["band", "cell_a", "cell_b"]
    found = cells.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda it: _join(it, BUDGET), f"a {idtype}, b {idtype}")
    candidates = staged(found.distinct(), "candidates")
    need = staged(candidates.select(F.explode(F.array("a", "b")).alias("ident")).distinct(), "needed")
    picked = rows.join(F.broadcast(need) if size_of(need) <= BROADCAST_BYTES else need, "ident", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, counts = word_hashes(b["text"].tolist())
            runs, per = shingles(words, counts, k)
            yield pd.DataFrame({"ident": b["ident"], "runs": [np.unique(x).astype(np.int64) for x in np.split(runs, np.cumsum(per)[:-1])]})

    shingled = staged(picked.dropDuplicates(["ident"]).mapInPandas(sets, f"ident {idtype}, runs array<long>"), "runs")
    left, right = shingled.select(F.col("ident").alias("a"), F.col("runs").alias("ra")), shingled.select(F.col("ident").alias("b"), F.col("runs").alias("rb"))
    both = candidates.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ra", "rb")).alias("n"), (F.size("ra") + F.size("rb")).alias("m"))
    links = both.select("a", "b", (F.col("n") / (F.col("m") - F.col("n"))).alias("jaccard")).where(F.col("jaccard") >= least - 1e-12)
    return classes, links


def expanded(classes: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b), a < b, of idents that are of one class or of linked classes, for those who need the copies spelt out.

    A class of more than ``block`` idents is split into blocks, and each pair of blocks is a group of its own, so no class is bound to a task.
    """
    own = classes.where("rep is not null").distinct()
    sizes = own.groupBy("rep").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / block).cast("int")
    many = own.join(sizes.where("n > 1"), "rep").select("rep", F.col("ident").alias("x"), parts.alias("parts"), F.pmod(F.xxhash64("ident"), parts).cast("int").alias("bx"))
    left = many.select("rep", "x", "bx", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("by"))
    right = many.select("rep", F.col("x").alias("y"), F.col("bx").alias("by"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("bx"))
    same = left.join(right, ["rep", "bx", "by"]).where("x < y").select("x", "y")
    one, two = own.select(F.col("rep").alias("ra"), F.col("ident").alias("x")), own.select(F.col("rep").alias("rb"), F.col("ident").alias("y"))
    linked = links.select(F.col("a").alias("ra"), F.col("b").alias("rb")).join(one, "ra").join(two, "rb").select("x", "y")
    return same.unionByName(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
