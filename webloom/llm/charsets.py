"""Text garbled by decoding with the wrong character encoding: found and undone by expectation-maximisation.

A latent chain (true encoding, wrong encoding, once or twice) stands behind every line; most lines have the chain "none".  Only runs of
non-ASCII characters can differ, so a line is seen as its runs, each with the ASCII character before and after.  What a chain
makes of a run is judged by a model of character pairs.

* The pair model is fitted to all runs of the corpus: chains are weighed per run, and pairs are counted in what the chains make of
  the runs, again and again.
* Each source (the host, and the noted encodings as a second, unreliable source) has its own shares of chains, estimated from all its
  lines, and each page its own, drawn towards its sources'; so lines with weak evidence follow the others.
* A line is garbled if its posterior for "none" is under one half, and is repaired by its most probable chain.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.plans.workspace import size_of, staged

#: (true encoding, encoding it was decoded with, times); the first stands for text that is as written.
CHAINS: list[tuple[str, str, int]] = [("", "", 0)]
CHAINS += [("utf-8", w, n) for w in ("cp1252", "latin-1") for n in (1, 2)]
CHAINS += [("utf-8", w, 1) for w in ("cp1250", "cp1251", "iso-8859-2", "mac-roman", "cp437", "cp850", "koi8-r", "cp866", "iso-8859-15", "iso-8859-5", "cp852")]
CHAINS += [("cp1252", w, 1) for w in ("mac-roman", "cp437", "cp850", "cp1250", "cp1251", "iso-8859-2")]
CHAINS += [("mac-roman", w, 1) for w in ("cp1252", "latin-1")]
CHAINS += [(t, "cp1252", 1) for t in ("cp437", "cp850")]
CHAINS += [(t, w, 1) for t in ("cp1251", "koi8-r", "cp866", "iso-8859-5") for w in ("cp1252", "latin-1", "cp1251", "koi8-r", "mac-roman") if t != w]
CHAINS += [(t, w, 1) for t in ("iso-8859-2", "cp1250", "cp852") for w in ("cp1252", "latin-1", "iso-8859-2", "cp1250") if t != w]
CHAINS += [("lost", "", 1)]

RUNS = re.compile(r"([\x00-\x7f]?)([^\x00-\x7f]+)(?=([\x00-\x7f]?))")
_PLAIN = frozenset("\u00a0·•©«»–—“”’‘„…▸°")
CLIP, REPLACED, IMPOSSIBLE, PRIOR_LINES, SOURCE_LINES = 14.0, -2.0, -9.0, 2.0, 20.0
BROADCAST_BYTES, SPARSE = 32 << 20, 0.0


@lru_cache(None)
def _table(codec: str) -> tuple[str, dict[str, int]]:
    """Characters of a one-byte encoding by byte, bytes without one standing for the control characters of their number; and the inverse."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def undone(run: str, chain: int) -> tuple[str, int] | None:
    """What the run was before the chain, and how many of its signs are beyond recovery; None if the chain can't have made it."""
    true, wrong, times = CHAINS[chain]
    if not times:
        return run, 0
    if true == "lost":
        return (run.replace("�", ""), run.count("�")) if "�" in run else None
    lost = 0
    for _ in range(times):
        code = _table(wrong)[1]
        raw = [code.get(c) for c in run]
        gaps = sum(b is None and c == "�" for b, c in zip(raw, run))
        if raw.count(None) > gaps:
            return None
        if true != "utf-8":
            if gaps:
                return None
            return "".join(_table(true)[0][b] for b in raw), 0
        text = bytes(b for b in raw if b is not None).decode("utf-8", "replace")
        bad = text.count("�")
        if bad and (len(text) - bad == 0 and raw[:2] not in ([0xE2, 0x80], [0xC3]) or bad > 1 + (len(text) - bad)):
            return None
        lost += bad + gaps
        run = text
    return run, lost


class Model:
    """Log-probabilities of character pairs, in lower case."""

    def __init__(self, pairs: dict[str, float]) -> None:
        self.pairs = pairs
        self.first: Counter = Counter()
        self.second: Counter = Counter()
        for p, n in pairs.items():
            self.first[p[0]] += n
            self.second[p[1]] += n
        self.total = max(sum(pairs.values()), 1.0)
        self.logs: dict[str, float] = {}
        self.known: dict[str, np.ndarray] = {}
        self.changed: dict[str, np.ndarray] = {}

    def log(self, left: str, run: str, right: str) -> float:
        s = ((left or " ") + run + (right or " ")).lower().replace("\u00a0", " ")
        out = 0.0
        for a, b in zip(s, s[1:]):
            v = self.logs.get(a + b)
            if v is None:
                v = self.logs[a + b] = math.log((self.pairs.get(a + b, 0.0) + 5 * (self.second.get(b, 0.0) + 0.5) / self.total) / (self.first.get(a, 0.0) + 5))
            out += v
        return out

    def gains(self, unit: str) -> np.ndarray:
        """Log-likelihood of each chain for a unit (character before, run, character after) against "none"."""
        got = self.known.get(unit)
        if got is None:
            left, run, right = unit[0].strip("\0"), unit[1:-1], unit[-1].strip("\0")
            got = np.full(len(CHAINS), IMPOSSIBLE)
            base = self.log(left, run, right)
            other = np.zeros(len(CHAINS), bool)
            for c in range(len(CHAINS)):
                u = undone(run, c)
                if u is not None:
                    other[c] = u[0] != run or u[1] > 0
                    got[c] = np.clip(self.log(left, u[0].replace("�", ""), right) - base + REPLACED * u[1], -CLIP, CLIP)
            if "�" in run:
                got[-1] = CLIP
            self.known[unit], self.changed[unit] = got, other
        return got


def units(line: str) -> list[str]:
    """The line's runs with the character before and after each; no-break spaces between plain signs are blanks."""
    out = []
    for a, run, b in RUNS.findall(line):
        if "\u00a0" in run and all(c in _PLAIN for c in run):
            run = run.replace("\u00a0", "")
        if run:
            out.append((a or "\0").lower() + run + (b or "\0").lower())
    return out


def _encoding(c: Column) -> Column:
    """One spelling for each encoding name."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "^(windows|xmac)", "cp"), F.lit("?"))


def _posteriors(rows: pd.DataFrame, model: Model, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains' posteriors of the lines with runs, page row and line number of each; prior: one row of chain shares per page."""
    who, number, sums, changes = [], [], [], []
    for k, (us, at) in enumerate(zip(rows["units"], rows["lines"])):
        last = None
        for u, n in zip(us, at):
            if n != last:
                who.append(k)
                number.append(n)
                sums.append(np.zeros(len(CHAINS)))
                changes.append(np.zeros(len(CHAINS), bool))
                last = n
            sums[-1] += model.gains(u)
            changes[-1] |= model.changed[u]
    if not who:
        return np.zeros((0, len(CHAINS))), np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, gain, same = np.array(who), np.array(sums), ~np.array(changes)
    same[:, 0] = False
    share = prior
    lines = np.bincount(who, minlength=len(rows))
    for _ in range(3):
        post = gain + np.log(share[who])
        post = np.exp(post - post.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        pooled = np.zeros((len(rows), len(CHAINS)))
        post[:, 0] += np.where(same, post, 0).sum(axis=1)  # a chain that changes nothing here is as good as none
        post[same] = 0
        np.add.at(pooled, who, post)
        share = (pooled + PRIOR_LINES * prior) / (lines[:, None] + PRIOR_LINES)
    return post, who, np.array(number)


def garbled_lines(df: DataFrame, ident: str, source: str, text: str, title: str, hints: DataFrame, hint_columns: tuple[str, str], sparse: float = SPARSE) -> DataFrame:
    """Columns ident, line_no (INT, from 1) and chain (INT, index in CHAINS) of every garbled line of text; a garbled title is line 0.

    hints: rows with ident and two columns of noted encodings, unreliable: missing, repeated, misspelt or wrong ones only weaken or
    mislead a prior.  sparse: chains of no larger posterior teach the pair model nothing (sparse EM; the default takes all);
    they count in the chains' shares all the same.  The title is read as one line more, which is evidence for its page too.  Null idents and texts
    have no rows; a null source or title is a source, or no line; ASCII lines are never garbled; repeated rows count once.
    """
    spark = df.sparkSession
    rows = df.where(F.col(ident).isNotNull() & (F.col(text).isNotNull() | F.col(title).isNotNull())).select(F.col(ident).alias("ident"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"), F.col(title).alias("title"))
    idtype = rows.schema["ident"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ident, source, text, title in zip(b["ident"].tolist(), b["source"].tolist(), b["text"].tolist(), b["title"].tolist()):
                us, at = [], []
                for n, line in enumerate([title or "", *(text or "").split("\n")]):
                    if not line.isascii():
                        found = units(line)
                        us += found
                        at += [n] * len(found)
                if us:
                    out.append((ident, source, us, at))
            if out:
                o = pd.DataFrame(out, columns=["ident", "source", "units", "lines"])
                yield o.assign(source=o["source"].astype(object))

    cutted = staged(rows.mapInPandas(cut, f"ident {idtype}, source string, units array<string>, lines array<int>"), "runs")
    counted = staged(cutted.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n")), "units")
    model, shares = Model({}), np.full(len(CHAINS), 0.1 / (len(CHAINS) - 1))
    shares[0] = 0.9
    for step in range(3):
        sent = spark.sparkContext.broadcast((model.pairs, shares))

        def weigh(batches: Iterator[pd.DataFrame], sent=sent, step=step) -> Iterator[pd.DataFrame]:
            pairs, shares = sent.value
            model, total = Model(pairs), Counter()
            for b in batches:
                for unit, n in zip(b["unit"], b["n"].tolist()):
                    left, run, right = unit[0].strip("\0") or " ", unit[1:-1], unit[-1].strip("\0") or " "
                    if step == 0:
                        post = [1.0]
                    else:
                        post = model.gains(unit) + np.log(shares)
                        post = np.exp(post - post.max())
                        post /= post.sum()
                    for c, p in enumerate(post):
                        total["chain " + str(c)] += p * n
                        if p <= sparse:
                            continue
                        u = undone(run, c) if CHAINS[c][0] != "lost" else None
                        if u is not None:
                            s = (left + u[0] + right).lower().replace("\u00a0", " ")
                            for x, y in zip(s, s[1:]):
                                total[x + y] += p * n
                yield pd.DataFrame({"what": pd.Series(list(total), dtype=object), "n": list(total.values())})
                total.clear()

        got = counted.mapInPandas(weigh, "what string, n double").groupBy("what").agg(F.sum("n").alias("n"))
        # pairs are bounded by the letters there are, not by the texts: see README
        got = {r["what"]: r["n"] for r in got.collect()}
        model = Model({k: v for k, v in got.items() if len(k) == 2})
        shares = np.array([got.get(f"chain {c}", 0.0) + 1e-3 for c in range(len(CHAINS))])
        shares = 0.999 * shares / shares.sum() + 0.001 / len(CHAINS)
    sent = spark.sparkContext.broadcast(model.pairs)
    start = shares if step else None

    noted = hints.select(F.col(ident).alias("ident"), F.concat_ws(">", _encoding(F.col(hint_columns[0])), _encoding(F.col(hint_columns[1]))).alias("note")).where("ident is not null").groupBy("ident").agg(F.min("note").alias("note"))
    seen = staged(cutted.join(noted, "ident", "left").withColumn("note", F.coalesce("note", F.lit("?"))), "runs-noted")

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value)
        for b in batches:
            post, who, _ = _posteriors(b, model, np.tile(start, (len(b), 1)))
            out = pd.DataFrame(post).assign(source=b["source"].astype(object).values[who], note=b["note"].astype(object).values[who])
            parts = [out.drop(columns=[y]).groupby(x).sum().reset_index().rename(columns={x: "name"}).assign(kind=x) for x, y in (("source", "note"), ("note", "source"))]
            both = pd.concat(parts)
            yield pd.DataFrame({"kind": both["kind"].astype(object), "name": both["name"].astype(object), "shares": list(both[list(range(len(CHAINS)))].to_numpy())})

    pooled = seen.mapInPandas(pool, "kind string, name string, shares array<double>").groupBy("kind", "name").agg(F.array(*[F.sum(F.get("shares", F.lit(c))) for c in range(len(CHAINS))]).alias("shares"))
    pooled = staged(pooled, "chain-shares")

    def with_shares(rows: DataFrame, kind: str) -> DataFrame:
        own = pooled.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("shares").alias(f"{kind}_shares"))
        return rows.join(F.broadcast(own) if size_of(pooled) <= BROADCAST_BYTES else own, kind, "left")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(sent.value)
        for b in batches:
            prior = np.zeros((len(b), len(CHAINS)))
            for kind in ("source", "note"):
                own = np.array([x if x is not None else np.zeros(len(CHAINS)) for x in b[f"{kind}_shares"]], float)
                prior += 0.5 * (own + SOURCE_LINES * start) / (own.sum(axis=1, keepdims=True) + SOURCE_LINES)
            post, who, number = _posteriors(b, model, prior)
            bad = post[:, 0] < 0.5 if len(who) else np.zeros(0, bool)
            chain = post[bad, 1:].argmax(axis=1) + 1 if bad.any() else np.zeros(0, np.int64)
            yield pd.DataFrame({"ident": b["ident"].values[who[bad]] if bad.any() else b["ident"].values[:0], "line_no": number[bad].astype(np.int32), "chain": chain.astype(np.int32)})

    out = with_shares(with_shares(seen, "source"), "note").mapInPandas(decide, f"ident {idtype}, line_no int, chain int")
    return out.groupBy("ident", "line_no").agg(F.min("chain").alias("chain")).withColumnRenamed("ident", ident)


def repair(line: str, chain: int) -> str:
    """The line with its runs as they were before the chain; what is beyond recovery stays marked."""
    def one(m: re.Match) -> str:
        u = undone(m.group(2), chain)
        return m.group(1) + (m.group(2) if u is None or CHAINS[chain][0] == "lost" else u[0])

    return RUNS.sub(one, line)


def repaired(df: DataFrame, ident: str, text: str, found: DataFrame, title: str | None = None) -> DataFrame:
    """Rows ident, line_no, line of the found lines (of garbled_lines) as first written, titles being line 0; without title only those of text."""
    found = found if title else found.where("line_no > 0")
    head = F.col(title) if title else F.lit(None).cast("string")
    per = found.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("line_no", "chain"))).alias("chains"))
    joined = df.select(F.col(ident), F.col(text).alias("text"), head.alias("title")).join(per, ident).select(F.col(ident).alias("ident"), F.explode(F.transform(F.map_entries("chains"), lambda e: F.struct(e.key.alias("n"), e.value.alias("c"), F.when(e.key == 0, F.col("title")).otherwise(F.get(F.split("text", "\n"), e.key - 1)).alias("line")))).alias("x")).select("ident", "x.*")

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lines = pd.Series([repair(x, c) for x, c in zip(b["line"], b["c"].tolist())], dtype=object)
            yield pd.DataFrame({"ident": b["ident"], "line_no": b["n"], "line": lines.values})

    return joined.mapInPandas(fix, f"ident {joined.schema['ident'].dataType.simpleString()}, line_no int, line string").withColumnRenamed("ident", ident)
