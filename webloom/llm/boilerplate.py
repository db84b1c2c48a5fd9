"""Main content of pages: maximum-scoring runs of lines.

Each word of a line has a weight, positive where it is commoner in main text, negative where it is commoner in page furniture; the
marks that stand for a page's tags here (the line's shape, separators, a missing full stop, the site's own name, the place before,
between or after the paragraphs, a repeated heading above it, whether its neighbours are furniture ...) have weights too, and each further text of the site in
which a line stands takes a share of its words' weights and of ``REPEAT`` from its score, all of both at ``REPEATED``.  A linear scan then finds the set of contiguous line runs with
the largest sum of scores, each further run at a price, so that a notice between two paragraphs doesn't drag the second paragraph
down with it.  Nothing but that scan decides.

The weights come from labelled pages.  Nobody labels pages by hand here: in a sample of pages, bounded by a parameter, a line that
stands in several texts of its site is furniture.  A line that stands in one text only is main text if it is long, if it is the page's
title, if it stands between long ones and not beside a repeated line, or if it is one of several lines of the same shape; so lists,
glossaries and results of a page are learnt as its own.  All other lines are labelled by the weights themselves in a second round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.site_lines import counted_lines, places_counted
from webloom.llm.words import word_lists
from webloom.plans.workspace import size_of, staged

LABELLED_PAGES = 12_000
PRICE, CLIP, PARAGRAPH, REPEATED, REPEAT, RUN, ROUNDS = 1.0, 3.0, 12, 5, 16.0, 3, 2
BROADCAST_BYTES = 32 << 20
SLICE = 2048

_ENDS = {x: x for x in ".!?…:,;”»“)"}
_SENTENCE_ENDS = set(".!?…”»“\"'")
#: what is taken from a line, step by step, to see its shape: list signs, numbers, words, tags, blanks
_SHAPE = [(r"^[-*•▸]\s*", ""), (r"\d[\d.,:]*", "0"), (r"\p{L}+(?:[\s'’-]+\p{L}+)*", "w"), (r"#w(?:\s*#w)+", "#w"), (r"[\s\p{Z}]+", " ")]


def site_names(host: str | None) -> set[str]:
    """Labels of a host name that can be the site's name."""
    return {x for x in (host or "").lower().split(".")[:-1] if len(x) > 3} - {"www", "blog", "news", "forum", "example"}


def _coded(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    d = values.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()


class Lines:
    """The filled lines of a batch of pages (columns ident, host, title, text, places), with what their scores need, as arrays."""

    def __init__(self, b: pa.RecordBatch, hidden: np.ndarray | None = None) -> None:
        """hidden: pages whose title the marks may not see."""
        self.n = b.num_rows
        self.hidden = np.zeros(self.n, bool) if hidden is None else hidden
        lists = pc.split_pattern(pc.fill_null(b.column("text"), ""), "\n")
        per = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten()
        filled = pc.match_substring_regex(flat, r"[^\s\p{Z}]").to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(self.n), per)
        number = np.arange(len(page)) - (np.cumsum(per) - per)[page]
        among = np.ones(len(page), np.int64)
        places = b.column("places")
        if len(said := places.flatten()):
            at = (np.cumsum(per) - per)[np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(places), 0).to_numpy())] + said.field("pos").to_numpy()
            np.maximum.at(among, at, said.field("c").to_numpy())
        self.page, self.number, self.among = page[filled], number[filled] + 1, among[filled]
        self.raw = flat.filter(pa.array(filled))
        self.cuts = np.searchsorted(self.page, np.arange(self.n + 1))
        self.words, self.counts = word_lists(self.raw)
        self._marks(b)

    def _marks(self, b: pa.RecordBatch) -> None:
        n, m = self.counts, len(self.counts)
        text = pc.utf8_trim_whitespace(self.raw)
        last, signs = _coded(pc.utf8_slice_codeunits(text, -1, 2**31 - 1))
        ends = np.array([x in _SENTENCE_ENDS for x in signs] + [False])[last]
        short = n < PARAGRAPH
        # the page's own headline, and the site's name
        title = [" ".join((x or "").lower().split()) for x in b.column("title").to_pylist()]
        names = [site_names(x) for x in b.column("host").to_pylist()]
        low = pc.utf8_lower(text).to_pylist()
        own, site = np.zeros(m, bool), np.zeros(m, bool)
        for p, (lo, hi) in enumerate(zip(self.cuts.tolist(), self.cuts[1:].tolist())):
            t, start, called = title[p], title[p][:4], names[p]
            for i in range(lo, hi):
                x = low[i]
                if len(x) > 8 and len(t) > 8 and x.startswith(start) and t.startswith(" ".join(x.split())):
                    own[i] = True
                if called:
                    site[i] = any(c in x for c in called)
        own &= short
        seen = own & ~self.hidden[self.page]
        # the page's text reaches from its headline, if that comes first, to its last long line that isn't repeated
        k = np.arange(m)
        body = np.flatnonzero(~short & ends & (self.among < REPEATED))
        first, final = np.full(self.n, m), np.full(self.n, -1)
        first[self.page[body[::-1]]], final[self.page[body]] = body[::-1], body
        heads = np.flatnonzero(seen & (k < first[self.page]))[::-1]
        first[self.page[heads]] = heads
        titled = np.zeros(self.n, bool)
        titled[self.page[heads]] = True
        first, final, titled = first[self.page], final[self.page], titled[self.page]
        zone = np.select([final < 0, (k < first) & titled, k < first, k > final, short], [0, 1, 2, 3, 4], 5)
        far = np.select([(zone == 1) | (zone == 2), zone == 3], [np.minimum(first - k, 3), np.minimum(k - final, 3)], 0)
        # the shapes of short lines, and runs of the same one
        shaped = short | ~ends
        shape = text.filter(pa.array(shaped))
        for pattern, new in _SHAPE:
            shape = pc.replace_substring_regex(shape, pattern=pattern, replacement=new)
        code, shapes = _coded(shape)
        every = np.full(m, -1)
        every[shaped] = code
        new = np.concatenate([[True], (every[1:] != every[:-1]) | (self.page[1:] != self.page[:-1]) | (every[1:] < 0)]) if m else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        self.in_run = (np.bincount(run)[run] >= RUN) if m else np.zeros(0, bool)
        self.own, self.seen, self.short, self.zone = own, seen, short, zone
        plain = ~(~short & np.array([x in ".!?…" for x in signs] + [False])[last])
        separators = np.minimum(pc.count_substring_regex(text, r"[|·»>/]|  |::").to_numpy(), 3)
        vocabulary, codes, owner = [], [], []

        def mark(where: np.ndarray, which: np.ndarray, labels: list[str]) -> None:
            codes.append(which[where] + len(vocabulary))
            owner.append(np.flatnonzero(where))
            vocabulary.extend(labels)

        yes, zero = np.ones(m, bool), np.zeros(m, np.int64)
        mark(yes, zone * 4 + far, [f"#zone{z}{d}" for z in ZONES for d in range(4)])
        mark(yes, last, ["#end" + _ENDS.get(x, "0" if x.isdigit() else "a") for x in signs])
        mark(yes, np.array([min(x, 40).bit_length() for x in range(int(n.max()) + 1 if m else 1)])[n], [f"#len{x}" for x in range(7)])
        mark(site, zero, ["#site"])
        mark(seen, zero, ["#title"])
        mark(plain, separators, [f"#sep{x}" for x in range(4)])
        mark(plain & pc.match_substring(text, "©").to_numpy(zero_copy_only=False), zero, ["#copy"])
        mark(plain & (n > 1) & pc.utf8_is_upper(text).to_numpy(zero_copy_only=False), zero, ["#upper"])
        mark(plain & pc.match_substring_regex(text, r"^(?:[-*•▸]|\d+[.)]?\s)").to_numpy(zero_copy_only=False), zero, ["#item"])
        mark(shaped, zone * len(shapes) + every, [f"~{z}{x}" for z in ZONES for x in shapes])
        mark(shaped & self.in_run, every, [f"~~{x}" for x in shapes])
        # a repeated short line just before: a heading under which other stories stand, a prompt, a byline ...
        told = np.zeros(m, bool)
        told[1:] = short[1:] & short[:-1] & (self.among[:-1] > 1) & (self.page[1:] == self.page[:-1])
        before = np.flatnonzero(told) - 1
        code, called = _coded(pa.array([" ".join(low[i].split()) for i in before], pa.string()))
        after = np.zeros(m, np.int64)
        after[before + 1] = code
        mark(told, after, [f"<={x}" for x in called])
        self.kind = zone * 2 + short
        names_of = ["0" if w[0].isdigit() else w for w in self.words.dictionary.to_pylist()]
        self.vocabulary, self.spoken = names_of + vocabulary, len(self.words)
        self.token = np.concatenate([self.words.indices.to_numpy().astype(np.int64), *[x + len(names_of) for x in codes]])
        self.owner = np.concatenate([np.repeat(k, n), *owner])

    def repetition(self) -> np.ndarray:
        """How much of REPEATED each line's repetition amounts to; a page's own headline may differ from others of its site in numbers only."""
        return np.where(self.seen, 0.0, np.minimum(self.among - 1, REPEATED - 1) / (REPEATED - 1))

    def next(self, base: np.ndarray) -> np.ndarray:
        """For each line a code in NEXT: how the line after it scores."""
        out = np.full(len(base), 3)
        out[:-1] = np.where(self.page[1:] != self.page[:-1], 3, np.select([base < -2, base > 2], [0, 2], 1)[1:])
        return out

    def scores(self, weights: dict[str, float]) -> np.ndarray:
        w = np.array([weights.get(x, 0.0) for x in self.vocabulary])
        word, mark = (np.bincount(self.owner[x], w[self.token[x]], len(self.counts)) for x in (slice(None, self.spoken), slice(self.spoken, None)))
        again = self.repetition()
        base = word * (1 - again) + mark - REPEAT * again
        return base + np.array([weights.get(x, 0.0) for x in NEXT])[self.next(base)]

    def furniture(self, weights: dict[str, float]) -> np.ndarray:
        """Whether each line is outside the best runs of its page."""
        s = self.scores(weights)
        out, inside = ((s + np.array([weights.get(f"{x}{k}", 0.0) for k in range(2 * len(ZONES))])[self.kind]).tolist() for x in PREVIOUS)
        gone = np.ones(len(s), bool)
        for lo, hi in zip(self.cuts.tolist(), self.cuts[1:].tolist()):
            gone[lo:hi] = ~np.array(kept_runs(inside[lo:hi], out[lo:hi]), bool)
        return gone

    def labels(self, texts: np.ndarray) -> np.ndarray:
        """1 for furniture, 0 for main text, NaN for lines that nothing labels; texts: each page's number of texts of its site."""
        again = self.among >= REPEATED
        lone = (self.among == 1) & (texts[self.page] >= REPEATED)
        beside = np.zeros(len(again), bool)
        same = self.page[1:] == self.page[:-1]
        beside[1:] |= same & (self.among[:-1] > 1)
        beside[:-1] |= same & (self.among[1:] > 1)
        main = lone & (~self.short | self.own | self.in_run | ((self.zone == 4) & ~beside))
        return np.where(again & ~self.own, 1.0, np.where(main | self.own, 0.0, np.nan))


#: no long line; before a title, before the text of a page without one, after it, between, long
ZONES = "nhHtbp"
NEXT = [f">{level}" for level in "nzp."]
#: marks for a line of a kind (zone, short or not) after one that is furniture, or main text
PREVIOUS = ("<f", "<m")


def kept_runs(scores: list[float], first: list[float] | None = None, price: float = PRICE) -> list[bool]:
    """The lines of the line runs with the largest sum of scores, each run after the first costing ``price``; one scan forward, one back.  first: what a line scores as the first one of a run, if that differs."""
    inside, outside, back = -np.inf, 0.0, []
    for k, (s, f) in enumerate(zip(scores, first or scores)):
        opened = outside - (price if k else 0) + f
        stay = inside + s >= opened
        leave = inside > outside
        inside, outside = inside + s if stay else opened, inside if leave else outside
        back.append((stay, leave))
    keep, state = [False] * len(scores), inside > outside
    for k in range(len(scores) - 1, -1, -1):
        keep[k] = state
        state = back[k][0] if state else back[k][1]
    return keep


def slices(batches: Iterator[pa.RecordBatch], hide: bool = False) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """Parts of the batches with their lines; hide: the marks don't see the title of every second page, so that headlines are learnt without it too."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            yield b, Lines(b, np.arange(b.num_rows) % 2 == 1 if hide else None)


def with_places(rows: DataFrame, counted: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """rows (ident, ...) with ``places``: the lines that stand in several texts of their site, and in how many."""
    base, _, counts = counted
    return rows.join(places_counted(base, counts.where("c > 1")), "ident", "left")


def fit(rows: DataFrame, counted: tuple[DataFrame, DataFrame, DataFrame], labelled: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights of words and marks, from about ``labelled`` texts (drawn by a hash of their ident, one of each text of a site; all, if there are no more); the repetition that labels their lines is counted over the texts of all pages.

    rows: ident, host, title, text; counted: what counted_lines gave for them.
    """
    _, clusters, _ = counted
    sizes = clusters.groupBy("src").agg(F.count("*").alias("texts"))
    share = labelled / max(clusters.count(), 1)
    drawn = clusters.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(share, 1) * (1 << 30))).join(sizes, "src", "left")
    drawn = staged(drawn.groupBy(F.col("rep").alias("ident")).agg(F.coalesce(F.max("texts"), F.lit(0)).alias("texts")), "drawn-texts")
    sample = rows.join(F.broadcast(drawn) if size_of(drawn) <= BROADCAST_BYTES else drawn, "ident").dropDuplicates(["ident"])
    sample = staged(with_places(sample, counted), "labelled-pages")
    weights: dict[str, float] = {}
    for _ in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast(dict(weights))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            text_n, furniture_n = Counter(), Counter()
            for b, lines in slices(batches, hide=True):
                y = lines.labels(b.column("texts").to_numpy())
                token, owner, vocabulary = lines.token, lines.owner, lines.vocabulary
                if known:
                    s = lines.scores(known)
                    y = np.where(np.isnan(y), 1 / (1 + np.exp(np.clip(s, -30, 30))), y)
                    token = np.concatenate([token, lines.next(s) + len(vocabulary)])
                    owner = np.concatenate([owner, np.arange(len(y))])
                    vocabulary = vocabulary + NEXT
                ok = ~np.isnan(y[owner])
                code = np.unique(token[ok] + owner[ok] * np.int64(len(vocabulary)))
                t, v = code % len(vocabulary), y[code // len(vocabulary)]
                f, c = np.bincount(t, v, len(vocabulary)), np.bincount(t, 1 - v, len(vocabulary))
                for i in np.flatnonzero(f + c):
                    furniture_n[vocabulary[i]] += f[i]
                    text_n[vocabulary[i]] += c[i]
                # how often a line of each kind follows furniture, and main text
                pair = np.flatnonzero((lines.page[1:] == lines.page[:-1]) & ~np.isnan(y[1:] + y[:-1]))
                for x, p in zip(PREVIOUS, (y[pair], 1 - y[pair])):
                    for n, q in ((furniture_n, y[pair + 1]), (text_n, 1 - y[pair + 1])):
                        for i, v in enumerate(np.bincount(lines.kind[pair + 1], p * q, 2 * len(ZONES))):
                            n[f"{x}{i}"] += v
                furniture_n[""] += np.nansum(y)
                text_n[""] += np.nansum(1 - y)
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(text_n), pa.string()), "c": pa.array([float(x) for x in text_n.values()], pa.float64()), "f": pa.array([float(furniture_n[x]) for x in text_n], pa.float64())})

        got = sample.mapInArrow(count, "token string, c double, f double").groupBy("token").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).toArrow().to_pydict()
        got = {k: (c, f) for k, c, f in zip(got["token"], got["c"], got["f"])}
        if "" not in got:
            return {}
        nc, nf = (x + 1 for x in got.pop(""))
        weights = {k: float(np.clip(np.log((c + 1) / nc) - np.log((f + 1) / nf), -CLIP, CLIP)) for k, (c, f) in got.items()}
        for k in range(2 * len(ZONES)):  # of these only what they tell beyond the kind itself
            c, f = ([got.get(f"{x}{k}", (0.0, 0.0))[i] + 1 for x in PREVIOUS] for i in (0, 1))
            weights |= {f"{x}{k}": float(np.clip(np.log(c[i] / sum(c)) - np.log(f[i] / sum(f)), -CLIP, CLIP)) for i, x in enumerate(PREVIOUS)}
    return weights


def pages_of(df: DataFrame, ident: str, host: str, title: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("ident"), F.col(host).alias("host"), F.col(title).alias("title"), F.col(text).alias("text"))


def furniture_lines(df: DataFrame, ident: str, host: str, title: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Columns ident and line_no of every line that is furniture; blank lines never are.

    Null idents and null or empty texts have no rows; a null title or host only takes away its hint; repeated rows count once.
    """
    rows = pages_of(df, ident, host, title, text)
    counted = counted_lines(rows, "ident", "host", "text")
    weights = fit(rows, counted) if weights is None else weights
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lines in slices(batches):
            gone = lines.furniture(sent.value)
            yield pa.RecordBatch.from_pydict({"ident": b.column("ident").take(pa.array(lines.page[gone])), "line_no": pa.array(lines.number[gone], pa.int32())})

    found = with_places(rows, counted).mapInArrow(scan, f"ident {rows.schema['ident'].dataType.simpleString()}, line_no int")
    return found.distinct().withColumnRenamed("ident", ident)
