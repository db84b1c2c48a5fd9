"""Keyword-stuffed and link-list pages.

Words are looked at in their places.  The gap of a word is its distance to the same word before it in the line; the autocorrelation at
a lag is the share of a line's words that stand again that many words on.  Text made of sentences has function words in every
line, and its other words recur at irregular, long gaps.  A line is stuffed if its words recur at short, regular gaps (many within the
lag window, or a high autocorrelation at some lag), or if it is a list of distinct words without function words (tags, goods,
links).  A page is spam if more than half of its words outside furniture stand in stuffed lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from webloom.llm.boilerplate import PARAGRAPH, fit, pages_of, slices, with_places
from webloom.llm.site_lines import counted_lines
from webloom.llm.words import word_lists

# Function words of the corpus languages (English, German, French, Spanish, Polish, Russian).
FUNCTION_WORDS = frozenset("""
the of and a an in to is was were that for it with as on at by from or no so nor they them their its has had who which what why if too more than some
der die das und ist war den dem ein eine nicht von zu mit auf für sich im sind sie ob nur doch weil nach
le la les de du des et est un une à en pour que qui dans sans ne pas plus ce cette avec même si au aux ont
el los las del y es por con se lo al su fue no ni para según entre más
i w z na się nie że do jest są był o po za gdy już lecz według pod
и в на не с что по из был была это к у за без но я о
""".split())  # fmt: skip

#: for lines that are lists, and for lines of sentences (whose frame may recur once a sentence): gap within which a word recurs, least share of recurring words, least autocorrelation
LISTS, SENTENCES = (24, 0.4, 0.25), (7, 0.2, 0.3)
LAGS, LETTERS, FUNCTION_SHARE, SHARE = 12, 3, 0.06, 0.5
_LIST = r"::|\s[|»-]\s|#\w"
_LINK = r"\bhttps?://\S+|\bwww\.\S+"
_END = r"[.!?…”»]\s*$"


def stuffed_lines(lines: pa.Array, words: pa.DictionaryArray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is stuffed, and its number of words; words and counts: of word_lists, if at hand."""
    if words is None:
        words, counts = word_lists(lines)
    names = words.dictionary.to_pylist()
    function = np.array([w in FUNCTION_WORDS for w in names], bool)
    code = {}
    plain = np.array([code.setdefault("0" if w.isdigit() else w, len(code)) for w in names], np.int64)
    n = len(lines)
    if not len(words):
        return np.zeros(n, bool), counts
    idx = words.indices.to_numpy()
    t, f = plain[idx], function[idx]
    line = np.repeat(np.arange(n), counts)
    per = np.maximum(counts, 1)
    # words of one or two letters are left out: they may be what a wrong decoding made of one letter
    said = ~f & np.array([len(w) >= LETTERS for w in names], bool)[idx]
    has = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    sentence = has(_END) & ~has(_LIST)
    window, least, regularity = (np.where(sentence, y, x) for x, y in zip(LISTS, SENTENCES))
    # gaps: positions of the same word of the same line, in order
    order = np.lexsort((np.arange(len(t)), t, line))
    same = (t[order][1:] == t[order][:-1]) & (line[order][1:] == line[order][:-1])
    near = np.zeros(len(t), bool)
    near[order[1:]] = same & (order[1:] - order[:-1] <= window[line[order[1:]]])
    recurring = np.bincount(line, near & said, n) / np.maximum(np.bincount(line, ~f, n), 1)
    regular = np.zeros(n)
    for lag in range(1, LAGS + 1):
        if len(t) > lag:
            hit = (t[lag:] == t[:-lag]) & (line[lag:] == line[:-lag]) & said[lag:]
            regular = np.maximum(regular, np.bincount(line[lag:], hit, n) / per)
    functions = np.bincount(line, f, n) / per
    stuffed = ((counts >= 2) & (functions < FUNCTION_SHARE) & ~(sentence & (counts >= 4))) | ((counts >= PARAGRAPH) & ((recurring > least) | (regular > regularity))) | has(_LINK)
    return stuffed & (counts > 0), counts


def spam_pages(df: DataFrame, ident: str, host: str, title: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Column ident of every page of whose words outside furniture more than half stand in stuffed lines.

    Furniture is what the scan of webloom.llm.boilerplate takes for it; every page is scanned.
    Null idents and null or empty texts give no row, repeated rows one.
    """
    rows = pages_of(df, ident, host, title, text)
    counted = counted_lines(rows, "ident", "host", "text")
    weights = fit(rows, counted) if weights is None else weights
    sent = df.sparkSession.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lines in slices(batches):
            bad, n = stuffed_lines(lines.raw, lines.words, lines.counts)
            own = n * ~lines.furniture(sent.value)
            spam = np.bincount(lines.page, own * bad, lines.n) > SHARE * np.bincount(lines.page, own, lines.n)
            yield pa.RecordBatch.from_pydict({"ident": b.column("ident").filter(pa.array(spam))})

    found = with_places(rows, counted).mapInArrow(judge, f"ident {rows.schema['ident'].dataType.simpleString()}")
    return found.distinct().withColumnRenamed("ident", ident)
