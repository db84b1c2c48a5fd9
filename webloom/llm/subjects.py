"""Subject areas of documents: seeded non-negative factorisation of the sentence-term matrix.

Every sentence is a row.  Every term counts: terms are hashed to ``CELLS`` columns, so that the factors have a fixed size whatever the
vocabulary is, and rare terms share a column instead of being dropped.  One component is anchored to each subject: its start is what the
terms of documents labelled with it have above their rate in all documents; one more component has the overall rates and takes
the common words.  Alternating non-negative updates (those of the Kullback-Leibler factorisation) over all documents then spread
each subject to terms no labelled document had.  With the factors fixed, a sentence belongs to the anchored component with the
largest mass, if that amounts to ``mass`` terms; a document has the subjects of at least ``share`` of its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import word_lists
from webloom.plans.workspace import staged

# a sentence ends in one of these signs before a blank and an upper-case letter, a digit or an opening sign, or with its line
END = r"([.!?…;:—”»“])[\s\p{Z}]+([\p{Lu}\p{Lt}\p{Lo}\p{Lm}«„“¿¡\d])"
LABELLED_DOCUMENTS = 200_000
ROUNDS, INNER, FLOOR, CELLS = 3, 3, 0.001, 1 << 17
PURE, PRIOR = 0.3, 4.0
_SLICE, _FLUSH = 1 << 16, 1 << 20


def sentences(texts: list[str] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All sentences (with a letter at least) one after the other, and each text's number of them."""
    lists = pc.split_pattern_regex(pc.replace_substring_regex(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), pattern=END, replacement="\\1\n\\2"), "\n+")
    flat = lists.flatten()
    real = pc.match_substring_regex(flat, r"\p{L}")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), np.bincount(owner, minlength=len(texts))


def _shares(t: np.ndarray, starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Responsibility of each component (row) for each term occurrence, the mixtures of the sentences (that begin at ``starts``) being fitted to the fixed factors h (components x terms)."""
    base = h[:, t]
    sizes = np.diff(starts, append=len(t))
    r = base / base.sum(axis=0)
    for _ in range(INNER - 1):
        w = np.add.reduceat(r, starts, axis=1) + np.float32(0.05)
        r = base * np.repeat(w, sizes, axis=1)
        r /= r.sum(axis=0)
    return r


def _anchored(h: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """Factors from the term masses of the anchored components: an anchored component keeps the terms of whose mass among anchored components it has far more than an even share; what is left goes to the common component."""
    mass = h
    pure = (mass + PRIOR / len(mass)) / (mass.sum(axis=0) + PRIOR)
    kept = mass * np.maximum(pure - PURE, 0)
    out = np.empty((len(h) + 1, h.shape[1]))
    out[:-1] = kept / np.maximum(kept.sum(axis=1, keepdims=True), 1e-9) + FLOOR * overall
    out[-1] = overall
    return out / out.sum(axis=1, keepdims=True)


def _flat(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch, at document bounds: first and last document, term cells, where each sentence begins, and each sentence's document."""
    ends = b.column("terms").offsets.to_numpy()
    terms, places = b.column("terms").values.to_numpy(), b.column("places").values.to_numpy()
    at = 0
    while at < b.num_rows:
        to = max(int(np.searchsorted(ends, ends[at] + _SLICE, "right")) - 1, at + 1)
        if ends[to] > ends[at]:
            t, place = terms[ends[at] : ends[to]], places[ends[at] : ends[to]]
            doc = np.repeat(np.arange(at, to), np.diff(ends[at : to + 1]))
            starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
            yield at, to, t, starts, doc[starts]
        at = to


def _sums(masses: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(masses.any(axis=0))
    return pa.RecordBatch.from_pydict({"t": pa.array(at, pa.int32())} | {f"r{k}": pa.array(m[at]) for k, m in enumerate(masses)})


def _gathered(rows: DataFrame, partial, components: int) -> np.ndarray:
    """Masses (components x cells) from the partial sums of all partitions: no more than CELLS rows reach the driver."""
    names = [f"r{k}" for k in range(components)]
    parts = rows.mapInArrow(partial, "t int, " + ", ".join(f"{x} double" for x in names))
    got = parts.groupBy("t").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    out = np.zeros((components, CELLS))
    for k, x in enumerate(names):
        out[k, got.column("t").to_numpy()] = got.column(x).to_numpy()
    return out


def subject_rows(df: DataFrame, ident: str, text: str, labels: DataFrame, label_ident: str, subject: str, share: float = 0.2, mass: float = 0.9, labelled: int = LABELLED_DOCUMENTS) -> DataFrame:
    """Columns ident and subject: the subjects that at least ``share`` of a document's sentences are about.

    labels: a sample of documents with their subjects, wrong ones among them; about ``labelled`` labelled documents (drawn by a hash of
    their ident; all, if there are no more) seed the factors.  Everything else covers all documents: term counts, updates, assignment.
    Documents with null ident or null, empty or subjectless text have no rows; repeated rows count once; without documents or without
    labels the result is empty.  The factors have (subjects + 1) x CELLS numbers.
    """
    spark = df.sparkSession
    docs = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    idtype = docs.schema["ident"].dataType.simpleString()
    marks = labels.where(F.col(label_ident).isNotNull() & F.col(subject).isNotNull()).groupBy(F.col(label_ident).alias("ident")).agg(F.collect_set(subject).alias("subjects"))
    marks = staged(marks, "labels")
    drawn = min(labelled / max(marks.count(), 1), 1)
    marks = marks.where(F.pmod(F.xxhash64("ident"), F.lit(1 << 30)) < int(drawn * (1 << 30)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sentences, term cells and the sentence of each; at the end a row without ident: the partition's counts by cell."""
        total, kind = np.zeros(CELLS, np.int64), None
        lists = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))
        for b in batches:
            found, per = sentences(b.column("text"))
            words, counts = word_lists(found)
            table = np.array([xxhash.xxh3_64_intdigest(w) & (CELLS - 1) for w in words.dictionary.to_pylist()], np.int32)
            t = table[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
            total += np.bincount(t, minlength=CELLS)
            row = np.repeat(np.arange(b.num_rows), per)
            place = np.repeat(np.arange(len(counts)) - (np.cumsum(per) - per)[row], counts).astype(np.int32)
            cuts = np.searchsorted(np.repeat(row, counts), np.arange(b.num_rows + 1))
            kind = b.schema.field("ident").type
            nothing = pa.nulls(b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"ident": b.column("ident"), "sentences": pa.array(per, pa.int32()), "terms": lists(t, cuts), "places": lists(place, cuts), "counts": nothing})
        at = np.flatnonzero(total)
        if len(at):
            ends = [0, len(at)]
            yield pa.RecordBatch.from_pydict({"ident": pa.nulls(1, kind), "sentences": pa.array([0], pa.int32()), "terms": lists(at.astype(np.int32), ends), "places": lists(np.zeros(0, np.int32), [0, 0]), "counts": lists(total[at], ends)})

    both = staged(docs.mapInArrow(coded, f"ident {idtype}, sentences int, terms array<int>, places array<int>, counts array<long>"), "sentences")
    rows = both.where("ident is not null").drop("counts")
    names = [r[0] for r in marks.select(F.explode("subjects")).distinct().orderBy("col").collect()]
    schema = f"ident {idtype}, subject string"
    overall = np.zeros(CELLS)
    got = both.where("ident is null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).toArrow()
    overall[got.column("terms").to_numpy()] = got.column("n").to_numpy()
    if not names or not overall.any():
        return spark.createDataFrame([], schema).withColumnsRenamed({"ident": ident, "subject": "subject"})
    overall = np.where(overall > 0, overall + 0.5, 0)
    overall /= overall.sum()

    # term masses by subject of the labelled documents: a document with several subjects counts for each in part
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = np.zeros((len(names), CELLS)), {x: k for k, x in enumerate(names)}
        for b in batches:
            ends, terms = b.column("terms").offsets.to_numpy(), b.column("terms").values.to_numpy()
            for lo, hi, said in zip(ends, ends[1:], b.column("subjects").to_pylist()):
                for s in said:
                    np.add.at(total[place[s]], terms[lo:hi], 1 / len(said))
        yield _sums(total)

    h = _gathered(rows.join(marks, "ident").select("terms", "subjects"), seed, len(names))
    h *= h.sum() / (np.maximum(h.sum(axis=1, keepdims=True), 1e-9) * len(names))
    h = _anchored(h, overall)

    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(h.astype(np.float32))

        def update(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            h, total, kept, size = now.value, np.zeros((len(names), CELLS)), [], 0

            def flush() -> None:
                if kept:
                    t = np.concatenate([x for x, _ in kept])
                    for k in range(len(total)):
                        total[k] += np.bincount(t, np.concatenate([r[k] for _, r in kept]), CELLS)
                    kept.clear()

            for b in batches:
                for _, _, t, starts, _ in _flat(b):
                    kept.append((t, _shares(t, starts, h)[:-1]))
                    size += len(t)
                    if size > _FLUSH:
                        flush()
                        size = 0
            flush()
            yield _sums(total)

        h = _anchored(_gathered(rows.select("terms", "places"), update, len(names)), overall)
        now.unpersist()
    last = spark.sparkContext.broadcast((h.astype(np.float32), names))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, names = last.value
        for b in batches:
            for lo, hi, t, starts, doc in _flat(b):
                m = np.add.reduceat(_shares(t, starts, h)[:-1], starts, axis=1)
                best = m.argmax(axis=0)
                clear = m[best, np.arange(len(best))] >= mass
                hits = np.bincount((doc[clear] - lo) * len(names) + best[clear], minlength=(hi - lo) * len(names)).reshape(hi - lo, -1)
                i, k = np.nonzero((hits > 0) & (hits >= share * np.maximum(b.column("sentences").to_numpy()[lo:hi], 1)[:, None] - 1e-9))
                yield pa.RecordBatch.from_pydict({"ident": b.column("ident").take(pa.array(lo + i)), "subject": pa.array([names[x] for x in k], pa.string())})

    return rows.mapInArrow(assign, schema).distinct().withColumnRenamed("ident", ident)
