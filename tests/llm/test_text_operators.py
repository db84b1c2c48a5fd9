"""Text operators against brute force, and on nulls, empty tables, repeated rows, very long texts and extra columns with clashing names."""

import collections
import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import charsets
from webloom.llm.boilerplate import furniture_lines, kept_runs
from webloom.llm.leaks import leaks, winnowed
from webloom.llm.near import expanded, similar_pairs, trie_pairs
from webloom.llm.packing import packed, plan
from webloom.llm.site_lines import repeated_lines, without_lines
from webloom.llm.stuffing import spam_pages, stuffed_lines
from webloom.llm.subjects import sentences, subject_rows
from webloom.llm.topn import top_n

WORDS = re.compile(r"[^\W_]+")
PAGE = "page_id long, host string, title string, content string, ident string, line_no int, key string, rep int, source string"


def pages(spark, rows):
    return spark.createDataFrame([(i, h, t, c, "x", 1, "k", 2, "s") for i, h, t, c in rows], PAGE)


def random_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", "big", "big", "big"]), f"i{rng.randrange(300)}", rng.choice([1.0, 2.0, 3.0, None, float("nan"), -1.0])) for _ in range(3000)] + [(None, "x", 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumn("part", F.lit(1)).withColumn("cnt", F.lit(1))
    best = {}
    for g, i, s in rows:
        if g and i and s is not None and s == s:
            best[g, i] = max(s, best.get((g, i), s))
    want = set()
    for g in {k[0] for k in best}:
        for p, (s, i) in enumerate(sorted((-s, i) for (q, i), s in best.items() if q == g)[:4], 1):
            want.add((g, p, i, -s))
    got = [tuple(r) for r in top_n(df.repartition(7), F.col("g"), F.col("s"), F.col("i"), 4).collect()]
    assert len(got) == len(want) and set(got) == want
    assert top_n(df.limit(0), F.col("g"), F.col("s"), F.col("i"), 4).count() == 0


def test_repeated_lines(spark):
    rows = [(i, "h", None, f"Menu  {i}\n\nown {'x' * i}\n \n  MENU {i} ") for i in range(6)] + [(9, "h", None, None), (10, None, None, "Menu 1"), (11, "other", None, "Menu 1"), (0, "h", None, "Menu  0\n\nown \n \n  MENU 0 ")]
    df = pages(spark, rows)
    got = {tuple(r) for r in repeated_lines(df, "page_id", "host", "content", 5).collect()}
    assert got == {(i, n) for i in range(6) for n in (1, 5)}
    blanks = pages(spark, [(i, "h", None, ["Accept all", "\u00a0ACCEPT\u00a0all", "Accept \t\u00a0 all\u00a0"][i % 3]) for i in range(6)])
    assert repeated_lines(blanks, "page_id", "host", "content", 5).count() == 6
    dated = pages(spark, [(i, "h", None, f"one line\n{'x' * i}") for i in range(6)]).withColumn("day", F.expr("case when page_id < 5 then date'2024-01-01' else date'2024-01-02' end"))
    assert repeated_lines(dated, "page_id", "host", "content", 5, 5, "day", 2).count() == 6
    assert repeated_lines(dated, "page_id", "host", "content", 5, 5, "day", 3).count() == 0
    same = pages(spark, [(i, "h", None, "one text\nfor all") for i in range(9)])
    assert repeated_lines(same, "page_id", "host", "content", 5).count() == 18
    assert repeated_lines(same, "page_id", "host", "content", 5, min_clusters=2).count() == 0
    assert repeated_lines(df.limit(0), "page_id", "host", "content").count() == 0
    clean = {r["page_id"]: r["content"] for r in without_lines(same.limit(1).union(pages(spark, [(50, "h", None, None)])), "page_id", "content", same.select("page_id", F.lit(1).alias("line_no"))).collect()}
    assert set(clean.values()) == {"for all", None}


@pytest.mark.parametrize("budget", [0, 5, 12])
def test_trie_join(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 256, (12, 4), dtype=np.uint8)
    rows = base[rng.integers(0, 12, 150)] ^ (rng.random((150, 4)) < 0.2).astype(np.uint8)
    shard = np.sort(rng.integers(0, 4, 150))
    order = np.lexsort((*rows.T[::-1], shard))
    rows, shard = rows[order], shard[order]
    want = {(i, j) for i, j in itertools.combinations(range(150), 2) if shard[i] == shard[j] and np.bitwise_count(rows[i] ^ rows[j]).sum() <= budget}
    got = [(int(i), int(j)) for a, b in trie_pairs(shard, rows, budget) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [20_000, 5])
def test_near_duplicates(spark, block):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        words = random_text(rng, rng.choice([3, 12, 60, 150])).split()
        for _ in range(rng.choice([1, 2, 4])):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            rows.append((n, "h", None, rng.choice([" ", ", "]).join(w)))
            n += 1
    rows += [(900, "h", None, "ab"), (901, "h", None, "ab"), (902, "h", None, "AB"), (903, "h", None, ""), (904, "h", None, None), (None, "h", None, "ab"), (905, "h", None, "a b c " * 20_000), rows[0]]
    sets = {}
    for i, _, _, c in rows:
        if i is not None and c is not None:
            w = WORDS.findall(c.lower())
            sets[i] = (set(zip(w, w[1:], w[2:])), c)
    want = {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if sets[i][1] == sets[j][1] or sets[i][0] and len(sets[i][0] & sets[j][0]) / len(sets[i][0] | sets[j][0]) >= 0.7}
    got = [tuple(r) for r in expanded(*similar_pairs(pages(spark, rows), "page_id", "content", 3, 0.7, block=block)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert expanded(*similar_pairs(pages(spark, rows).limit(0), "page_id", "content", 3, 0.7)).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 50, 60).astype(np.uint64), rng.integers(0, 50, 60).astype(np.uint64)
        b[20:32] = a[7:19]
        assert set(winnowed(a, np.array([60]), 5, 8)[0]) & set(winnowed(b, np.array([60]), 5, 8)[0])


def test_leaks(spark):
    rng = random.Random(4)
    items = [(k, random_text(rng, 30, 60)) for k in range(8)] + [(98, "short one"), (99, None), (None, "x")]
    docs = []
    for d in range(40):
        w = random_text(rng, 80, 60).split()
        if d % 2:
            s, n = rng.randrange(10), rng.choice([11, 12, 13, 20])
            w[10 : 10 + n] = items[d % 8][1].split()[s : s + n]
        docs.append((d, None, None, rng.choice([" ", "\n", " - "]).join(x.upper() if d % 3 else x for x in w)))
    docs += [(70, None, None, None), (71, None, None, ""), docs[1], (72, None, None, "É" * 100_000)]
    fold = lambda t: WORDS.findall("".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))
    grams = collections.defaultdict(set)
    for k, t in items:
        w = fold(t or "")
        for i in range(len(w) - 11):
            grams[tuple(w[i : i + 12])].add(k)
    want = {(d, k) for d, _, _, t in docs for w in [fold(t or "")] for i in range(len(w) - 11) for k in grams.get(tuple(w[i : i + 12]), ())}
    frame = spark.createDataFrame(items, "item long, ident string")
    got = [tuple(r) for r in leaks(pages(spark, docs), "page_id", "content", frame, "item", "ident").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert leaks(pages(spark, docs), "page_id", "content", frame.limit(0), "item", "ident").count() == 0


def test_packing(spark):
    for sizes in ([700, 700, 650, 600, 1400, 1399, 2048, 1, 1, 3, 683, 682], [], [5] * 1000, list(range(1, 2049))):
        hist = collections.Counter(sizes)
        runs, n = plan(dict(hist), 2048)
        room, placed = collections.Counter(), collections.Counter()
        for s, first, k, c in runs:
            assert first == placed[s]
            placed[s] += k
            for x in range(k):
                room[c + x] += s
        assert placed == hist and all(0 < v <= 2048 for v in room.values()) and len(room) == n
    rows = [(1, None, None, "one two three"), (2, None, None, "x y " * 5000), (3, None, None, None), (4, None, None, ""), (None, None, None, "a"), (1, None, None, "one two three")]
    got = packed(pages(spark, rows), "page_id", "content", 64).toPandas()
    assert got[got.tokens > 0].groupby("container").tokens.sum().max() <= 64 and (got.page_id == 1).sum() == 2
    two = got[got.page_id == 2].sort_values("piece")
    assert (two.tokens.iloc[:-1] == 64).all() and list(two.piece) == list(range(len(two)))
    assert got[got.page_id.isin([3, 4])].container.isna().all()
    assert packed(pages(spark, rows).limit(0), "page_id", "content").count() == 0


def test_garbled_round_trip(spark):
    rng = random.Random(6)
    clean = ["Für Müller zählt nur die Größe, nicht der Läufer.", "„Die Ärztin ist müde“, sagte er früh.", "Über die Brücke führt der schöne Weg."]
    rows, want = [], set()
    for p in range(120):
        lines = [rng.choice(clean) for _ in range(5)] + ["plain ascii"]
        if p % 6 == 0:
            lines = [charsets_break(x) for x in lines[:4]] + lines[4:]
            want |= {(p, n) for n in range(1, 5)}
        rows.append((p, "h", None, "\n".join(lines)))
    rows += [(500, "h", None, "why é shows up as Ã© in old dumps"), (501, None, None, None), (502, None, "t", "")]
    hints = spark.createDataFrame([(1, "utf8", None), (1, "UTF-8", "x"), (None, "a", "b")], "page_id long, a string, b string")
    df = pages(spark, rows)
    found = charsets.garbled_lines(df, "page_id", "host", "content", "title", hints, ("a", "b"))
    assert {(r["page_id"], r["line_no"]) for r in found.collect()} == want
    fixed = {r["line"] for r in charsets.repaired(df, "page_id", "content", found).collect()}
    assert fixed <= set(clean) and fixed
    assert charsets.garbled_lines(df.limit(0), "page_id", "host", "content", "title", hints, ("a", "b")).count() == 0


def test_garbled_titles(spark):
    rng = random.Random(11)
    clean = ["Für Müller zählt nur die Größe", "Über die Brücke führt der schöne Weg", "Die Ärztin grüßt die müden Läufer"]
    rows, want = [], set()
    for p in range(120):
        title, lines = rng.choice(clean), [rng.choice(clean) for _ in range(4)]
        if p % 6 == 0:
            want.add((p, 0, title))
            want |= {(p, n, x) for n, x in enumerate(lines, 1)}
            title, lines = charsets_break(title), [charsets_break(x) for x in lines]
        rows.append((p, "h", title, "\n".join(lines)))
    rows.append((500, "h", charsets_break(clean[0]), None))
    want.add((500, 0, clean[0]))
    df = pages(spark, rows)
    found = charsets.garbled_lines(df, "page_id", "host", "content", "title", spark.createDataFrame([], "page_id long, a string, b string"), ("a", "b"))
    assert {tuple(r) for r in charsets.repaired(df, "page_id", "content", found, "title").select("page_id", "line_no", "line").collect()} == want
    assert {tuple(r) for r in charsets.repaired(df, "page_id", "content", found).select("page_id", "line_no", "line").collect()} == {x for x in want if x[1]}


def charsets_break(line):
    table = charsets._table("cp1252")[0]
    return "".join(table[b] for b in line.encode())


@pytest.mark.parametrize("chain", range(1, len(charsets.CHAINS) - 1))
def test_chains_invert(chain):
    true, wrong, times = charsets.CHAINS[chain]
    for text in ("äöüßéñ", "ąćęłńóśźż", "привет"):
        try:
            s = text
            for _ in range(times):
                raw = s.encode() if true == "utf-8" else bytes(charsets._table(true)[1][c] for c in s)
                s = "".join(charsets._table(wrong)[0][b] for b in raw)
        except KeyError:
            continue
        assert charsets.undone(s, chain) == (text, 0)


def test_kept_runs():
    rng = random.Random(7)
    for _ in range(200):
        s = [rng.choice([-3, -1, 1, 2, 4]) for _ in range(rng.randrange(1, 9))]
        keep = kept_runs(s, None, 1.5)
        score = lambda k: sum(x for x, y in zip(s, k) if y) - 1.5 * max(0, sum(y and not z for y, z in zip(k, [False, *k])) - (1 if k[0] else 0)) + 0.0
        assert abs(score(keep) - max(score(k) for k in itertools.product([False, True], repeat=len(s)))) < 1e-9


def make_site(n):
    rng = random.Random(8)
    body = lambda: " ".join(rng.choice(["the", "and", "of", "to"]) if k % 3 == 0 else f"{rng.choice('bdfgklmn')}{rng.choice('aeiou')}{rng.choice('lrnst')}{rng.choice('aeiou')}t" for k in range(20)).capitalize() + "."
    return [(i, f"h{i % 2}.example", f"Story {i} of the day", f"Home | News | About\nStory {i} of the day\n{body()}\n\n{body()}\nShare this page\n{body()}\n© 2024 H. All rights reserved.") for i in range(n)]


def test_furniture(spark):
    rows = make_site(60)
    df = pages(spark, [*rows, (900, None, None, None), (901, None, None, ""), rows[0]])
    got = {tuple(r) for r in furniture_lines(df, "page_id", "host", "title", "content").collect()}
    assert got == {(i, n) for i in range(60) for n in (1, 6, 8)}
    assert furniture_lines(df.limit(0), "page_id", "host", "title", "content").count() == 0


def test_own_lists_stay(spark):
    rng = random.Random(21)
    word = lambda: f"{rng.choice('bdfgklmn')}{rng.choice('aeiou')}{rng.choice('lrnst')}{rng.choice('aeiou')}t"
    say = lambda: " ".join(rng.choice(["the", "and", "of", "to"]) if k % 3 == 0 else word() for k in range(20)).capitalize() + "."
    lists = (
        lambda: f"- {rng.randrange(9, 400)} {word()}, {word().title()} {word()}", lambda: f"{word()}: {word()} {word()} {word()}", lambda: f"{word().title()} {rng.randrange(9)}:{rng.randrange(9)} {word().title()} ({word()})",
        lambda: f"{word().title()} {word()} red SKU{rng.randrange(10**5):05} -{rng.randrange(5, 60)}% {rng.randrange(9, 99)},99",
    )
    rows = []
    for i in range(80):
        own = [lists[i % 4]() for _ in range(8)]
        text = [say(), *own, say()] if i % 8 < 4 else [say(), say(), *own]
        rows.append((i, f"h{i % 2}.example", f"{word()} {word()} {word()}".capitalize(), "\n".join(["Home | News | About", *text, "Share this page", "© 2024 H. All rights reserved."])))
    got = {tuple(r) for r in furniture_lines(pages(spark, rows), "page_id", "host", "title", "content").collect()}
    assert got == {(i, n) for i in range(80) for n in (1, 12, 13)}


def test_furniture_of_copies(spark):
    rng = random.Random(12)
    say = lambda: " ".join(rng.choice(["zorb", "quix", "plim", "vask", "jund", "wemp"]) for _ in range(18)).capitalize() + "."
    article = f"Home | News | About\nThe quix article\n{say()}\n{say()}\n{say()}\nShare this page\n© 2024 H. All rights reserved."
    rows = [*make_site(60), *[(200 + i, "h0.example", "The quix article", article) for i in range(40)], (300, "h0.example", "More of it", f"Home | News | About\nMore of it\n{say()}\n{say()}\nShare this page")]
    df = pages(spark, rows)
    got = {tuple(r) for r in furniture_lines(df, "page_id", "host", "title", "content").collect()}
    assert {x for x in got if x[0] >= 200} == {(200 + i, n) for i in range(40) for n in (1, 6, 7)} | {(300, 1), (300, 5)}


def test_spam(spark):
    rows = make_site(40)
    spam = [(100, "h0.example", None, "\n".join("buy lamp cheap lamp best lamp online lamp sale lamp" for _ in range(8))), (101, "h1.example", "cheap", "\n".join(f"Lamp red SKU{i} -10% 9,99" for i in range(20))), (102, "h1.example", "x", "\n".join(f"www.a{i}.example/x" for i in range(20)))]
    df = pages(spark, [*rows, *spam, (900, None, None, None), (901, "h", None, " \n ")])
    assert {r[0] for r in spam_pages(df, "page_id", "host", "title", "content").collect()} == {100, 101, 102}
    assert not stuffed_lines(pa.array(["Some story missed the morning; others seemed quiet to the man."]))[0].any()
    garbled = "«Вечер большой», — сказал Selmork, — «но сосед ждёт 44 дней». «Лес большой», — сказал Horwull, — «но сосед ждёт 9 дней»."
    assert not stuffed_lines(pa.array([garbled, charsets_break(garbled)]))[0].any()
    assert stuffed_lines(pa.array(["Looking for top lamp? Our lamp is the online lamp for lamp in Town, price lamp.", "cheap lamp, buy lamp, sale rug, best lamp, free rug, top rug, 2025 lamp, deal rug"]))[0].all()


@pytest.mark.parametrize("words", [40, 150])
def test_spam_under_notices(spark, words):
    rng = random.Random(13)
    say = lambda n: " ".join(rng.choice(["the", "and", "of"]) if k % 3 == 0 else f"{rng.choice('bdfgklmn')}{rng.choice('aeiou')}{rng.choice('lrnst')}{rng.choice('aeiou')}t" for k in range(n)).capitalize() + "."
    notice, stuffed = say(words), "buy lamp cheap lamp best lamp online lamp sale lamp"
    rows = [(i, "h.example", None, f"{notice}\n{say(30)}") for i in range(8)] + [(100, "h.example", None, f"{notice}\n{stuffed}\n{stuffed}\n{say(12)}"), (101, "h.example", None, f"{notice}\n{stuffed}\n{say(25)}")]
    keep = {f"#zone{x}{d}": 6.0 for x in "nhHtbp" for d in range(4)}  # every line is text by its weights, as notices may be
    assert [r[0] for r in spam_pages(pages(spark, rows), "page_id", "host", "title", "content", keep).collect()] == [100]


def test_subjects(spark):
    rng = random.Random(9)
    terms = {"law": ["court", "ruling", "plaintiff", "statute"], "sport": ["striker", "goal", "referee", "league"], "food": ["dough", "oven", "garlic", "broth"]}
    say = lambda k: f"The {rng.choice(terms[k])} of the {rng.choice(terms[k])} was seen near a {rng.choice(terms[k])} in the town."
    rows, labels, want = [], [], set()
    for i in range(400):
        kinds = rng.sample(sorted(terms), rng.choice([1, 2]))
        rows.append((i, None, None, " ".join(say(k) for k in kinds for _ in range(4))))
        want |= {(i, k) for k in kinds}
        if i % 4 == 0:
            labels += [(i, k) for k in kinds]
    rows += [(900, None, None, None), (901, None, None, ""), (902, None, None, "Nothing of it."), rows[0]]
    frame = spark.createDataFrame([*labels, (5, None), (None, "law")], "page_id long, subject string")
    got = [tuple(r) for r in subject_rows(pages(spark, rows), "page_id", "content", frame, "page_id", "subject").collect()]
    assert len(got) == len(set(got)) and len(set(got) ^ want) <= 0.02 * len(want)
    assert subject_rows(pages(spark, rows), "page_id", "content", frame.limit(0), "page_id", "subject").count() == 0
    assert subject_rows(pages(spark, rows).limit(0), "page_id", "content", frame, "page_id", "subject").count() == 0
    found, per = sentences(["One. Two!\nThree", "", "12. \n Über 3; a.b"])
    assert found.to_pylist() == ["One.", "Two!", "Three", "Über 3; a.b"] and per.tolist() == [3, 0, 1]
