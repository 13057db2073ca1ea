"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledeframe.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, words int, n int, id string, shard string, phrase int"


def brute(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = set()
        for q, b in cands.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    if cands.get(q[i : i + k], 1 << 60) <= b:
                        dropped.add(q[i : i + k])
        rows = []
        for p, a in cands.items():
            if p in dropped:
                continue
            score, _, x, y = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def rows_for(seed, docs=120):
    rnd = random.Random(seed)
    vocab = ["a", "b", "C", "É", "中文", "🙂", "der", "Die", "\x00", "x\x0by", "\xa0"]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rnd.randint(0, 60)):
            words += ["New", "york", "City"] if rnd.random() < 0.08 else ["a", "a", "a"] if rnd.random() < 0.05 else [rnd.choice(vocab)]
        text = "".join(w + rnd.choice([" ", "  ", "\t", ". ", "\n", ",", " ", " ", " "]) for w in words)
        out.append((rnd.choice([i, None]), rnd.choice([text] * 9 + [None, ""]), rnd.choice(["en", "en", "en", None, "und", "de"]), 1, 2, "z", "s", None))
    return out + out[:5]


@pytest.mark.parametrize("seed,shards,bits", [(1, 4, 16), (2, 1, 16), (3, 2, 2)])
def test_brute_force(spark, seed, shards, bits):
    rows = rows_for(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = C.collocations(df, least=5, top=40, shards=shards, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute([(r[1], r[2]) for r in rows], 5, top=40)
    assert len(want) > 60 and sorted(tuple(r) for r in got.collect()) == want


def test_a_long_text_and_one_hot_language(spark):
    rows = [(0, "the big red fox jumps " * 40000, "en"), (1, None, None), (2, "", "fr"), (3, ". , ;", "es")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(df, least=100, bits=16).collect()) == brute([(r[1], r[2]) for r in rows], 100)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.collocations(none, bits=16).collect() == []
    phrases, totals = C.count_phrases(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), least=1)
    assert phrases.collect() == [] and totals.collect() == []


def test_products_beyond_64_bits(spark):
    """Scores stay exact where 1000 a n and l r pass 64 bits."""
    a, n, l, r = 3_000_000_019, 9_000_000_000_000_021, 7_000_000_001, 5_000_000_033
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.select(C.floor_score("a", "n", "l", "r").alias("s")).first()["s"] == 1000 * a * n // (l * r)


def test_tables_of_any_size(spark):
    """The least count decides, not the order or the place of the texts."""
    docs = [("a b c", "en")] * 7 + [("a b", "en")] * 3 + [("x", "en")] * 50
    for parts in (1, 5):
        df = spark.createDataFrame(docs, "text string, lang string").repartition(parts)
        phrases, totals = C.count_phrases(df, least=7, shards=2, bits=16)
        found = {tuple(r["words"]): r["n"] for r in phrases.collect()}
        assert found == {("a",): 10, ("b",): 10, ("c",): 7, ("x",): 50, ("a", "b"): 10, ("b", "c"): 7, ("a", "b", "c"): 7}
        assert [tuple(r) for r in totals.collect()] == [("en", 77)]


def test_entries_shared_by_phrases(spark):
    """A phrase whose entry another one set early is counted for a full cycle all the same, and so are longer ones."""
    rnd = random.Random(0)
    vocab, rows = [f"w{i}" for i in range(60)], []
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(0, 40)):
            words += rnd.choices(vocab, weights=[1 / (j + 1) for j in range(60)])
            words += ["new", "york", "city", "hall", "x"] if rnd.random() < 0.15 else []
        rows.append((" ".join(words), rnd.choice(["en", "de", None])))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in C.collocations(df, least=5, shards=2, bits=8).collect()) == brute(rows, 5)


def test_languages_that_end_like_words(spark):
    """A language's name and a word are told apart wherever zero bytes stand in them."""
    rows = [("b\x00c d", "a")] * 6 + [("c d", "a\x00b")] * 7
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(df, least=5, bits=16).collect()) == brute(rows, 5)
