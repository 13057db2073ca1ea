"""Trie BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledeframe.llm import queries, triebpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, ids int, decoded string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return triebpe.read_vocabulary(PATH)


def odd_texts():
    rnd = random.Random(4)
    letters = "aaabbetionrsthe  \n\t.,'’éßА中🙂\xa0​\x00-0129_<|>"
    texts = ["", " ", "  ", "\n\n", "a" * 5000, "ab" * 3000, " " * 500 + "x", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|endoftext|>  y"]
    texts += ["a  <|endoftext|>", "end. <|endoftext|> go", "I'm can't we'll I'M", "ÃÂÃÂÃÂÃÂÃÂÃÂ" * 40, "=" * 300, " " * 70, "�" * 9, "déjà vu", "漢字かな交じり文 " * 50, "a b ", " a\nb", "a\r\nb"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 1500), rnd.randint(0x3000, 0x9000), rnd.randint(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(500)]
    return texts


def test_pairs_judged_like_the_merges(library, vocabulary):
    """Words of random letters and of joined tokens, which put every border to the test."""
    rnd = random.Random(1)
    trie = triebpe.Trie(vocabulary)
    tokens = [t for t in vocabulary["ids"] if t.isalpha() and t.isascii()]
    words = ["".join(rnd.choice(tokens).decode() for _ in range(rnd.randint(1, 4))) for _ in range(40_000)]
    words += ["".join(rnd.choice("aehinorst") for _ in range(rnd.randint(1, 14))) for _ in range(40_000)]
    words = sorted({w for w in words if w.isalpha()})
    rnd.shuffle(words)
    ids, bounds = trie.encode([w.encode() for w in words])
    for word, want, a, b in zip(words, library.encode_batch(words, add_special_tokens=False), bounds, bounds[1:]):
        assert ids[a:b].tolist() == want.ids, word


def test_every_token_of_its_own(library, vocabulary):
    """Tokens alone: those that are letters come back as themselves or as the library has them."""
    trie = triebpe.Trie(vocabulary)
    words = [t.decode() for t in vocabulary["ids"] if t.isalpha() and t.isascii()]
    ids, bounds = trie.encode([w.encode() for w in words])
    for word, want, a, b in zip(words, library.encode_batch(words, add_special_tokens=False), bounds, bounds[1:]):
        assert ids[a:b].tolist() == want.ids, word


@pytest.mark.parametrize("spaced", [True, False])
def test_library(spark, library, spaced):
    texts = odd_texts()
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(texts)] + [(None, None, None, None, None), (0, texts[40], None, 2, "")]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").repartition(4)
    words = triebpe.load(spark, PATH)
    got = triebpe.decode(triebpe.encode(df, words, public_tokenizers.PATTERN, spaced=spaced), words).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want, repr(r["text"])
        assert r["decoded"] == library.decode(want, skip_special_tokens=False) == (r["text"] or "")


def test_forgetting_changes_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(triebpe, "REMEMBER", 3)
    monkeypatch.setattr(triebpe, "VERDICTS", 3)
    monkeypatch.setattr(triebpe, "TEXTS", 50)
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(odd_texts()[:400])], SCHEMA).select("doc_id", "text").coalesce(1)
    words = triebpe.load(spark, PATH)
    for r in triebpe.encode(df, words, public_tokenizers.PATTERN, spaced=True).collect():
        assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids


def test_decode_of_any_ids(spark, library):
    words = triebpe.load(spark, PATH)
    rnd = random.Random(2)
    rows = [([rnd.randint(0, 50256) for _ in range(rnd.randint(0, 9))],) for _ in range(500)] + [(None,)]
    for r in triebpe.decode(spark.createDataFrame(rows, "ids array<int>"), words).collect():
        assert r["decoded"] == (None if r["ids"] is None else library.decode(r["ids"], skip_special_tokens=False))
    with pytest.raises(Exception, match="outside the vocabulary"):
        triebpe.decode(spark.createDataFrame([([50257],)], "ids array<int>"), words).collect()


def test_query(spark, library, tmp_path):
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(odd_texts()[:60])] + [(99, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_trie_bpe(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    words = triebpe.load(spark, PATH)
    assert triebpe.decode(triebpe.encode(none, words, public_tokenizers.PATTERN, out="i"), words, "i", "d").collect() == []
