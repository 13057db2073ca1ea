"""Phrase collocation mining by dynamic itemset counting.

Texts are cut once into tables of word numbers, dealt over ``shards`` parts of the
corpus. The parts are scanned in a cycle, one per step, and phrases of all lengths are
counted in the same scan: words from step 0, and a phrase of k + 1 words from the step
after both of its phrases of k words (without the last word, without the first) have
reached the least count, however few shards those have seen by then. A phrase is
counted for one full cycle from its first step, so its count is exact then; the scan
goes on until every phrase that was activated has completed its cycle.

Tasks learn what has been reached from a table of ``2 ** bits`` bytes: the entry that a
phrase hashes to holds the step at which the first phrase of that entry reached the least
count. Its size is a parameter, whatever the corpus. Phrases that share an entry may
be activated without need; they are counted like others, for one full cycle, and are
judged by their own count; none begins before both of its phrases have begun. First steps are
read from the table alone and an entry is set once, so all tasks agree.

Counts are summed per block of text before they are shuffled and only phrases in their
cycle are carried from step to step. Keys are 64-bit hashes of the phrase without its
last word and of the last word; a last check raises an error if two different phrases that
reach the least count share a hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledeframe.llm.common import give_back, ship_code, written

LONGEST = 5
NEVER = 255  # entry of a phrase that has not reached the least count
BLOCK = 1 << 18  # words that are numbered together
GRAMS = 1 << 20  # occurrences whose counts a task adds up before they leave it
# ASCII letters in lower case; what ends a piece becomes a line feed and a tab a blank.
CLEAN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in bytes(range(256)).lower())


class Numbers(dict):
    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


def _block(lang: str, texts: list[bytes], shard: int) -> pa.RecordBatch:
    numbers = Numbers()
    numbers[b"\n"]
    flat = b"\n".join(texts).replace(b"\n", b" \n ").split(b" ")
    tokens = np.fromiter(map(numbers.__getitem__, filter(None, flat)), np.int32)
    tokens = np.append(tokens, np.int32(0)) - np.int32(1)
    ends = np.append(False, (tokens[1:] < 0) & (tokens[:-1] < 0))
    tokens = tokens[~ends]
    words = list(numbers)[1:]
    counts = np.bincount(tokens[tokens >= 0], minlength=len(words))
    # The commonest words get the least numbers, which pack best.
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order) + 1, np.int32)
    place[order], place[-1] = np.arange(len(order), dtype=np.int32), -1
    words = [words[i] for i in order.tolist()]
    head = lang.encode()
    head = b"%d:%s" % (len(head), head)  # no other language and word begin so
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words))
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard], pa.int32()),
            "lang": [lang],
            "words": pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
            "counts": pa.array([counts[order]], pa.list_(pa.int64())),
            "hashes": pa.array([hashes.view(np.int64)], pa.list_(pa.int64())),
            "tokens": [place[tokens].tobytes()],
        }
    )


def _blocks(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> DataFrame:
    """(shard, lang, words, counts, hashes, tokens): the texts of one language in a stretch of a task, as
    its different words, how often each occurs, their 64-bit hashes (of language and word), and the texts as
    numbers of words, with -1 after every piece."""
    ship_code()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[str, int], list[bytes]] = {}
        size: dict[tuple[str, int], int] = {}
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                text = (text.as_py() or "").encode().translate(CLEAN)
                key, turn = (lang, turn % shards), turn + 1
                held.setdefault(key, []).append(text)
                size[key] = size.get(key, 0) + len(text)
                if size[key] >= 6 * BLOCK:
                    yield _block(lang, held.pop(key), key[1])
                    size[key] = 0
        while held:
            (lang, shard), texts = held.popitem()
            yield _block(lang, texts, shard)
        give_back()

    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(cut, "shard int, lang string, words array<string>, counts array<long>, hashes array<long>, tokens binary")


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of a phrase from those of the phrase before its last word and of the last word."""
    h = (left ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) + right
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _grams(h: np.ndarray, real: np.ndarray, reached: np.ndarray, step: int, shards: int, longest: int):
    """Per length from 2, of the phrases whose cycle includes ``step``: (length, key of the phrase, key of the phrase without
    its last word, key of the last word, first step), one entry per occurrence."""
    mask = np.uint64(len(reached) - 1)
    at = np.flatnonzero(real)
    key, since = h[at], reached[h[at] & mask].astype(np.int16)
    known = since < NEVER
    at, key, since = at[known], key[known], since[known]
    begun = np.zeros(len(at), np.int16)
    for length in range(2, longest + 1):
        # A phrase needs the one that begins a word later, which stands next in the list if it is known.
        if len(at) < 2:
            return
        pair = np.flatnonzero(at[1:] == at[:-1] + 1)
        # An entry may be set by another phrase before its own phrases are counted.
        first = np.maximum(np.maximum(since[pair], since[pair + 1]) + 1, np.maximum(begun[pair], begun[pair + 1]))
        started = first <= step
        pair, first = pair[started], first[started]
        at, left = at[pair], key[pair]
        last = h[at + (length - 1)]
        key = _mix(left, last)
        now = first + shards > step
        yield length, key[now], left[now], last[now], first[now]
        since = reached[key & mask].astype(np.int16)
        known = since < NEVER
        at, key, since, begun = at[known], key[known], since[known], first[known]


def _summed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases in ``parts``, each occurrence being (key, key without the last word, key of the last word, kind)."""
    key, left, last, kind = (np.concatenate(x) for x in zip(*parts))
    _, where, n = np.unique(key, return_index=True, return_counts=True)
    for i in range(0, len(where), 1 << 16):
        part = where[i : i + (1 << 16)]
        columns = [left[part].view(np.int64), last[part].view(np.int64), kind[part].astype(np.int64), n[i : i + (1 << 16)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["head", "last", "kind", "n"])


def _scan(blocks: DataFrame, table: Broadcast, step: int, shards: int, longest: int) -> DataFrame:
    """(head, last, kind, n): occurrences, added up in each task, of the phrases whose cycle includes ``step``. A phrase is known by
    the keys of what is before its last word and of that word; kind is 256 * length + first step."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.frombuffer(zlib.decompress(table.value), np.uint8)
        held, size = [], 0
        for batch in batches:
            for hashes, tokens in zip(batch["hashes"], batch["tokens"]):
                tokens = np.frombuffer(tokens.as_py(), np.int32)
                known = np.append(hashes.values.to_numpy(zero_copy_only=False).view(np.uint64), np.uint64(0))
                for length, key, left, last, first in _grams(known[tokens], tokens >= 0, reached, step, shards, longest):
                    held.append((key, left, last, first + np.int16(256 * length)))
                    size += len(key)
                if size >= GRAMS:
                    yield from _summed(held)
                    held, size = [], 0
        if size:
            yield from _summed(held)
        held = []
        give_back()

    return blocks.where(F.col("shard") == step % shards).select("hashes", "tokens").mapInArrow(count, "head long, last long, kind long, n long")


def _with_key(phrases: DataFrame) -> DataFrame:
    ship_code()

    @arrow_udf("long")
    def key(head: pa.Array, last: pa.Array) -> pa.Array:
        left, right = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (head, last))
        return pa.array(_mix(left, right).view(np.int64))

    return phrases.select("*", key("head", "last").alias("id"))


def _mark(reached: np.ndarray, step: int, *tables: DataFrame) -> int:
    """Sets the entries of the ``id``s in ``tables`` that are not set yet to ``step``; how many."""
    bits = len(reached).bit_length() - 1
    entry = F.col("id").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    ids = tables[0].select("id")
    for more in tables[1:]:
        ids = ids.unionByName(more.select("id"))
    maps = ids.groupBy(F.bitmap_bucket_number(entry).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(entry)).alias("bits"))
    new = 0
    for row in maps.collect():  # at most 2 ** bits bits
        found = np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")) + (row["bucket"] - 1) * 32768
        found = found[reached[found] == NEVER]
        reached[found] = step
        new += len(found)
    return new


def count_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = LONGEST, shards: int = 2, bits: int = 24
) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of up to ``longest`` words that occur ``least`` times in their language.

    Returns (phrases, totals): phrases has lang, words (array), n (occurrences within
    pieces, overlaps included), single words among them; totals has lang and n, all
    occurrences of words. Null texts are empty, a null language is ``und``; languages
    without a word do not appear. No rows give no rows. Repeated rows count as often as they
    stand there. ``shards`` and ``bits`` change time, not results: the counts of phrases
    in their cycle are shuffled once per step, so more shards start longer phrases sooner and shuffle more.
    """
    spark = docs.sparkSession
    blocks = written(_blocks(docs, text_col, lang_col, shards))
    reached = np.full(1 << bits, NEVER, np.uint8)
    counted, words, found = None, None, []
    first = F.col("kind").bitwiseAND(F.lit(255))
    step = latest = 0
    while step <= latest + shards:  # what was activated last begins at latest + 1 and needs a full cycle
        if step < shards:
            pairs = F.explode(F.arrays_zip("words", "counts", "hashes")).alias("w")
            fresh = blocks.where(F.col("shard") == step).select("lang", pairs).select("lang", F.col("w.words").alias("word"), F.col("w.hashes").alias("id"), F.col("w.counts").alias("n"))
            words = written((words.unionByName(fresh) if words else fresh).groupBy("lang", "word", "id").agg(F.sum("n").alias("n")))
        often = [words.where(F.col("n") >= least)] if step < shards else []
        if step:
            table = spark.sparkContext.broadcast(zlib.compress(reached.tobytes(), 1))
            fresh = _scan(blocks, table, step, shards, longest)
            live = counted.where(first + shards > step) if counted else None
            both = live.unionByName(fresh) if live else fresh
            counted = written(both.groupBy("head", "last", "kind").agg(F.sum("n").alias("n")))
            table.destroy()
            reaching = counted.where(F.col("n") >= least)
            reaching = written(_with_key(reaching))
            often.append(reaching)
            found.append(reaching.where(first + shards - 1 == step).select("id", "head", "last", F.shiftright("kind", 8).alias("length"), "n"))
        if _mark(reached, step, *often):
            latest = step
        step += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") >= least)
    last = words.select(F.col("id").alias("last"), "word")
    level = words.select("lang", "id", F.array("word").alias("words"), "n")
    levels = [level]
    phrases = None
    for f in found:
        phrases = f if phrases is None else phrases.unionByName(f)
    for length in range(2, longest + 1):
        if phrases is None:
            break
        heads = level.select("lang", F.col("id").alias("head"), F.col("words").alias("before"))
        level = phrases.where(F.col("length") == length).join(heads, "head").join(last, "last")
        level = written(level.select("lang", "id", F.concat("before", F.array("word")).alias("words"), "n"))
        levels.append(level)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    _one_each(whole)
    return whole.select("lang", "words", "n"), totals


def _one_each(phrases: DataFrame) -> None:
    if not phrases.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        raise ValueError("two phrases share a hash")


def floor_score(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 a n / (l r)) of the named columns, exact up to 38 digits."""
    wide = [f"cast({c} as decimal(19, 0))" for c in (a, n, l, r)]
    return F.expr("(cast(1000 as decimal(4, 0)) * {} * {}) div ({} * {})".format(*wide))


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = 100,
    longest: int = LONGEST,
    top: int = 2000,
    shards: int = 2,
    bits: int = 24,
) -> DataFrame:
    """The strongest phrases of every language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts lose the case of A-Z and are split at ``.,;:!?`` and line ends into pieces, those at
    blanks and tabs into words. Phrases of 2 to ``longest`` words that occur a >= ``least``
    times are candidates. Cut after k words, with l and r the counts of both parts and n that of all
    words, one scores floor(1000 a n / (l r)); the cut with the least score counts, of equal ones
    that after fewer words. Candidates that stand in a longer one as frequent are dropped, and
    the first ``top`` by score, a (both descending) and phrase (by bytes) are returned. See ``count_phrases`` for nulls,
    empty texts, repeated rows and empty tables.
    """
    counted, totals = count_phrases(docs, text_col, lang_col, least, longest, shards, bits)
    counted = written(counted)
    known = counted.select("lang", _text(F.col("words")).alias("part"), "n")
    candidates = counted.where(F.size("words") > 1).select("lang", "words", _text(F.col("words")).alias("phrase"), F.col("n").alias("a"))

    size = F.size("words")
    starts = F.explode(F.sequence(F.lit(1), size - 1)).alias("i")
    inner = candidates.where(size > 2).select("lang", "words", "a", starts)
    inner = inner.select("lang", "words", "a", "i", F.explode(F.sequence(F.lit(2), F.least(size - 1, size - F.col("i") + 1))).alias("k"))
    inner = inner.select("lang", _text(F.slice("words", F.col("i"), F.col("k"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))

    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", _text(F.slice("words", F.lit(1), F.col("k"))).alias("left"), _text(F.slice("words", F.col("k") + 1, size)).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    cuts = cuts.withColumn("score", floor_score("a", "n", "l", "r"))
    best = F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each of many parts, then the first of those: no task sorts all phrases of a language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(256)).alias("part")
    first = scored.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
