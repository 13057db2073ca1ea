"""One registered query per corpus operator, over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledeframe.llm import triebpe
from ledeframe.llm.bpe import decode, encode, load
from ledeframe.llm.chat import END, START, format_chats
from ledeframe.llm.collocations import collocations
from ledeframe.llm.common import documents, table
from ledeframe.llm.mixing import mix
from ledeframe.llm.multiindex import near_vectors
from ledeframe.llm.quality import quality_verdicts
from ledeframe.llm.repair import damage, digests, repair_conversations
from ledeframe.llm.secrets import ACCESS, ALLOW, ASSIGN, ASSIGN_LEAST, CANDIDATE, HEX, KINDS, THRESHOLDS, WINDOW, find_secrets, render
from ledeframe.llm.simhash import simhash_groups
from ledeframe.llm.substrings import remove_repeats
from ledeframe.llm.suffixes import remove_repeated_bytes
from ledeframe.llm.toxicity import held_out, score_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: 3-word shingles, at most 2 differing bits."""
    return simhash_groups(documents(spark, sf_dir), shingle=3, max_bits=2)


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans."""
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"), "text", "found").select("doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    base = F.filter("found", lambda s: s["kind"] <= KINDS.index("hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(render(base), 256).alias("base_sha256"),
        render(F.col("found")).alias("spans"),
    )


def _sql_spans(kind: int, pattern: str, keep: str = "true") -> str:
    """Rows (doc_id, kind, s, e, m) of a pattern's matches."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {kind} AS kind, s, s + length(m) AS e, m FROM (
      SELECT doc_id, ms[i] AS m, gs[i] AS g,
             list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT
             + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
      FROM (SELECT doc_id, ms, gs, ps, unnest(generate_series(1, len(ms))) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {2 if kind == 0 else 0}) AS gs,
               string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')))) WHERE {keep}"""


def _op8_sql() -> str:
    allow = "|".join(f"(?:{p})" for p in ALLOW)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_sql_spans(0, ASSIGN, f"length(g) >= {ASSIGN_LEAST}")} UNION ALL {_sql_spans(1, ACCESS)} UNION ALL {_sql_spans(2, HEX)}),
cand AS (SELECT *, CASE WHEN regexp_matches(m, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN 3 WHEN regexp_matches(m, '^[A-Za-z0-9]+$') THEN 4 ELSE 5 END AS k
         FROM ({_sql_spans(9, CANDIDATE)}) WHERE NOT regexp_matches(m, '{allow}')),
win AS (SELECT doc_id, k, s, p, round(list_aggregate(string_split(substr(m, p + 1, {WINDOW}), ''), 'entropy'), 9) AS h
        FROM (SELECT doc_id, k, s, m, unnest(generate_series(0, length(m) - {WINDOW})) AS p FROM cand)),
extra AS (SELECT doc_id, k AS kind, s + min(p) AS s, s + max(p) + {WINDOW} AS e FROM win
          WHERE h >= CASE k WHEN 3 THEN {THRESHOLDS["hex"]} WHEN 4 THEN {THRESHOLDS["alnum"]} ELSE {THRESHOLDS["base64"]} END GROUP BY doc_id, k, s),
spans AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT doc_id, kind, s, e FROM extra),
named AS (SELECT *, [{", ".join(f"'{k}'" for k in KINDS)}][kind + 1] || ':' || s || ':' || e AS txt FROM spans),
agg AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
        string_agg(txt, ',' ORDER BY s, kind) FILTER (kind <= 2) AS base, string_agg(txt, ',' ORDER BY s, kind) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id"""


ORACLE["op8_secret_scans"] = _op8_sql()


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the fitted rules."""
    found = quality_verdicts(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, with its source's size and target."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op7_source_mixing"] = """
WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           md5('42|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM b GROUP BY source),
tot AS (SELECT sum(source_size)::BIGINT AS total FROM s0),
s1 AS (SELECT *, coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS held, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS opened
       FROM s0 WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT min_by((total - held)::DOUBLE / opened::DOUBLE, held) AS level FROM s1, tot WHERE (total - held)::DOUBLE / opened::DOUBLE * w <= 3 * source_size),
s AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, w * level) AS target FROM s0, lvl),
p AS (SELECT b.*, s.source_size, s.target, sum(size) OVER (PARTITION BY b.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source),
f AS (SELECT doc_id, size, k, source, c, (c * source_size + upto)::DOUBLE / target AS fin FROM p, (SELECT unnest([0, 1, 2]) AS c) WHERE size > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY fin, k, doc_id NULLS FIRST, source NULLS FIRST, c ROWS UNBOUNDED PRECEDING) AS words FROM f),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM q, tot WHERE words <= total GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken FROM p LEFT JOIN t ON p.doc_id = t.doc_id"""


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id and digests of the byte-level BPE round trip of each text."""
    vocabulary = load(docs.sparkSession, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = encode(docs.select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN, spaced=True).select("doc_id", "ids")
    return decode(ids, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document: number of ids, digest of the ids, digest of the bytes they decode to."""
    return bpe_digests(documents(spark, sf_dir))


TOXIC_FROM = 0.7


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels outside the held-out third."""
    scored = score_documents(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document when windows of 20 words that start earlier elsewhere go."""
    found = remove_repeats(documents(spark, sf_dir), size=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))



ORACLE["op6_substring_dedup"] = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
firsts AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS f FROM win GROUP BY k),
later AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (k) WHERE f.d <> win.doc_id OR f.i <> win.i),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = words.doc_id AND g.p = words.p)
         GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document when strings of 200 bytes that occur twice go."""
    found = remove_repeated_bytes(documents(spark, sf_dir), size=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that is no snapshot of a longer one, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE["op1_chat_formatting"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, role, text, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text))),
p AS (SELECT conv_id, n, m, string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix FROM n),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE n = m GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < m))
SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' ORDER BY n) AS chat
FROM n WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id"""


@query
def op3_embedding_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings of one label, cosine 0.93 and more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of 2 to 5 words of every language, of those that occur 100 times and more."""
    return collocations(documents(spark, sf_dir), least=100, longest=5, top=2000)


ORACLE["op13_collocations"] = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
pos AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
f AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*)::BIGINT AS f
      FROM pos, (SELECT unnest(generate_series(1, 5)) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a FROM f WHERE k > 1 AND f >= 100),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.a >= 100 * c.a
         AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y
        FROM (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, unnest(generate_series(1, k - 1)) AS j FROM kept)),
s AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cut JOIN n USING (lang) JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM best
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged by a fixed rule: its faults, the cheapest repair and a digest of what it gives."""
    turns = table(spark, sf_dir, "conversations")
    report, rows = repair_conversations(damage(turns))
    line = rows.withColumn("line", F.concat("role", F.lit(":"), "text"))
    found = report.join(digests(line, "conv_id", ["stretch", "place"], "line").withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    found = found.withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


ORACLE["op11_conversation_repair"] = """
WITH RECURSIVE
crc AS (SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) AS t
        FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS c)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
             lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1])), 4294967295) % 20 AS kind FROM raw, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0)),
n AS (SELECT *, row_number() OVER w AS j, lead(role) OVER w AS next,
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
      FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text))),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS initial FROM n),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (next IS NOT NULL AND initial || left(next, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m
          FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES ('', '', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
        ('', 'u', 5, 'I', ['user:']), ('', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']),
        ('u', 'a', 5, 'I', ['assistant:']), ('a', 'u', 5, 'I', ['user:']), ('u', 'u', 10, 'II', ['assistant:', 'user:']), ('a', 'a', 10, 'II', ['user:', 'assistant:'])) v(s0, s1, ic, ie, ir)),
step AS (SELECT * FROM (VALUES ('D', '', ''), ('D', 's', 's'), ('D', 'u', 'u'), ('D', 'a', 'a'), ('K', '', 's'), ('K', '', 'u'), ('K', 's', 'u'), ('K', 'u', 'a'), ('K', 'a', 'u'),
        ('R', '', 'u'), ('R', 's', 'u'), ('R', 'u', 'a'), ('R', 'a', 'u')) v(e, s1, s2)),
walk AS (SELECT conv_id, 0::BIGINT AS j, '' AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS rows FROM facts
  UNION ALL
  SELECT conv_id, j, s, b.cost, b.audit, b.rows FROM (
    SELECT w.conv_id, w.j + 1 AS j, step.s2 AS s, min(struct_pack(
        cost := w.cost + ic + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN 5 ELSE 0 END, audit := w.audit || ie || e,
        rows := list_concat(list_concat(w.rows, ir), CASE e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE step.s2 WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] END))) AS b
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.j = w.j + 1 JOIN ins ON ins.s0 = w.s JOIN step ON step.s1 = ins.s1
    WHERE e = 'D' OR (fault NOT IN ('b', 'd') AND (e = 'R' OR f.initial = step.s2))
    GROUP BY w.conv_id, w.j, step.s2)),
done AS (SELECT w.conv_id, min(struct_pack(cost := w.cost + ic, audit := w.audit || ie, rows := list_concat(w.rows, ir))) AS b
         FROM walk w JOIN facts ON facts.conv_id IS NOT DISTINCT FROM w.conv_id AND w.j = facts.m JOIN ins ON ins.s0 = w.s WHERE ins.s1 = 'a' OR (w.s = '' AND ins.s1 = '') GROUP BY w.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.rows, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id"""


@query
def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE of every document by a trie of its words: number of ids, digest of the ids, digest of the text they decode to."""
    vocabulary = triebpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    ids = triebpe.encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN, spaced=True).select("doc_id", "ids")
    return triebpe.decode(ids, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
