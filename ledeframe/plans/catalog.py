"""Registry of checkable queries: a Spark plan and (where SQL can say it) the
equivalent DuckDB SQL over the same parquet tables.

Conventions that keep the two sides comparable: integer results are BIGINT,
doubles are rounded to 6 decimals, arrays are rendered as comma-joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def i64(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def arr_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---------------------------------------------------------------------------
# DuckDB fragments shared by several oracle queries.
# ---------------------------------------------------------------------------

KERAS_FILTERS_SQL = "'!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10)"
KERAS_SPACES_SQL = "repeat(' ', 34)"


def sql_keras_tokens(expr: str) -> str:
    return (
        f"list_filter(string_split(translate(lower({expr}), {KERAS_FILTERS_SQL}, {KERAS_SPACES_SQL}), ' '), "
        "lambda w: w <> '')"
    )


def sql_clean_alnum(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '[^a-z0-9\\s]', '', 'g')"


def sql_uniform(seed: int, *parts: str) -> str:
    key = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def sql_bits(seed: int, *parts: str) -> str:
    key = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT)"


HEADLINES_SQL = """
SELECT d.doc_id, d.text AS title,
       CASE WHEN l.quality = 1 THEN 'political' ELSE 'non-political' END AS category,
       l.quality AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

HEADLINES_RAW_SQL = """
SELECT d.doc_id, d.text AS title, d.lang,
       CASE WHEN l.quality = 1 THEN 'political' WHEN l.quality = 0 THEN 'non-political' END AS category
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

PREDICTIONS_SQL = "SELECT doc_id, quality AS y, toxic AS pred FROM labels"

LOGITS_SQL = """SELECT vec_id, list_transform(range(10), lambda j: list_reduce(list_transform(list_filter(embedding, lambda v, i: (i - 1) % 10 = j),
                                                                               lambda v: v::DOUBLE), lambda a, b: a + b, 0.0::DOUBLE)) AS z, label FROM embeddings"""

PROBABILITIES_SQL = """
SELECT vec_id, 1.0 / (1.0 + exp(-list_reduce(list_transform(embedding, lambda v: v::DOUBLE), lambda a, b: a + b, 0.0::DOUBLE))) AS p, label
FROM embeddings
"""

EPOCH_LOG_SQL = """
SELECT user_id AS run_id, ts, event_id, value AS val_loss,
       CAST(json_extract(props, '$.k') AS DOUBLE) / 100.0 AS f1,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch
FROM events
"""


def sql_vocab(src: str, text_expr: str, id_col: str = "doc_id") -> str:
    """CTEs ``_toks(doc, w, i)``, ``_wc(word, n, df, fd, fp)``, ``vocab(word, n, df, id)``."""
    return f"""
_src AS ({src}),
_tl AS (SELECT {id_col} AS doc, {sql_keras_tokens(text_expr)} AS toks FROM _src),
_toks AS (SELECT _tl.doc, u.w, u.i FROM _tl, unnest(_tl.toks) WITH ORDINALITY AS u(w, i)),
_wc AS (SELECT w AS word, count(*) AS n, count(DISTINCT doc) AS df, min(struct_pack(d := doc, p := i)) AS f FROM _toks GROUP BY w),
vocab AS (SELECT word, n, df, CAST(row_number() OVER (ORDER BY n DESC, f.d, f.p) + 1 AS INTEGER) AS id FROM _wc)
"""


def sql_encode(max_words: int) -> str:
    """CTE ``enc(doc, ids)`` over ``_tl`` / ``_toks`` / ``vocab`` (see ``sql_vocab``)."""
    return f"""
_ids AS (SELECT t.doc, t.i, coalesce(v.id, 1) AS id FROM _toks t LEFT JOIN (SELECT word, id FROM vocab WHERE id < {max_words}) v ON t.w = v.word),
_agg AS (SELECT doc, list(id ORDER BY i) AS ids FROM _ids GROUP BY doc),
enc AS (SELECT _tl.doc, coalesce(_agg.ids, []::INTEGER[]) AS ids FROM _tl LEFT JOIN _agg ON _tl.doc = _agg.doc)
"""


def sql_quotas(cnt: str, label: str, val_share: float) -> str:
    """CTE ``quota(label, class_n, train_n, val_n)`` from a CTE ``cnt(label, c)``."""
    return f"""
_q0 AS (SELECT {label}, c, sum(c) OVER () AS n FROM {cnt}),
_q1 AS (SELECT *, ceil({val_share}::DOUBLE * n::DOUBLE) AS nval FROM _q0),
_q2 AS (SELECT *, n - nval AS ntrain FROM _q1),
_q3 AS (SELECT *, c::DOUBLE / n::DOUBLE * ntrain::DOUBLE AS cont FROM _q2),
_q4 AS (SELECT *, floor(cont) AS fl FROM _q3),
_q5 AS (SELECT *, ntrain - sum(fl) OVER () AS need, row_number() OVER (ORDER BY cont - fl DESC, {label} NULLS FIRST) AS rk FROM _q4),
quota AS (SELECT {label}, CAST(c AS BIGINT) AS class_n, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS train_n,
                 CAST(c - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS BIGINT) AS val_n FROM _q5)
"""


def sql_stratified(src: str, label: str, id_col: str, seed: int = 42, val_share: float = 0.2) -> str:
    """CTE ``split_rows`` = ``src`` rows plus ``split`` ('train' first in hash order)."""
    return f"""
_s AS ({src}),
_cnt AS (SELECT {label}, count(*) AS c FROM _s GROUP BY {label}),
{sql_quotas('_cnt', label, val_share)},
_rk AS (SELECT _s.*, row_number() OVER (PARTITION BY _s.{label} ORDER BY {sql_bits(seed, '_s.' + id_col)}, _s.{id_col}) AS _r FROM _s),
split_rows AS (SELECT _rk.* EXCLUDE (_r), CASE WHEN _rk._r <= q.train_n THEN 'train' ELSE 'val' END AS split
               FROM _rk JOIN quota q ON _rk.{label} IS NOT DISTINCT FROM q.{label})
"""
