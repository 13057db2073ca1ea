"""Secret scans with built-in functions only.

Three fixed patterns give the base spans. Besides, every long run of key characters
is slid over with a window: the counts of the characters in it change by one
leaving and one entering character a step, and with them the sum of c * log2(c)
that gives the Shannon entropy. The threshold depends on the run's character
class; runs on the allow list are passed over.

Positions come from splitting a text by a pattern and extracting the matches: the
lengths of pieces and matches, summed up, are the offsets. All work is inside a
row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeframe.llm.common import unused

# The base patterns and the least length of what they must catch.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # 16 and more; a run that starts AKIA is taken whole, so {12,} after it finds the same
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64"]

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
# Allow list: known public sample keys, UUIDs, dates and numbers with dashes, dashed or slashed words without digits.
ALLOW = [
    "EXAMPLE",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9+/_=-]+$",
    "^[A-Za-z+/_=-]+$",
]
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column) -> Column:
    """Sums of all earlier elements, by chunks, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<long>")

    def append(acc, x):
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def scan(array, start):
        return F.aggregate(array, F.struct(start.alias("sum"), none.alias("out")), append, lambda a: a["out"])

    def chunked(a):
        last = F.floor((F.size(a) - 1) / _CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(a, c * _CHUNK + 1, _CHUNK))
        offsets = lambda cs: scan(F.transform(cs, lambda c: F.aggregate(c, zero, lambda s, x: s + x)), zero)
        return _let(chunks, lambda cs: F.flatten(F.zip_with(cs, offsets(cs), scan)))

    return F.when(F.size(values) == 0, none).otherwise(_let(values, chunked))


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches: structs of start, end (code points), match and, if asked, a group."""
    lens = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def located(f):
        steps = F.zip_with(lens(f), lens(F.slice(pieces, F.lit(1), F.size(f))), lambda m, p: m + p)
        starts = F.zip_with(_running(steps), lens(F.slice(pieces, F.lit(1), F.size(f))), lambda b, p: b + p)
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else f
        return F.transform(
            F.arrays_zip(f.alias("m"), starts.alias("s"), inner.alias("g")),
            lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("match"), x["g"].alias("group")),
        )

    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,group:string>>")
    return F.when(text.rlike(pattern), _let(found, located)).otherwise(empty)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _hot(run: Column, threshold: Column) -> Column:
    """Struct of first and last: the ends of the stretch of ``run`` (0-based, end exclusive)
    from its first to its last window with entropy at or above ``threshold``; -1 if none."""
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    change = lambda code, by, at: F.struct(code.alias("code"), F.lit(by).alias("by"), at.alias("at"))

    def changes(cs):
        return F.flatten(
            F.transform(
                cs,
                lambda c, i: F.when(i < WINDOW, F.array(change(c, 1, i + 1))).otherwise(
                    F.array(change(F.get(cs, i - WINDOW), -1, F.lit(0)), change(c, 1, i + 1))
                ),
            )
        )

    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def step(a, x):
        was = F.get(a["counts"], x["code"])
        total = a["total"] + weight(was + x["by"]) - weight(was)
        hit = (x["at"] >= WINDOW) & (F.round(F.log2(F.lit(float(WINDOW))) - total / WINDOW, 9) >= threshold)
        return F.struct(
            F.transform(a["counts"], lambda c, j: F.when(j == x["code"], c + x["by"]).otherwise(c)).alias("counts"),
            total.alias("total"),
            F.when(hit & (a["first"] < 0), x["at"] - WINDOW).otherwise(a["first"]).alias("first"),
            F.when(hit, x["at"]).otherwise(a["last"]).alias("last"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )
    return F.aggregate(_let(codes, changes), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _entropy_spans(text: Column) -> Column:
    allowed = lambda m: F.lit(False) if not ALLOW else m.rlike("|".join(f"(?:{p})" for p in ALLOW))
    runs = F.filter(_matches(text, CANDIDATE), lambda x: ~allowed(x["match"]))

    def spans_of(x):
        m = x["match"]
        is_hex, is_alnum = m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), m.rlike("^[A-Za-z0-9]+$")
        cls = F.when(is_hex, "hex").when(is_alnum, "alnum").otherwise("base64")
        threshold = F.when(cls == "hex", THRESHOLDS["hex"]).when(cls == "alnum", THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
        kind = F.when(cls == "hex", KINDS.index("entropy_hex")).when(cls == "alnum", KINDS.index("entropy_alnum")).otherwise(KINDS.index("entropy_base64"))
        return _let(
            _hot(m, threshold),
            lambda h: F.struct((x["start"] + h["first"]).alias("start"), kind.alias("kind"), (x["start"] + h["last"]).alias("end"), h["first"].alias("first")),
        )

    hot = F.filter(F.transform(runs, spans_of), lambda s: s["first"] >= 0)
    return F.transform(hot, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``, an array of structs (start, kind, end) in order.

    Starts and ends count code points, ends exclusive; kind is a position in
    ``KINDS``. A null or empty text has no spans. Spans of different kinds may
    overlap. Rows are independent: repeated rows get equal spans.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, 2), lambda x: F.length(x["group"]) >= ASSIGN_LEAST)
    spans = F.concat(_kind(assign, "assign"), _kind(_matches(text, ACCESS), "access"), _kind(_matches(text, HEX), "hex"), _entropy_spans(text))
    return docs.withColumn(out, F.sort_array(spans))


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every maximal stretch of overlapping or touching spans replaced by ``mask``;
    other rows and columns, nulls among them, stay as they are."""
    spans = unused(docs, "secrets")
    found = find_secrets(docs, text_col, spans)
    long0 = F.lit(0).cast("long")

    def step(a, s):
        # A stretch begins with this span unless it begins in or right behind the last one.
        fresh = (s["start"] > a["at"]) | (F.size(a["out"]) == 0)
        cut = F.concat(F.col(text_col).substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mask))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(cut))).otherwise(a["out"]).alias("out"))

    masked = F.aggregate(
        spans,
        F.struct(long0.alias("at"), F.array().cast("array<string>").alias("out")),
        step,
        lambda a: F.concat(F.array_join(a["out"], ""), F.col(text_col).substr(a["at"] + 1, F.length(text_col).cast("long"))),
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(F.col(text_col))).drop(spans)
