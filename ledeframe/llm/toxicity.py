"""Toxicity by a support vector machine with a gapped-subsequence string kernel and Nyström landmarks.

The kernel of two strings sums, over every sequence of ``GRAM`` letters, the product
of its weights in both; an occurrence weighs ``DECAY`` for each character let in
between, up to ``SPAN`` characters long in all. So "m-o-r-o-n" or "idxiot" still
share sequences with the insult they hide. With bounded gaps a string has a fixed
number of sequences at each position, so the kernel needs no dynamic programming:
against all landmarks at once it is one table look-up per sequence.

Learning uses a bounded sample of labelled documents (``SAMPLE``), each as its
sentence-sized windows. Landmarks are short strings that many toxic and hardly any
clean documents of the sample hold, chosen greedily by the toxic documents not yet
covered by others. Windows are mapped to k(window, landmarks) K^-1/2 and a squared-hinge
machine is fitted there by Newton steps; as a toxic document need be toxic in one
window only, each stands for itself by its highest window, chosen anew each round,
while clean documents give their highest few. A sigmoid over the documents' highest
windows turns decisions into probabilities.

The decision is linear in the kernel, so the fitted machine folds into one table of
sequence weights (4 MB, fixed) that is sent to the tasks; every window of every text
is scored, and a document is as toxic as its most toxic window. No shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledeframe.llm.common import give_back, ship_code

GRAM, SPAN, DECAY = 4, 7, 0.5
WINDOW = 16  # bytes at which the sequences of a window start
SAMPLE = (2000, 4000)  # most toxic and most clean labelled documents to learn from
SAMPLE_CHARS = 20_000  # longest document to learn from
LANDMARKS = 96
EDGE = 31  # what stands between words; sequences of a landmark may begin or end with it
_SHIFT = 5
_PAD = b"\0" * (WINDOW + SPAN)
_GAPS = [((0, *c), DECAY ** (c[-1] + 1 - GRAM)) for c in combinations(range(1, SPAN), GRAM - 1)]


def _classes() -> np.ndarray:
    """Byte to symbol: letters 1 to 26 in either case, digits 27, bytes of other letters 28 to 30, all else ``EDGE``."""
    table = np.full(256, EDGE, np.int32)
    for i in range(26):
        table[65 + i] = table[97 + i] = i + 1
    table[48:58] = 27
    table[0xC0:] = 28
    table[0x80:0xC0] = 29 + np.arange(64) % 32 % 2
    return table


def _codes(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to leave gaps: the code of the sequence at every position, and its weight."""
    n = len(symbols) - SPAN + 1
    if n <= 0:
        return
    moved = [symbols << (_SHIFT * (GRAM - 1 - k)) for k in range(GRAM)]
    for offsets, weight in _GAPS:
        code = moved[0][:n] | moved[1][offsets[1] : offsets[1] + n]
        for k in range(2, GRAM):
            code |= moved[k][offsets[k] : offsets[k] + n]
        yield code, weight


def _profile(landmark: bytes) -> dict[int, float]:
    """The weights of a landmark's sequences."""
    symbols, profile = _classes()[np.frombuffer(landmark, np.uint8)], {}
    for offsets, weight in _GAPS:
        for k in range(len(landmark) - offsets[-1]):
            own = [int(symbols[k + o]) for o in offsets]
            if EDGE not in own[1:-1]:
                code = sum(c << (_SHIFT * (GRAM - 1 - j)) for j, c in enumerate(own))
                profile[code] = profile.get(code, 0.0) + weight
    return profile


def _chunks(texts: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + len(_PAD)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts with blanks between, longer than a window, and where each begins."""
    symbols = _classes()[np.frombuffer(_PAD.join([*texts, b""]), np.uint8)]
    lengths = np.fromiter((len(t) + len(_PAD) for t in texts), np.int64, len(texts))
    return symbols, np.cumsum(lengths) - lengths


def highest(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The highest window sum of each text; 0 for a text without listed sequences."""
    out = []
    for part in _chunks(texts):
        symbols, starts = _join(part)
        score = np.zeros(len(symbols) + 1)
        for code, weight in _codes(symbols):
            score[1 : len(code) + 1] += weights[code] * np.float32(weight)
        total = np.cumsum(score)
        sums = total[WINDOW:] - total[:-WINDOW]  # windows that begin at each position
        # From each text's first byte to its end: a window that begins behind it may reach into the next text.
        bounds = np.column_stack([starts, starts + [len(t) for t in part]]).ravel()
        out.append(np.maximum(np.maximum.reduceat(sums, bounds)[::2], 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def _landmarks(toxic: list[bytes], clean: list[bytes]) -> list[bytes]:
    """Strings found by 4 to 6 of their letters and word edges, best first, by the toxic documents that hold them; a document
    counts half as much for each landmark it already has, and landmarks share no three letters."""

    toxic, clean = [_plain(t) for t in toxic], [_plain(t) for t in clean]
    edge = _classes() == EDGE

    def strings(text: bytes, n: int) -> np.ndarray:
        """The distinct strings of ``n`` bytes, as numbers, without an edge but in the first and the last place."""
        raw = np.frombuffer(text, np.uint8)
        many = max(0, len(raw) - n + 1)
        inner = np.concatenate(([0], np.cumsum(edge[raw])))
        code = np.zeros(many, np.int64)
        for k in range(n):
            code = code << 8 | raw[k : k + many]
        return np.unique(code[inner[n - 1 :][:many] == inner[1:][:many]])

    least = max(3, len(toxic) // 400)
    holders: dict[bytes, np.ndarray] = {}
    wrong: dict[bytes, int] = {}
    for n in (6, 5, 4):  # one length at a time, as arrays of numbers: a few tens of MB for the whole sample
        own = [strings(t, n) for t in toxic]
        listed, many = np.unique(np.concatenate(own), return_counts=True)
        listed = listed[many >= least]
        where = [np.flatnonzero(np.isin(listed, o, assume_unique=True)) for o in own]
        failed = np.zeros(len(listed), np.int64)
        for t in clean:
            failed[np.isin(listed, strings(t, n), assume_unique=True)] += 1
        doc = np.repeat(np.arange(len(own)), [len(w) for w in where])
        which = np.concatenate(where)
        order = np.argsort(which, kind="stable")
        for code, docs, bad in zip(listed.tolist(), np.split(doc[order], np.cumsum(np.bincount(which, minlength=len(listed)))[:-1]), failed.tolist()):
            holders[code.to_bytes(n, "big")], wrong[code.to_bytes(n, "big")] = docs, bad
    odds = (len(toxic) + 1) / (len(clean) + 1)
    left = {s: h for s, h in holders.items() if wrong[s] * odds * 20 <= len(h)}
    chosen: list[bytes] = []
    open_, taken = np.ones(len(toxic)), set()
    while left and len(chosen) < LANDMARKS:
        gain = {s: float(open_[h].sum()) for s, h in left.items()}
        best = max(gain, key=lambda s: (gain[s] - 20 * odds * wrong[s], len(s), s))
        if gain[best] < least:
            break
        open_[left[best]] /= 2
        grown = _extend(best, [toxic[i] for i in left[best]])
        if not any(c in grown for c in chosen):
            chosen.append(grown)
        taken |= {grown[i : i + 3] for i in range(len(grown) - 2)}
        left = {s: h for s, h in left.items() if gain[s] >= least and not any(s[i : i + 3] in taken for i in range(len(s) - 2))}
    return chosen


def _plain(text: bytes) -> bytes:
    """``text`` in small letters with single blanks for all that stands between words, and at both ends."""
    small = bytes(32 if c == EDGE else (i + 32 if 65 <= i <= 90 else i) for i, c in enumerate(_classes()))
    return b" " + b" ".join(text.translate(small).split()) + b" "


def _extend(mark: bytes, texts: list[bytes], most: int = 12) -> bytes:
    """``mark`` with what stands beside it in four of five places, up to the edges of its word."""
    grown = True
    while grown and len(mark) < most:
        grown = False
        for side in (0, 1):
            if mark[-side] == 32:
                continue
            beside: dict[bytes, int] = {}
            for t in texts:
                at = t.find(mark)
                while at >= 0:
                    c = t[at - 1 : at] if side == 0 else t[at + len(mark) : at + len(mark) + 1]
                    beside[c] = beside.get(c, 0) + 1
                    at = t.find(mark, at + 1)
            c = max(beside, key=beside.get, default=b"")
            if c and 5 * beside[c] >= 4 * sum(beside.values()):
                mark, grown = (c + mark if side == 0 else mark + c), True
    return mark


def _windows(texts: list[bytes], profiles: np.ndarray, listed: np.ndarray, most: int) -> list[np.ndarray]:
    """For each text, the landmark kernels (rows) of its ``most`` windows most like some landmark."""
    own = (profiles**2).sum(axis=0)
    out = []
    for part in _chunks(texts, 1 << 16):  # a row of kernels per listed sequence met
        symbols, starts = _join(part)
        places, rows = [], []
        for code, weight in _codes(symbols):
            hit = np.flatnonzero(listed[code] >= 0)
            places.append(hit)
            rows.append(profiles[listed[code[hit]]] * weight)
        place, row = np.concatenate(places), np.concatenate(rows)
        order = np.argsort(place, kind="stable")
        place, total = place[order], np.vstack([np.zeros(row.shape[1]), np.cumsum(row[order], axis=0)])
        kernels = total[np.searchsorted(place, place + WINDOW)] - total[np.searchsorted(place, place)]
        mass = (kernels / own).max(axis=1, initial=0.0)
        bounds = np.searchsorted(place, np.append(starts, len(symbols)))
        for i, j in zip(bounds[:-1], bounds[1:]):
            top = i + np.argsort(-mass[i:j], kind="stable")[:most]
            out.append(kernels[top])
    return out


def fit(toxic: list[bytes], clean: list[bytes], rounds: int = 3, cost: float = 10.0) -> tuple[np.ndarray, float, float]:
    """(weights by sequence code, slope, offset): the probability of a text is
    sigmoid(slope * highest window + offset). Without both kinds, or without a string that
    tells them apart, it is the share of toxic ones for every text."""
    weights = np.zeros(1 << (_SHIFT * GRAM), np.float32)
    share = (len(toxic) + 0.01) / (len(toxic) + len(clean) + 1)
    flat = (weights, 0.0, float(np.log(share / (1 - share))))
    marks = _landmarks(toxic, clean) if toxic and clean else []
    if not marks:
        return flat
    sparse = [_profile(m) for m in marks]
    grams = sorted(set().union(*sparse))
    profiles = np.array([[p.get(g, 0.0) for p in sparse] for g in grams])
    listed = np.full(len(weights), -1, np.int32)
    listed[grams] = np.arange(len(grams))
    values, vectors = np.linalg.eigh(profiles.T @ profiles)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3 * values.max()))) @ vectors.T
    bags = [w @ root for w in _windows(toxic, profiles, listed, 8) if len(w)]
    rest = np.vstack([np.zeros((len(clean), len(marks))), *(w @ root for w in _windows(clean, profiles, listed, 8))])
    if not bags:
        return flat
    picked = [0] * len(bags)
    for _ in range(rounds):
        x = np.vstack([*(b[[k]] for b, k in zip(bags, picked)), rest])
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.concatenate([np.ones(len(bags)), -np.ones(len(rest))])
        pay = cost * np.where(y > 0, 4.0, 1.0)
        w = np.zeros(x.shape[1])
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-3
        for _ in range(30):
            on = y * (x @ w) < 1
            new = np.linalg.solve(ridge + (x[on].T * pay[on]) @ x[on], x[on].T @ (pay[on] * y[on]))
            done = np.allclose(new, w, atol=1e-8)
            w = new
            if done:
                break
        picked = [int(np.argmax(b @ w[:-1])) for b in bags]
    weights[grams] = profiles @ (root @ w[:-1])
    f = np.concatenate([highest(toxic, weights), highest(clean, weights)])
    goal = np.concatenate([np.full(len(toxic), 1 - 1 / (len(toxic) + 2)), np.full(len(clean), 1 / (len(clean) + 2))])
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * f + offset, -30, 30)))
        g = np.array([((p - goal) * f).sum() + 1e-3 * slope, (p - goal).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * f * f).sum() + 1e-3, (v * f).sum()], [(v * f).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - step[0], offset - step[1]
    return weights, float(max(slope, 0.0)), float(offset)


def held_out(doc_id) -> F.Column:
    """Documents that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE) -> tuple[list[bytes], list[bytes]]:
    """Texts of at most ``most`` toxic and clean documents that may be learnt from, by a hash of their id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_by", F.md5(F.col("doc_id").cast("string")))
    short = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", F.col("text").cast("binary").alias("text"))
    kinds = []
    for toxic, per_kind in zip((1, 0), most):
        # At most per_kind ids: a fixed bound for the broadcast.
        ids = known.where((F.col("toxic") > 0) if toxic else (F.col("toxic") <= 0)).orderBy("_by", "doc_id").limit(per_kind)
        rows = short.join(F.broadcast(ids.select("doc_id", "_by")), "doc_id").orderBy("_by", "doc_id", "text").limit(per_kind)
        kinds.append(list(dict.fromkeys(bytes(r["text"]) for r in rows.select("text").collect())))
    return kinds[0], kinds[1]


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of being toxic (double, 0 to 1). Null and empty texts
    get the score of a text without any listed sequence."""
    ship_code()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, slope, offset = shared.value
        for batch in batches:
            values = []
            for i in range(0, len(batch), 1000):
                values.append(highest([t or b"" for t in batch[i : i + 1000].cast(pa.binary()).to_pylist()], weights))
            top = np.concatenate(values) if values else np.zeros(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(slope * top + offset, -60, 60))))
            batch = values = top = None
        give_back()

    return docs.withColumn(out, score(F.col(text_col).cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a score, learnt from ``labels`` (doc_id, toxic). Only texts are scored: neither ids
    nor labels nor other columns are inputs. Repeated rows get equal scores."""
    return toxicity(docs, fit(*labelled_sample(docs.select("doc_id", "text"), labels)))
