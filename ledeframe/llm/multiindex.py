"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut into halves, each with its own codebook; the pair of nearest codes
is a vector's cell in the product grid. A vector visits cells in the order of their
summed distances (multi-sequence traversal: a heap over the two sorted lists of codes)
and is compared with the vectors that live there. How many cells it visits is measured
when the codebooks are fitted: as many as find the target share of partners placed at
exactly the least cosine in random directions. Whatever is found is verified in double
precision.

Vectors of each length have codebooks of their own and link only among themselves. Equal
vectors of a label are one before the search. A shard holds the cells of one label, one
length and one first code: residents come once, a visitor once with its list of second codes.
Shards are compared in square tiles, so one that holds a third of the vectors is spread
over many tasks; a tile returns, for each of its vectors, how many partners it found and
one link to the least vector it hangs together with there, never the pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledeframe.llm.common import connected_components, cut_lineage, ship_code

SAMPLE = 20_000  # vectors the codebooks are fitted on
PROBES = 2_000  # vectors the number of visits is measured on
PER_CELL = 64  # vectors of all labels in a cell, about
MOST_CODES = 1024
TILE = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; none is zero."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances less the row's own square."""
    return (codes * codes).sum(axis=1) - 2 * x @ codes.T


def fit_codes(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spread rows; an empty code keeps its place."""
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, codes).argmin(axis=1)
        sums, many = np.zeros_like(codes), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        codes[many > 0] = sums[many > 0] / many[many > 0, None]
    return codes


def visits(d1: np.ndarray, d2: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cells (code, code) in order of d1 + d2, at most ``most``."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, done = [(a[0] + b[0], 0, 0)], 0
    while heap and done < most:
        _, i, j = heapq.heappop(heap)
        yield o1[i], o2[j]
        done += 1
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def fit_index(sample: np.ndarray, total: int, least: float, recall: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Codebooks of both halves and the number of cells to visit."""
    x = unit(sample)
    half = max(1, x.shape[1] // 2)
    k = max(1, min(MOST_CODES, math.ceil(math.sqrt(total / PER_CELL)), len(x)))
    one, two = fit_codes(x[:, :half], k), fit_codes(x[:, half:], k)
    rng = np.random.default_rng(0)
    probe = x[:PROBES]
    aside = rng.standard_normal(probe.shape)
    aside -= (aside * probe).sum(axis=1, keepdims=True) * probe
    size = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    partner = least * probe + math.sqrt(max(0.0, 1 - least * least)) * aside / np.where(size > 0, size, 1)
    home1, home2 = _nearest(partner[:, :half], one).argmin(axis=1), _nearest(partner[:, half:], two).argmin(axis=1)
    d1, d2 = _nearest(probe[:, :half], one), _nearest(probe[:, half:], two)
    # The partner's cell comes after all cells that are nearer.
    place = np.array([((d1[r][:, None] + d2[r][None, :]) < d1[r][home1[r]] + d2[r][home2[r]]).sum() for r in range(len(probe))])
    return one, two, int(np.quantile(place, recall, method="higher")) + 1


def _tile(residents: dict, visitors: dict, codes: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root) of the vectors of a tile that have a partner in it."""
    y, x = unit(residents["vector"]), unit(visitors["vector"])
    visited = np.zeros((len(x), codes), bool)
    visited[np.repeat(np.arange(len(x)), visitors["many"]), visitors["seconds"]] = True
    cosine = x @ y.T
    found = (cosine >= least) & visited[:, residents["second"]] & (visitors["rep"][:, None] != residents["rep"][None, :])
    xi, yi = np.nonzero(found)
    if not len(xi):
        return (np.zeros(0, np.int64),) * 3
    # Does the resident visit the visitor's home as well? Then it counts the pair there.
    homes, home = np.unique(visitors["home"], return_inverse=True)
    goes = np.zeros((len(y), len(homes)), bool)
    owner = np.repeat(np.arange(len(y)), residents["many"])
    at = np.searchsorted(homes, residents["cells"]).clip(max=len(homes) - 1)
    hit = homes[at] == residents["cells"]
    goes[owner[hit], at[hit]] = True
    alone = ~goes[yi, home[xi]]
    reps = np.unique(np.concatenate([visitors["rep"][xi], residents["rep"][yi]]))
    a, b = np.searchsorted(reps, visitors["rep"][xi]), np.searchsorted(reps, residents["rep"][yi])
    links = np.zeros(len(reps), np.int64)
    np.add.at(links, a, residents["n"][yi])
    np.add.at(links, b[alone], visitors["n"][xi[alone]])
    root = np.arange(len(reps))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return reps, links, reps[root]
        root = new


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, recall: float = 0.995
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows linked directly: the same label and length and a cosine of
    at least ``least``. component_id is the least id reachable by links, itself included;
    kept is vec_id = component_id. Rows with a null label, or whose vector is null, empty,
    zero or holds null or non-finite components link with
    nothing. Rows that repeat an id are rows like others; a null id is passed over for
    component_id unless there is no other. No rows give no rows.
    """
    ship_code()
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = base.withColumn("vector", F.when(finite & F.exists("vector", lambda x: x != 0), F.col("vector")))
    base = cut_lineage(base.withColumn("row", F.monotonically_increasing_id()))
    good = base.where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    copies = good.groupBy("label", "vector")
    reps = cut_lineage(copies.agg(F.min("vec_id").alias("first"), F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("d", F.size("vector")))
    totals = {r["d"]: r["count"] for r in reps.groupBy("d").count().collect()}
    if not totals:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = {}
    for d, total in totals.items():
        if total > 1:  # a vector alone has copies only
            sample = reps.where(F.col("d") == d).select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
            index[d] = fit_index(np.array([r["vector"] for r in sample]), total, least, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # at most 2 x MOST_CODES half vectors for each length
    label_type = dict(reps.dtypes)["label"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for d in pc.unique(whole.column(4)).to_pylist():
                batch = whole.filter(pc.equal(whole.column(4), d))
                one, two, most = shared.value.get(d, (None,) * 3)
                if one is None:
                    continue
                x = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d))
                half, codes = one.shape[1], len(one)
                d1, d2 = _nearest(x[:, :half], one), _nearest(x[:, half:], two)
                cells = [[i * codes + j for i, j in visits(a, b, most)] for a, b in zip(d1, d2)]
                added = [pa.array([codes] * batch.num_rows, pa.int32()), pa.array(cells, pa.list_(pa.int32()))]
                yield pa.record_batch([*batch.columns, *added], names=["rep", "label", "vector", "n", "d", "codes", "cells"])

    kind = dict(reps.dtypes)["vector"]
    placed = reps.select("rep", "label", "vector", "n", "d").mapInArrow(place, f"rep long, label {label_type}, vector {kind}, n long, d int, codes int, cells array<int>")
    placed = cut_lineage(placed.withColumn("home", F.get("cells", F.lit(0))))
    code = lambda c: F.floor(c / F.col("codes")).cast("int")
    residents = placed.withColumn("first", code(F.col("home")))
    firsts = F.array_distinct(F.transform("cells", code))
    visitors = placed.withColumn("first", F.explode(firsts)).withColumn("cells", F.filter("cells", lambda c: code(c) == F.col("first")))
    shard = ["label", "d", "first"]
    blocks = lambda name: F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name)
    sizes = residents.groupBy(*shard).agg(blocks("rb")).join(visitors.groupBy(*shard).agg(blocks("vb")), shard)
    side = lambda df, own, other, kind_: (
        df.join(sizes, shard)
        .withColumn(own, F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .withColumn("kind", F.lit(kind_))
    )
    tiles = side(residents, "rb", "vb", 0).unionByName(side(visitors, "vb", "rb", 1))

    def compare(tile: pa.Table) -> pa.Table:
        codes = tile["codes"][0].as_py()

        def part(kind_: int) -> dict:
            t = tile.filter(pc.equal(tile["kind"], kind_)).combine_chunks()
            vector, cells = (t[c].combine_chunks() if t.num_rows else None for c in ("vector", "cells"))
            if vector is None:
                return {}
            lists = cells.flatten().to_numpy(zero_copy_only=False)
            home = t["home"].to_numpy()
            return {
                "rep": t["rep"].to_numpy(), "n": t["n"].to_numpy(), "home": home, "second": home % codes,
                "vector": vector.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1),
                "many": np.asarray(pc.list_value_length(cells)), "cells": lists, "seconds": lists % codes,
            }

        residents_, visitors_ = part(0), part(1)
        out = (np.zeros(0, np.int64),) * 3
        if residents_ and visitors_:
            out = _tile(residents_, visitors_, codes, least)
        return pa.table(dict(zip(("rep", "links", "root"), map(pa.array, out))))

    found = tiles.groupBy(*shard, "rb", "vb").applyInArrow(compare, "rep long, links long, root long")
    found = cut_lineage(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    grouped = reps.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least_id = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(least_id, "root").join(links, "rep", "left")
    named = named.select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = base.join(named, ["label", "vector"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
