"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Distinct vectors of a label are dealt to tiles by a hash; every pair of tiles is one small task. There the vectors are quantised
to int8, a product of whole tiles estimates all cosines, and the quantisation errors bound how far each estimate can be off. Pairs
whose interval lies above the threshold are links, pairs below are none, only the others are computed in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.components import components
from palisade.llm.tables import materialise

#: a product of this many int8 pairs is exact in float32
_EXACT = 1024
_SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of the decoded vectors and norms of what is lost, for rows of unit length."""
    scale = np.abs(unit).max(1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _EXACT):
        out += a[:, at:at + _EXACT].astype(np.float32) @ b[:, at:at + _EXACT].astype(np.float32).T
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Which pairs of rows have at least the cosine ``threshold``; how many were computed in double precision."""
    norms_a, norms_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / norms_a[:, None], b / norms_b[:, None]
    qa, sa, da, ea = quantise(ua)
    qb, sb, _, eb = quantise(ub)
    estimate = code_products(qa, qb) * sa[:, None] * sb[None, :]
    bound = da[:, None] * eb[None, :] + ea[:, None] + _SLACK
    sure = estimate - bound >= threshold
    i, j = np.nonzero((estimate + bound >= threshold) & ~sure)
    for at in range(0, len(i), 1 << 16):
        k = slice(at, at + (1 << 16))
        exact = np.einsum("nd,nd->n", a[i[k]], b[j[k]]) / (norms_a[i[k]] * norms_b[j[k]])
        good = exact >= threshold
        sure[i[k][good], j[k][good]] = True
    return sure, len(i)


def usable(vector: str) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


_OUT = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _tile_task(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        first = table.column("first").to_numpy()
        own = table.column("own_pair").to_numpy(zero_copy_only=False)
        flat = table.column("vector").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        vectors = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(rep), -1)
        a = np.flatnonzero(first)
        b = a if own.any() else np.flatnonzero(~first)
        if not len(a) or not len(b):
            return _OUT.empty_table()
        pair, _ = linked(vectors[a], vectors[b], threshold)
        if own.any():
            pair |= pair.T
            np.fill_diagonal(pair, False)
        links = np.zeros(len(rep), np.int64)
        links[a] = pair @ copies[b]
        if not own.any():
            links[b] = pair.T @ copies[a]
        # smallest vector reachable within this task
        root = rep.copy()
        rows, columns = np.nonzero(pair)
        rows, columns = a[rows], b[columns]
        while len(rows):
            was = root.copy()
            np.minimum.at(root, rows, was[columns])
            np.minimum.at(root, columns, root[rows])
            if (root == was).all():
                break
        hit = links > 0
        return pa.table([pa.array(rep[hit]), pa.array(links[hit]), pa.array(root[hit])], schema=_OUT)
    return work


def embedding_links(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    tile: int = 1024) -> DataFrame:
    """Every row with ``n_links``, ``component_id`` and ``kept``; two vectors of one label link at cosine >= ``threshold``.

    Equal vectors of a label are compared once and counted as often as they occur. A tile holds about ``tile`` vectors by a hash
    of the id, so no task gathers a whole label. Vectors that are null, empty, zero or hold null or non-finite components, rows
    without label or without id, and vectors of different lengths link with nothing: 0 links, their own id as component, kept.
    Rows that repeat an id and its vector count as further vectors. An empty table gives an empty table.
    """
    rows = vectors.drop("n_links", "component_id", "kept")
    good = usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()
    chosen = rows.where(good).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    classes = materialise(chosen.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    sized = classes.withColumn("dims", F.size("vector"))
    tiles = sized.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles"))
    dealt = sized.join(tiles, ["label", "dims"]).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "label", "dims", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"),
        (F.col("t") <= F.col("other")).alias("first"), (F.col("t") == F.col("other")).alias("own_pair"), "rep", "copies", "vector")
    found = materialise(pairs.groupBy("label", "dims", "i", "j").applyInArrow(_tile_task(threshold), "rep long, links long, root long"), "tile-links")
    roots = components(found, "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    marked = rows.withColumn("_good", good)
    out = marked.join(named, F.col("_good") & (marked[label] == F.col("_label")) & (marked[vector] == F.col("_vector")), "left")
    return out.select(
        *rows.columns, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", F.col(key).cast("long")).alias("component_id"),
        F.coalesce(F.col("_component") == F.col(key), F.lit(True)).alias("kept"))
