"""Weights of an alignment's rows by how much of it they stand for: by clusters of like rows, and by a guide tree's branches.

Rows are (msa_id, row_idx, aseq); weights sum to the number of rows. Position weights are build.position_weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.clusters import distinct_rows, single_linkage

#: Distinct rows of an alignment whose distances a task holds at most: 8 bytes for each two of them.
MOST = 8192


def cluster_weights(rows: DataFrame, least: float = 0.62) -> DataFrame:
    """(msa_id, row_idx, weight): every single-linkage cluster at an identity weighs the same, shared by its rows."""
    c = single_linkage(rows, least)
    sizes = c.groupBy("msa_id", "cluster").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("msa_id")
    each = sizes.withColumn("share", F.sum("n").over(whole) / F.count("*").over(whole) / F.col("n"))  # a row per cluster
    return c.join(each, ["msa_id", "cluster"]).select("msa_id", "row_idx", F.col("share").alias("weight"))


def differences(rows: list[str]) -> np.ndarray:
    """One less the identity of every two rows: equal residues over the residues of the shorter one."""
    grid = np.array([list(r.upper()) for r in rows]) if rows else np.empty((0, 0), str)
    code = np.where(np.char.isalpha(grid), grid.view(np.uint32).reshape(grid.shape).astype(np.int64), -1) if grid.size else np.empty((len(rows), 0), np.int64)
    length = (code >= 0).sum(1)
    out = np.ones((len(rows), len(rows)))
    for i in range(len(rows)):
        same = ((code[i] == code) & (code[i] >= 0)).sum(1)
        shorter = np.minimum(length[i], length)
        out[i] = 1 - np.divide(same, shorter, out=np.zeros(len(rows)), where=shorter > 0)
    np.fill_diagonal(out, 0)
    return out


def guide_tree(d: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (left, right, height) of average linkage over items of sizes; merge k makes item n + k. Of equal distances the first pair comes first."""
    n = len(d)
    d, size, name, height = d.astype(float).copy(), sizes.astype(float).copy(), list(range(n)), []
    np.fill_diagonal(d, np.inf)
    near = d.argmin(1) if n else np.empty(0, int)
    least = d[np.arange(n), near] if n else np.empty(0)
    for k in range(n - 1):
        i = int(least.argmin())
        j = int(near[i])
        height.append((name[i], name[j], float(least[i]) / 2))
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[:, i] = d[i]
        d[j] = d[:, j] = np.inf
        least[j] = np.inf
        size[i] += size[j]
        name[i] = n + k
        stale = np.flatnonzero(((near == i) | (near == j)) & np.isfinite(least))
        for r in {i, *stale.tolist()}:
            near[r] = int(d[r].argmin())
            least[r] = d[r, near[r]]
        closer = np.flatnonzero((d[:, i] < least) | ((d[:, i] == least) & (i < near)))
        near[closer], least[closer] = i, d[closer, i]
    return height


def branch_weights(d: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The weight of one copy of each item: going down from the root, a node's weight goes to its sides as their branches are long, theirs and those below.

    Where a node has no branches at all, it goes by the number of copies. Weights of all copies sum to their number.
    """
    n = len(d)
    total = float(copies.sum())
    if n == 0:
        return np.empty(0)
    merges = guide_tree(d, copies)
    height, length, count = np.zeros(2 * n - 1), np.zeros(2 * n - 1), np.append(copies.astype(float), np.zeros(n - 1))
    sides = []
    for k, (a, b, h) in enumerate(merges, n):
        la, lb = max(0.0, h - height[a]), max(0.0, h - height[b])
        height[k], count[k] = h, count[a] + count[b]
        sides.append((a, b, length[a] + la, length[b] + lb))
        length[k] = length[a] + length[b] + la + lb
    share = np.zeros(2 * n - 1)
    share[-1] = total
    for k in range(2 * n - 2, n - 1, -1):
        a, b, la, lb = sides[k - n]
        part = la / (la + lb) if la + lb > 0 else count[a] / count[k]
        share[a], share[b] = share[k] * part, share[k] * (1 - part)
    return share[:n] / copies


def tree_weights(rows: DataFrame) -> DataFrame:
    """(msa_id, row_idx, weight) by a guide tree of each alignment: rows that share their branches with many weigh little.

    A task has one alignment's distinct rows, with how often each comes. Alignments of more than MOST distinct rows are refused: their
    distances would not fit, and cluster_weights or position_weights do without.
    """
    d = distinct_rows(rows.where("aseq is not null"))
    kind = rows.schema["msa_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST:
            raise ValueError(f"alignment {pdf.msa_id.iat[0]} has {len(pdf)} distinct rows; guide trees are for {MOST} at most")
        pdf = pdf.sort_values("rep")
        return pdf[["msa_id", "aseq"]].assign(weight=branch_weights(differences(pdf.aseq.tolist()), pdf.n.to_numpy()))

    each = d.groupBy("msa_id").applyInPandas(run, f"msa_id {kind}, aseq string, weight double")
    return rows.join(each, ["msa_id", "aseq"]).select("msa_id", "row_idx", "weight")
