"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Vectors compare only within a label. Equal vectors of a label are one class from the start; class
representatives are dealt by hash into shards of bounded size, and each shard gets a graph. Every
vector queries every shard of its label: shards meet in pairs, and in a pair each side's vectors run
a beam search over the other side's graph, so what either direction finds is found. A query's beam
is widened while its worst entry still passes the threshold. An audit holds a fixed share of each
pair's queries against brute force; while it misses a link, all beams of the pair are doubled, up
to beams that hold the whole shard (every vector is reachable from the entries, so these are exact).
Cosines of what was found are verified in double precision. A pair of shards returns link counts and
a spanning forest, never its links; forests are united across pairs.

Shards meet in blocks: a task gets the graphs of two blocks of shards and holds all pairs between them.
A label of many shards has blocks of several, as many as `held` bytes of graphs allow, so that a graph is
sent once per block of its label, not once per shard. Blocks are dealt by their numbers, so a task that
is run again gets the same ones.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label or
null id, link with nothing. Vectors of different lengths never compare. Repeated rows link with each
other as equal vectors. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpointed, scratch, stored
from seqloom.llm.graph import components

#: Vectors of a shard, links of a node, beam while building, first beam of a query, audited share.
SHARD, LINKS, BUILD_BEAM, BEAM, AUDIT = 8192, 12, 48, 48, 16
#: Bytes of the graphs of one block of shards, and blocks that a label should have at least, so that its pairs spread over tasks.
HELD, BLOCKS = 64 << 20, 16


class Graph:
    """A navigable small-world hierarchy over unit vectors (float32), built in batches."""

    def __init__(self, x: np.ndarray, links: int = LINKS):
        self.x, self.links = x, links
        n = len(x)
        draw = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 6)
        level[:1] = max(level.max(initial=0), 0)  # the first node stands on every level and is the entry
        self.near = [np.full((n, 2 * links if at == 0 else links), -1, np.int32) for at in range(int(level.max(initial=0)) + 1)]
        self.roots = np.zeros(1, np.int32)
        done, step = 1, 1
        while done < n:
            new = np.arange(done, min(n, done + step))
            self._insert(new, level[new])
            done, step = done + len(new), min(256, step * 2)
        self.roots = self._entries(n)

    def _beam(self, q: np.ndarray, start: np.ndarray, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities (queries x width, best first, -1 beyond) of a beam search on a level."""
        near, m = self.near[at], len(q)
        seen = np.zeros((m, len(self.x)), bool)
        mark = np.zeros((m, len(self.x)), np.int32)
        rows = np.arange(m)[:, None]
        ids = np.full((m, max(width, start.shape[1])), -1, np.int32)
        sims = np.full(ids.shape, -np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        ok = start >= 0
        sims[:, : start.shape[1]] = np.where(ok, np.einsum("md,mkd->mk", q, self.x[np.where(ok, start, 0)]), -np.inf)
        seen[np.nonzero(ok)[0], start[ok]] = True
        opened = np.zeros(ids.shape, bool)
        active, fan = np.arange(m), max(4, ids.shape[1] // 16)  # a wide beam opens more of its nodes at once
        while len(active):
            r = np.arange(len(active))[:, None]
            a_ids, a_sims, a_open = ids[active], sims[active], opened[active]
            todo = np.where((a_ids >= 0) & ~a_open, a_sims, -np.inf)
            pick = np.argpartition(-todo, min(fan, todo.shape[1]) - 1, axis=1)[:, :fan]
            live = todo[r, pick] > -np.inf
            a_open[r, pick] = True
            new = near[np.where(live, a_ids[r, pick], 0)]
            new = np.where(live[:, :, None], new, -1).reshape(len(active), -1)
            ok = new >= 0
            safe = np.where(ok, new, 0)
            ok &= ~seen[active[:, None], safe]
            place = np.broadcast_to(np.arange(1, new.shape[1] + 1, dtype=np.int32), new.shape)
            rr, cc = np.nonzero(ok)
            mark[active[rr], new[rr, cc]] = place[rr, cc]
            ok[rr, cc] = mark[active[rr], new[rr, cc]] == place[rr, cc]  # once, though several links lead there
            rr, cc = np.nonzero(ok)
            seen[active[rr], new[rr, cc]] = True
            found = np.full(new.shape, -np.inf, np.float32)
            found[rr, cc] = np.einsum("kd,kd->k", q[active[rr]], self.x[new[rr, cc]])
            all_sims = np.concatenate([a_sims, found], 1)
            all_ids = np.concatenate([a_ids, np.where(ok, new, -1)], 1)
            all_open = np.concatenate([a_open, np.zeros(new.shape, bool)], 1)
            best = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[active], sims[active], opened[active] = all_ids[r, best], all_sims[r, best], all_open[r, best]
            active = active[((ids[active] >= 0) & ~opened[active]).any(1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return ids[rows, order][:, :width], sims[rows, order][:, :width]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.zeros((len(q), 1), np.int32)
        for at in range(len(self.near) - 1, 0, -1):
            start = self._beam(q, start, at, 1)[0]
        extra = np.broadcast_to(self.roots, (len(q), len(self.roots)))
        extra = np.where(extra == start, -1, extra)
        return self._beam(q, np.concatenate([start, extra], 1).astype(np.int32), 0, width)

    def _select(self, own: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
        """For each node, up to count of its candidates: those nearer to it than to any chosen before, then the nearest."""
        ok = (ids >= 0) & (ids != own[:, None])
        vec = self.x[np.where(ok, ids, 0)]
        sims = np.where(ok, np.einsum("md,mkd->mk", self.x[own], vec), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        r = np.arange(len(own))[:, None]
        ids, sims, vec = np.where(ok, ids, -1)[r, order], sims[r, order], vec[r, order]
        again = np.zeros(ids.shape, bool)
        again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0)
        among = vec @ vec.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -np.inf, np.float32)
        for j in range(ids.shape[1]):
            take = (ids[:, j] >= 0) & ~again[:, j] & (closest[:, j] < sims[:, j]) & (kept.sum(1) < count)
            kept[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, among[:, j]), closest)
        rank = np.where(kept, 0, np.where((ids >= 0) & ~again, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :count]
        out = np.where(rank[r, order] < 2, ids[r, order], -1)
        full = np.full((len(own), count), -1, np.int32)
        full[:, : out.shape[1]] = out
        return full

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.x[new]
        start = np.zeros((len(new), 1), np.int32)
        for at in range(len(self.near) - 1, -1, -1):
            found = self._beam(q, start, at, BUILD_BEAM if at == 0 or (level >= at).any() else 1)[0]
            start = found[:, :1]
            here = np.flatnonzero(level >= at)
            if not len(here):
                continue
            own = new[here]
            among = np.broadcast_to(own.astype(np.int32), (len(own), len(own)))
            if len(own) > LINKS:
                sims = q[here] @ q[here].T
                among = own[np.argpartition(-sims, LINKS, axis=1)[:, : LINKS + 1]].astype(np.int32)
            chosen = self._select(own, np.concatenate([found[here], among], 1), self.links)
            self.near[at][own, : self.links] = chosen
            to, back = chosen.ravel(), np.repeat(own, chosen.shape[1])
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            to, back = to[to >= 0], back[to >= 0]
            if not len(to):
                continue
            nodes, first, count = np.unique(to, return_index=True, return_counts=True)
            for lo in range(0, len(nodes), 512):
                some, f, c = nodes[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
                more = np.full((len(some), int(c.max())), -1, np.int32)
                for k in range(more.shape[1]):
                    more[c > k, k] = back[f[c > k] + k]
                if more.shape[1] > 64:
                    sims = np.where(more >= 0, np.einsum("md,mkd->mk", self.x[some], self.x[np.maximum(more, 0)]), -np.inf)
                    more = np.take_along_axis(more, np.argpartition(-sims, 63, axis=1)[:, :64], 1)
                width = self.near[at].shape[1]
                self.near[at][some] = self._select(some, np.concatenate([self.near[at][some], more], 1), width)

    def _entries(self, n: int) -> np.ndarray:
        """Nodes from which every node is reached on the lowest level."""
        reached, roots, at = np.zeros(n, bool), [], 0
        while at < n:
            if reached[at]:
                at += 1
                continue
            roots.append(at)
            edge = np.array([at])
            reached[at] = True
            while len(edge):
                ahead = np.unique(self.near[0][edge])
                ahead = ahead[ahead >= 0]
                edge = ahead[~reached[ahead]]
                reached[edge] = True
        return np.array(roots, np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def linked(graph: Graph, base: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """queries x base booleans: pairs found by the graph with cosine >= least in double precision."""
    n, width = len(base), min(BEAM, len(base))
    audit = np.arange(0, len(queries), AUDIT)
    truth = queries[audit] @ base.T >= least
    while True:
        out = np.zeros((len(queries), n), bool)
        for lo in range(0, len(queries), 256):
            todo, beam = np.arange(lo, min(len(queries), lo + 256)), width
            while len(todo):
                ids, sims = graph.search(queries[todo].astype(np.float32), beam)
                r, c = np.nonzero((ids >= 0) & (sims >= least - 1e-4))
                q, b = todo[r], ids[r, c]
                sure = np.einsum("kd,kd->k", queries[q], base[b]) >= least
                out[q[sure], b[sure]] = True
                todo = todo[(ids[:, -1] >= 0) & (sims[:, -1] >= least - 1e-4)] if beam < n else todo[:0]
                beam = min(n, beam * 4)
        if width >= n or not (truth & ~out[audit]).any():
            return out
        width = min(n, width * 2)


def labelled(match: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(match))
    while True:
        low = label.copy()
        for lo in range(0, len(match), 512):
            part = match[lo : lo + 512]
            some = np.flatnonzero(part.any(1))
            if len(some):
                low[lo + some] = np.minimum(low[lo + some], np.where(part[some], label, len(label)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    x = unit(np.stack(pdf.embedding.to_list()))
    shard = {"ids": pdf.id.to_numpy(np.int64), "weights": pdf.copies.to_numpy(np.int64), "x": x, "graph": Graph(x.astype(np.float32))}
    return pd.DataFrame({"label": [pdf.label.iat[0]], "dim": [pdf.dim.iat[0]], "shard": [pdf["shard"].iat[0]], "content": [pickle.dumps(shard)]})


def compare(a: dict, b: dict | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, roots) of a pair of shards, or of one with itself: summed weights and a forest."""
    if b is None:
        found = linked(a["graph"], a["x"], a["x"], least)
        found |= found.T
        np.fill_diagonal(found, False)
        ids, links = a["ids"], found @ a["weights"]
        return ids, links, ids[labelled(found)]
    found = linked(b["graph"], b["x"], a["x"], least) | linked(a["graph"], a["x"], b["x"], least).T
    ids = np.concatenate([a["ids"], b["ids"]])
    links = np.concatenate([found @ b["weights"], found.T @ a["weights"]])
    hit_a, hit_b = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
    rows = np.concatenate([hit_a, len(a["ids"]) + hit_b])
    square = np.zeros((len(rows), len(rows)), bool)
    square[: len(hit_a), len(hit_a) :] = found[np.ix_(hit_a, hit_b)]
    square |= square.T
    return ids[rows], links[rows], ids[rows][labelled(square)]


def classes(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD, held: int = HELD) -> DataFrame:
    """One row per row of df: id, n_links, component_id (the smallest id reachable), kept. Ids are integers."""
    v = F.col("embedding")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine &= F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("embedding"))
    rows = rows.withColumn("h", F.when(F.col("fine"), F.struct(F.xxhash64(F.lit(1), "embedding").alias("p"), F.xxhash64(F.lit(2), "embedding").alias("q"))))
    with scratch(df.sparkSession) as keep:
        # copies have equal vectors but for chance in 128 bits of hash
        reps = stored(rows.where("fine").groupBy("label", "dim", "h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
        counts = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
        counts = checkpointed(counts)
        dealt = reps.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.col("shards")).cast("int"))
        label_type = rows.schema["label"].dataType.simpleString()
        graphs = stored(dealt.select("label", "dim", "shard", "id", "copies", "embedding").groupBy("label", "dim", "shard").applyInPandas(build, f"label {label_type}, dim int, shard int, content binary"), "graphs")
        room = F.greatest(F.lit(1), F.floor(F.lit(float(held)) / (shard * (F.col("dim") * 12 + 200.0))))
        blocked = counts.withColumn("per", F.greatest(F.lit(1), F.least(room, F.floor(F.col("shards") / BLOCKS))).cast("int")).withColumn("blocks", F.ceil(F.col("shards") / F.col("per")).cast("int"))
        own = graphs.join(blocked.select("label", "dim", "per", "blocks"), ["label", "dim"]).withColumn("block", F.floor(F.col("shard") / F.col("per")).cast("int"))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "shard", "content")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            sides = [[pickle.loads(c) for c in pdf.content[pdf.block == b]] for b in sorted({pdf.i.iat[0], pdf.j.iat[0]})]
            pairs = [(a, b) for a in sides[0] for b in sides[1]] if len(sides) > 1 else [(a, b if k != n else None) for n, a in enumerate(sides[0]) for k, b in enumerate(sides[0]) if k >= n]
            parts = [pd.DataFrame(dict(zip(("id", "links", "root"), compare(a, b, least), strict=True))) for a, b in pairs]
            return pd.concat(parts) if parts else pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")

        found = stored(met.groupBy("label", "dim", "i", "j").applyInPandas(run, "id bigint, links bigint, root bigint"), "links")
        sums = found.groupBy("id").agg(F.sum("links").alias("links"))
        labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        reps = reps.select("label", "dim", "h", F.col("id").alias("rep"), "copies")
        reps = reps.join(sums.withColumnRenamed("id", "rep"), "rep", "left").join(labels.select(F.col("v").alias("rep"), "m"), "rep", "left")
        reps = keep(checkpointed(reps.select(F.col("label").alias("rl"), F.col("dim").alias("rd"), F.col("h").alias("rh"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("m", "rep").alias("m"))))
    out = rows.select("id", "label", "dim", "h").join(reps, (F.col("label") == F.col("rl")) & (F.col("dim") == F.col("rd")) & (F.col("h") == F.col("rh")), "left")
    component = F.coalesce("m", "id")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
