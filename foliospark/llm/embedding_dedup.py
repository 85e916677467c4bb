"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Vectors of one label and dimension are dealt into shards of bounded size; each shard builds its graph,
every block of vectors queries every shard of its label. A query's beam is widened while it holds nothing but
links, and a whole block's beams while an audit of sampled queries against brute force finds too little; a block whose beams
are as wide as the shard and still miss links is compared with all of the shard's vectors. Links are
verified by cosine in double precision, counted on both sides, and unioned to components.

Equal vectors of a label are one weighted node, so copies of one vector are one row of a graph. Vectors that are null, empty, zero, hold
null or non-finite components, or have no label, link with nothing. Links are between vectors, numbered for it; ids come in at the end. So
rows with a null or a repeated vec_id are rows of their own in the counts: a component's id is the smallest id that is not null in
it, null where all are, and a row is kept where its id is that one (null ones among themselves too).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize, partitions

MIN_COSINE = 0.93
#: Vectors of a shard, links of a node, beams while building and querying, audited queries of a block, their least recall.
SHARD, M, EF_BUILD, EF, AUDIT, RECALL = 8192, 16, 64, 64, 128, 0.995
BLOCK, EXPAND = 512, 4


class Graph:
    """A navigable small-world graph over unit vectors; searches and inserts go in blocks."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 1):
        self.x = np.ascontiguousarray(vectors, dtype=np.float64)
        self.m, n = m, len(vectors)
        rng = np.random.default_rng(seed)
        # the highest levels come first, so that all later nodes find their way from the top; callers shuffle
        level = np.sort(np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 6))[::-1] if n else np.zeros(0, int)
        self.level = level
        self.near = [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.sims = [np.full(a.shape, -2.0) for a in self.near]
        self.done = 0
        self.top: list[int] = []
        while self.done < n:
            size = min(n - self.done, max(64, min(self.done, BLOCK)))
            self._insert(np.arange(self.done, self.done + size), ef)
            self.done += size

    def _insert(self, new: np.ndarray, ef: int) -> None:
        q = self.x[new]
        among = q @ q.T
        np.fill_diagonal(among, -2)
        start = self._entries(q)
        for layer in range(len(self.near) - 1, -1, -1):
            here = np.flatnonzero(self.level[new] >= layer)
            ids, sims = (np.full((len(q), 1), -1), np.full((len(q), 1), -2.0))
            if start.shape[1]:
                ids, sims = self._beam(layer, q, start, ef if len(here) else 8)
                start = np.where(sims > -2, ids, -1)
            if len(here):
                mates = among[np.ix_(here, here)]
                k = min(ef, len(here))
                best = np.argpartition(-mates, k - 1, axis=1)[:, :k]
                all_ids = np.concatenate([ids[here], new[here][best]], axis=1)
                all_sims = np.concatenate([sims[here], np.take_along_axis(mates, best, 1)], axis=1)
                self._link(layer, new[here], all_ids, all_sims)
                if layer == len(self.near) - 1:
                    self.top = (self.top + new[here].tolist())[:64]

    def _entries(self, q: np.ndarray) -> np.ndarray:
        if not self.top:
            return np.zeros((len(q), 0), dtype=int)
        top = np.array(self.top)
        k = min(4, len(top))
        best = np.argpartition(-(q @ self.x[top].T), k - 1, axis=1)[:, :k]
        return top[best]

    def _link(self, layer: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Neighbours of new nodes, spread by the usual heuristic and filled up with the nearest; and links back."""
        order = np.argsort(-sims, axis=1)[:, : 4 * self.m]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        usable = sims > -2
        v = self.x[np.maximum(ids, 0)]
        cross = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            blocked = (np.where(chosen, cross[:, j, :], -2.0).max(axis=1)) > sims[:, j]
            chosen[:, j] = usable[:, j] & ~blocked & (chosen.sum(axis=1) < self.m)
        rest = usable & ~chosen
        chosen |= rest & (chosen.sum(axis=1)[:, None] + np.cumsum(rest, axis=1) <= self.m)
        near, kept = self.near[layer], self.sims[layer]
        for i, node in enumerate(nodes.tolist()):
            picks = np.flatnonzero(chosen[i])
            for other, s in [(int(ids[i, p]), float(sims[i, p])) for p in picks]:
                for a, b in ((node, other), (other, node)):
                    row = near[a]
                    if b in row:
                        continue
                    at = int(kept[a].argmin())
                    if kept[a, at] < s:
                        row[at], kept[a, at] = b, s

    def _beam(self, layer: int, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest that a best-first search from the start nodes finds, in order."""
        near, n = self.near[layer], len(q)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.x) + 1), dtype=bool)  # the last column takes the absent ones
        ids = np.full((n, ef), -1)
        sims = np.full((n, ef), -2.0)
        open_ = np.zeros((n, ef), dtype=bool)
        fresh = start
        active = np.arange(n)
        while True:
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[seen[active[:, None], fresh]] = -1
            seen[active[:, None], fresh] = True
            seen[:, -1] = False
            value = np.einsum("qd,qkd->qk", q[active], self.x[np.maximum(fresh, 0)])
            value[fresh < 0] = -2
            every = np.concatenate([sims[active], value], axis=1)
            best = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(every, best, 1), axis=1), 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], fresh], axis=1), best, 1)
            sims[active] = np.take_along_axis(every, best, 1)
            fresh_open = np.concatenate([open_[active], fresh >= 0], axis=1)
            open_[active] = np.take_along_axis(fresh_open, best, 1) & (sims[active] > -2)
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return ids, sims
            k = min(max(EXPAND, ef // 12), ef)
            pick = np.argsort(~open_[active], axis=1, kind="stable")[:, :k]
            going = np.take_along_axis(open_[active], pick, 1)
            nodes = np.where(going, np.take_along_axis(ids[active], pick, 1), -1)
            open_[active[:, None], pick] = False
            fresh = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(active), -1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        start = self._entries(q)
        for layer in range(len(self.near) - 1, 0, -1):
            ids, sims = self._beam(layer, q, start, 8)
            start = np.where(sims > -2, ids, -1)
        return self._beam(0, q, start, min(ef, max(len(self.x), 1)))

    def linked(self, q: np.ndarray, least: float, ef: int) -> np.ndarray:
        """Which nodes each query links with; beams widen while they hold links only."""
        out = np.zeros((len(q), len(self.x)), dtype=bool)
        for at in range(0, len(q), BLOCK):
            todo, width = np.arange(at, min(at + BLOCK, len(q))), ef
            while len(todo):
                ids, sims = self.search(q[todo], width)
                hit = sims >= least
                out[np.repeat(todo, hit.sum(axis=1)), ids[hit]] = True
                if width >= len(self.x):
                    break
                todo, width = todo[hit.all(axis=1)], width * 4
        return out

    def audited(self, q: np.ndarray, least: float, ef: int, audit: int, recall: float) -> tuple[np.ndarray, float]:
        """linked(), with beams doubled until the sampled queries reach the recall; and that recall."""
        sample = np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)
        truth = q[sample] @ self.x.T >= least
        while True:
            found = self.linked(q, least, ef)
            got = (found[sample] & truth).sum() / max(truth.sum(), 1) if truth.any() else 1.0
            if got >= recall:
                return found, float(got)
            if ef >= len(self.x):  # the graph is in parts: every vector of the shard instead
                return np.concatenate([q[at : at + BLOCK] @ self.x.T >= least for at in range(0, len(q), BLOCK)]), 1.0
            ef *= 2


def _walk(links: np.ndarray, back: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Components of a bipartite graph given by rows and its transpose, as (rows, columns); those with a link."""
    free, out = links.any(axis=1), []
    while free.any():
        rows = np.zeros(len(links), dtype=bool)
        columns = np.zeros(len(back), dtype=bool)
        edge = np.array([int(free.argmax())])
        while len(edge):
            rows[edge] = True
            reached = np.flatnonzero(links[edge].any(axis=0) & ~columns)
            columns[reached] = True
            edge = np.flatnonzero(back[reached].any(axis=0) & ~rows) if len(reached) else reached
        free &= ~rows
        out.append((np.flatnonzero(rows), np.flatnonzero(columns)))
    return out


def _weighed(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights that each row and each column links with, a block of rows at a time."""
    by_row, by_column = np.zeros(len(links), dtype=np.int64), np.zeros(links.shape[1], dtype=np.int64)
    for at in range(0, len(links), BLOCK):
        some = links[at : at + BLOCK].astype(np.int64)
        by_row[at : at + BLOCK] = some @ columns
        by_column += rows[at : at + BLOCK] @ some
    return by_row, by_column


def _unit(payload: bytes, dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(payload, kind).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(embedding: Column, label: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, least: float = MIN_COSINE, shard: int = SHARD, ef: int = EF, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row with columns vec_id, embedding and label."""
    exact = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    number, code = ("double", "<f8") if exact else ("float", "<f4")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("embedding"), "label")
    good = rows.where(usable(F.col("embedding"), F.col("label"))).withColumn("e", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(number)).otherwise(x)))
    distinct = good.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("e"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    shards = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    placed = distinct.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    tasks = partitions(vectors.sparkSession)
    placed = placed.repartition(tasks, "label", "dim", "shard")  # not by label alone, as the join may leave it

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("node").sample(frac=1, random_state=1)
        x = np.stack(batch["e"].to_numpy()).astype(code)
        graph = Graph(_unit(x.tobytes(), x.shape[1], code), seed=int(batch["shard"].iloc[0]) + 1)
        out = batch.iloc[:1][["label", "dim", "shard"]].copy()
        out["ids"], out["weights"] = [batch["node"].to_numpy("<i8").tobytes()], [batch["weight"].to_numpy("<i8").tobytes()]
        out["vectors"], out["near"] = [x.tobytes()], [[a.astype("<i4").tobytes() for a in graph.near]]
        out["top"] = [np.array(graph.top, "<i4").tobytes()]
        return out

    label = placed.schema["label"].dataType.simpleString()
    graphs = materialize(placed.groupBy("label", "dim", "shard").applyInPandas(build, f"label {label}, dim int, shard int, ids binary, weights binary, vectors binary, near array<binary>, top binary"))
    queries = graphs.select("label", "dim", F.col("shard").alias("block"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), F.col("vectors").alias("q_vectors"))
    at = graphs.select("label", "dim", "shard")
    pairs = at.join(at.withColumnRenamed("shard", "block"), ["label", "dim"]).where("block >= shard")
    pairs = pairs.join(graphs, ["label", "dim", "shard"]).join(queries, ["label", "dim", "block"])
    pairs = pairs.repartition(tasks, "label", "dim", "shard", "block")  # every pair of shards is work of its own

    def ask(batch: pd.DataFrame) -> pd.DataFrame:
        row = batch.iloc[0]
        dim, same = int(row["dim"]), row["shard"] == row["block"]
        graph = Graph(np.zeros((0, dim)))
        graph.x = _unit(row["vectors"], dim, code)
        graph.near = [np.frombuffer(a, "<i4").reshape(len(graph.x), -1) for a in row["near"]]
        graph.top = np.frombuffer(row["top"], "<i4").tolist()
        ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
        weights, q_weights = np.frombuffer(row["weights"], "<i8"), np.frombuffer(row["q_weights"], "<i8")
        found, _ = graph.audited(_unit(row["q_vectors"], dim, code), least, ef, AUDIT, recall)
        if same:
            found |= found.T
            np.fill_diagonal(found, False)
        by_query, by_node = _weighed(found, q_weights, weights)
        counts = [(q_ids, by_query)] + ([] if same else [(ids, by_node)])
        a = [c[n > 0] for c, n in counts]
        b = [n[n > 0] for _, n in counts]
        kinds = [np.zeros(len(x), int) for x in a]
        back = np.ascontiguousarray(found.T)
        for r, c in _walk(found, back):
            members = np.unique(np.concatenate([q_ids[r], ids[c]]))
            a.append(members[1:])
            b.append(np.full(len(members) - 1, members[0]))
            kinds.append(np.ones(len(members) - 1, int))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "kind": np.concatenate(kinds)})

    found = materialize(pairs.groupBy("label", "dim", "shard", "block").applyInPandas(ask, "a long, b long, kind int"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    parts = materialize(connected_components(found.where("kind = 1").select("a", "b")))
    named = parts.join(distinct.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    nodes = distinct.join(links, "node", "left").join(parts.join(named, "component").select("node", F.lit(True).alias("linked"), "least"), "node", "left")
    nodes = nodes.select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    joined = rows.withColumn("e", F.when(usable(F.col("embedding"), F.col("label")), F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(number)).otherwise(x)))).join(nodes, ["label", "e"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
