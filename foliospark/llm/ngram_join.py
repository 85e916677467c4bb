"""Self join of documents on the Jaccard similarity of their word n-gram sets, by T-occurrence search.

A document is a node, its set the distinct n-word shingles of its text in lower case. The search itself is
DivideSkip: of a document's shingles the rarest lists are merged, documents that occur often enough in them to
reach the required overlap are candidates, and the long lists are probed for each candidate by binary search. The merge
sorts the concatenated lists, run by run, in place of a heap; it finds the same counts.

Routing, which loses no link: sets are compared within size bands. For a band the most shingles in which two linked
sets differ are known, k, so of k + 1 + 2s parts of the hash space 2s + 1 at least hold the same shingles
in both. Each document sends the hashes of its parts, without the s that say least (empty ones, or only frequent
shingles), and with each hash its lowest one: documents that share that are linked where it is, and one of them stands for all elsewhere.
Documents that share a part form candidate groups, which chance meetings of frequent shingles chain together as the input grows. Groups that
don't fit a block are routed again by finer signatures, which lose no link either: of half as many parts as many hold all but one difference at
least, so in four pieces of such a part three are the same. Groups are cut into blocks of bounded size
and searched block by block. Where a group takes several blocks, leaders of the found components are searched
first, in blocks of the same bounds, and pairs of blocks only if the group still has more than one component, so the result is exact.

Documents of equal sets in a block of the scan send one copy of their parts. Null text or ids: the set is
empty and links with nothing. Rows of one id are one node: links of any of its rows count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize, release, spread, text_batches
from .wordhash import batch_hashes, bounded, mix, windows

N, NUM, DEN = 4, 85, 100
#: Parts that a document may leave unsent besides a tenth, words of a scan block, shingles of a search block.
SPARE, BLOCK_WORDS, BLOCK_SHINGLES = 4, 1_000_000, 2_000_000
#: Parts that may stay unsent, besides a twentieth, where groups are routed again; pieces of each of their parts.
FINE_SPARE, PIECES = 0, 4
#: Documents of a search block, as one that all share a list costs their square; candidates whose long lists are probed at once.
BLOCK_DOCS, PROBED = 20_000, 64
#: Placed documents that a join sends to all executors, 32 bytes each; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles of a text's word hashes; fewer words make one shingle of all."""
    if len(hashes) >= n:
        return np.unique(windows(hashes, n))
    return windows(hashes, len(hashes)) + np.uint64(len(hashes)) if len(hashes) else np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    hashes, counts = batch_hashes(texts, lower=True)
    ends = np.cumsum(counts)
    return [shingles(hashes[e - c : e], n) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


@lru_cache(maxsize=4)
def bands(num: int, den: int, upto: int = 1 << 40) -> np.ndarray:
    """Where size bands begin: linked sets are in one band or in neighbouring ones."""
    low = [1]
    while low[-1] < upto:
        low.append(low[-1] * den // num + 1)
    return np.array(low, dtype=np.int64)


def parts(found: np.ndarray, band: int, num: int, den: int, weight: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the parts that a set sends in a band, whose pairs have their smaller set there."""
    high = int(bands(num, den)[band + 1]) - 1
    differ = (high + high * den // num) * (den - num) // (den + num)
    spare = least + differ // 10
    count = differ + 1 + 2 * spare
    part = (mix(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) % np.uint64(count)
    part = part.astype(np.int64)
    order = np.argsort(part, kind="stable")
    present, at = np.unique(part[order], return_index=True)
    total = np.zeros(count, dtype=np.uint64)
    total[present] = np.add.reduceat(mix(found[order]), at)
    told = np.bincount(part, weights=weight, minlength=count)
    sent = np.argpartition(told, spare)[spare:]
    return mix(total[sent] + mix((sent + band * 1_000_003).astype(np.uint64)))


def fine_parts(found: np.ndarray, band: int, num: int, den: int, weight: np.ndarray, least: int) -> np.ndarray:
    """As parts(), of fewer and larger parts, each without one of its pieces in turn.

    In differ // 2 + 1 + 2 * spare parts at most differ // 2 hold two differences or more, so two linked sets agree in 2 * spare + 1
    parts but for one piece at most; each leaves out the spare parts that say least when their most telling piece is away.
    """
    high = int(bands(num, den)[band + 1]) - 1
    differ = (high + high * den // num) * (den - num) // (den + num)
    spare = least + differ // 20
    count = differ // 2 + 1 + 2 * spare
    piece = ((mix(found ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)) % np.uint64(count * PIECES)).astype(np.int64)
    order = np.argsort(piece, kind="stable")
    present, at = np.unique(piece[order], return_index=True)
    total = np.zeros(count * PIECES, dtype=np.uint64)
    total[present] = np.add.reduceat(mix(found[order]), at)
    total = total.reshape(count, PIECES)
    told = np.bincount(piece, weights=weight, minlength=count * PIECES).reshape(count, PIECES)
    sent = np.argpartition(told.sum(axis=1) - told.max(axis=1), spare)[spare:]
    without = total[sent].sum(axis=1, dtype=np.uint64)[:, None] - total[sent]
    place = sent[:, None] * PIECES + np.arange(PIECES) + band * 1_000_003
    return mix(without + mix(place.astype(np.uint64) ^ np.uint64(0x9FB21C651E98DF25))).ravel()


def scan_block(ids: np.ndarray, texts: list[bytes], n: int, num: int, den: int, spare: int, fine: bool = False) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """((id, size) of each row, exact links, candidate links, part hashes, their ids and those ids' smallest hashes) of a block of documents."""
    sets = shingle_sets(texts, n)
    facts = list(zip(ids.tolist(), map(len, sets), strict=True))
    first: dict[tuple, int] = {}
    exact, kept = [], []
    for i, found in enumerate(sets):
        if len(found):
            key = (len(found), int(mix(found).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(found + np.uint64(1)))))
            other = first.setdefault(key, i)
            if other != i:
                exact.append((ids[i], ids[other]))
            else:
                kept.append(i)
    big = [i for i in kept if len(sets[i]) * (den - num) >= num]  # smaller sets link with equal ones only
    small = [i for i in kept if len(sets[i]) * (den - num) < num]
    hashes = [np.array([mix(sets[i] + np.uint64(3)).sum(dtype=np.uint64)], dtype=np.uint64) for i in small]
    owner = list(small)
    if big:
        every = np.concatenate([sets[i] for i in big])
        _, back, count = np.unique(every, return_inverse=True, return_counts=True)
        rarity = np.log((len(big) + 1) / count)[back]
        at = 0
        for i in big:
            size = len(sets[i])
            weight = rarity[at : at + size] + 1e-3
            at += size
            band = int(np.searchsorted(bands(num, den), size, side="right")) - 1
            for b in (band - 1, band) if band else (band,):
                hashes.append((fine_parts if fine else parts)(sets[i], b, num, den, weight, spare))
                owner.append(i)
    if not hashes:
        none = np.zeros(0, np.uint64)
        return facts, np.array(exact, dtype=np.int64).reshape(-1, 2), np.zeros((0, 2), np.int64), none, np.zeros(0, np.int64), none
    owner = np.repeat(owner, [len(h) for h in hashes])
    every = np.concatenate(hashes)
    smallest = np.full(len(sets), np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(smallest, owner, every)
    key, who, low, near = meet(every, ids[owner], smallest[owner])
    return facts, np.array(exact, dtype=np.int64).reshape(-1, 2), near, key, who, low


def meet(keys: np.ndarray, who: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their smallest id with its lowest key, and the distinct (id, smallest id) that connect the others.

    low: the lowest key of each entry's document. Documents of one lowest key meet there, so at a higher key one of them stands for
    all; at the lowest key itself each is linked. By induction over the keys in order, all documents of a key are connected.
    """
    order = np.lexsort((who, keys))
    starts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    first = order[starts]
    least = np.repeat(who[first], np.diff(np.append(starts, len(keys))))
    again = np.lexsort((who, low, keys))  # the keys stand where they stood in the first order
    k, m, w = keys[again], low[again], who[again]
    chosen = np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]))) | (k == m)
    chosen &= w != least
    return keys[first], who[first], low[first], np.unique(np.stack([w, least], axis=1)[chosen], axis=0)


def search(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets, by DivideSkip from small sets to large.

    group: only links between different groups are looked for. Links that join what is joined already are left out.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(ids[i])))
    sizes = np.array([len(sets[i]) for i in order])
    every = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(order)), sizes)
    _, token, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)  # tokens by how frequent they are
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    count = np.sort(count, kind="stable")
    lists = doc[np.argsort(token, kind="stable")]  # documents of each token, small sets first
    begin = np.cumsum(count) - count
    label = np.arange(len(order)) if group is None else np.unique(group[order], return_inverse=True)[1]
    parent = np.arange(int(label.max(initial=0)) + 1)

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    ends = np.cumsum(sizes)
    own = [np.sort(token[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    n = len(order)
    listed = np.repeat(np.arange(len(count)), count) * n + lists  # ascending: a probe of any list is a binary search here
    links = []
    for x, tokens in enumerate(own):
        size = len(tokens)
        need = -(-num * size // den)  # the least overlap with a set that isn't larger
        shared = tokens[count[tokens] > 1]
        if len(shared) < need:
            continue
        short_need = 1 + (size - need) // 2
        long_ = shared[len(shared) - (need - short_need) :] if need > short_need else shared[:0]
        short = shared[: len(shared) - len(long_)]
        if not len(short):
            continue
        # the short lists are merged; a stable sort does it list by list, as they are in order
        merged = np.sort(np.concatenate([lists[b : b + np.searchsorted(lists[b : b + c], x)] for b, c in zip(begin[short].tolist(), count[short].tolist(), strict=True)]), kind="stable")
        at = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1]))) if len(merged) else merged
        found, times = merged[at], np.diff(np.append(at, len(merged)))
        required = -(-num * (size + sizes[found]) // (num + den))
        keep = np.flatnonzero((times >= short_need) & (sizes[found] * den >= num * size) & (times + len(long_) >= required))
        keep = keep[np.argsort(-times[keep], kind="stable")]
        for some in np.split(keep, range(PROBED, len(keep), PROBED)):
            mine = root(int(label[x]))
            some = some[[root(g) != mine for g in label[found[some]].tolist()]] if len(some) else some
            if not len(some):
                continue
            probe = long_[:, None] * n + found[some][None, :]
            hits = (listed[np.minimum(np.searchsorted(listed, probe), len(listed) - 1)] == probe).sum(axis=0) + times[some]
            for y in found[some[hits >= required[some]]].tolist():
                a, b = root(int(label[y])), root(int(label[x]))
                if a != b:
                    links.append((int(ids[order[x]]), int(ids[order[y]])))
                    parent[b] = a
    return links


def _rows(a: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})


def jaccard_components(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row; links are num/den similar or more."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _routed(rows, n, num, den)
    sizes = found.where("kind = -1").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    exact = found.where("kind = -2").select("a", "b")
    groups, more = _narrowed(rows, _groups(found), sizes, n, num, den)
    exact = exact.unionByName(more) if more is not None else exact
    links = _search_groups(rows, groups, sizes, n, num, den).unionByName(exact)
    component = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    unset = rows.where("id is null or text is null").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"))
    return (
        sizes.unionByName(unset)
        .join(component, "doc_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _routed(rows: DataFrame, n: int, num: int, den: int, fine: bool = False) -> DataFrame:
    """(a, b, kind): id and size of each row (-1), exact links (-2), links of ids that share a part (-3)."""
    spark = rows.sparkSession
    dealt = spread(rows, "text")
    buckets = 2 * dealt

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in bounded(batches, BLOCK_WORDS * 6, lambda b: int(b["text"].str.len().sum())):
            block = pd.concat(held)
            texts = [t.encode("utf-8", "surrogatepass") for t in block["text"]]
            facts, exact, near, keys, who, low = scan_block(block["id"].to_numpy(), texts, n, num, den, FINE_SPARE if fine else SPARE, fine)
            out = [(-1, np.array(facts, dtype="<i8").tobytes()), (-2, exact.astype("<i8").tobytes()), (-3, near.astype("<i8").tobytes())]
            bucket = (keys >> np.uint64(17)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                chosen = order[bounds[b] : bounds[b + 1]]
                if len(chosen):
                    chosen = chosen[np.argsort(who[chosen], kind="stable")]
                    out.append((b, np.int64(len(chosen)).tobytes() + keys[chosen].tobytes() + np.diff(who[chosen], prepend=0).astype("<i8").tobytes() + low[chosen].tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "payload"])
            del held, block, texts, keys, who, low, out
            release()

    def group(batch: pd.DataFrame) -> pd.DataFrame:
        kind = int(batch["bucket"].iloc[0])
        if kind < 0:
            found = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in batch["payload"]])
        else:
            heads = [(int(np.frombuffer(p, "<i8", 1)[0]), p) for p in batch["payload"]]
            keys = np.concatenate([np.frombuffer(p, "<u8", k, 8) for k, p in heads])
            who = np.concatenate([np.cumsum(np.frombuffer(p, "<i8", k, 8 + 8 * k)) for k, p in heads])
            low = np.concatenate([np.frombuffer(p, "<u8", k, 8 + 16 * k) for k, p in heads])
            kind, found = -3, meet(keys, who, low)[3]
        return _rows(found).assign(kind=kind)

    sent = rows.where("id is not null and text is not null").mapInPandas(scan, "bucket int, payload binary")
    part = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("payload"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    kind = F.least(F.col("bucket"), F.lit(0))
    sent = sent.withColumn("part", part).withColumn("sort", kind).repartition(dealt, "part", "sort")
    return materialize(sent.groupBy("part", "sort").applyInPandas(group, "a long, b long, kind int"))


def _groups(found: DataFrame) -> DataFrame:
    return materialize(connected_components(found.where("kind = -3").select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("grp")))


def _blocks() -> Column:
    """How many blocks a group takes, from the sizes of its members."""
    return F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")


def _sized(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    return sizes.select(F.col("doc_id").alias("id"), "n_shingles").groupBy("id").agg(F.max("n_shingles").alias("size")).join(groups, "id")


def _few(rows: DataFrame) -> DataFrame:
    """rows marked for sending to all executors where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _narrowed(rows: DataFrame, groups: DataFrame, sizes: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame | None]:
    """groups with those of several blocks cut into what is still connected by finer signatures, and exact links found on the way."""
    wide = _sized(groups, sizes).groupBy("grp").agg(_blocks().alias("blocks")).where("blocks > 1").select("grp")
    wide = materialize(groups.join(wide, "grp").select("id", "grp"))
    if not wide.limit(1).count():
        return groups, None
    found = _routed(rows.where("text is not null").join(_few(wide.select("id")), "id"), n, num, den, True)
    cut = groups.join(wide.select("grp").distinct(), "grp", "left_anti").unionByName(_groups(found).select("grp", "id"))
    return materialize(cut.select("id", "grp")), found.where("kind = -2").select("a", "b")


def _search_groups(rows: DataFrame, groups: DataFrame, sizes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links within candidate groups."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in batch.pop("text")], n)
            yield batch.assign(shingles=[s.tobytes() for s in sets])

    def search_block(batch: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, "<u8") for s in batch["shingles"]]
        links = search(batch["id"].to_numpy(), sets, num, den, batch["comp"].to_numpy())
        del sets, batch
        release()
        return _rows(np.array(links, dtype=np.int64).reshape(-1, 2))

    total = _sized(groups, sizes)
    blocks = materialize(total.groupBy("grp").agg(_blocks().alias("blocks")))
    placed = groups.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    placed = _few(placed)

    def members(chosen: DataFrame) -> DataFrame:
        found = rows.where("text is not null").join(chosen, "id").select("id", "grp", "blocks", "block", "text")
        return found.mapInPandas(hashed, "id long, grp long, blocks int, block int, shingles binary")

    def searched(found: DataFrame) -> DataFrame:
        return materialize(found.groupBy("grp", "block", "other").applyInPandas(search_block, "a long, b long"))

    links = searched(members(placed).withColumn("other", F.lit(0)).withColumn("comp", F.col("id")))
    if blocks.where("blocks > 1").limit(1).count() == 0:
        return links
    wide = materialize(members(placed.where("blocks > 1")))
    # Leaders of each component in each block, a few of them, against one another. Sets are fetched for chosen ids only.
    at = wide.select("id", "grp", "blocks", "block")
    state = _joined(at, links)
    spread = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    chosen = state.groupBy("grp", "block", "comp").agg(F.min("id").alias("x"), F.min_by("id", spread).alias("y"), F.max_by("id", spread).alias("z"))
    leaders = materialize(chosen.select(F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("id"), "comp").distinct())
    links = links.unionByName(searched(_led(wide, leaders, total)))
    # Pairs of blocks, for groups that are not one component yet.
    state = _joined(at, links)
    apart = state.groupBy("grp").agg(F.min("comp").alias("m"), F.max("comp").alias("n")).where("m <> n").select("grp")
    rest = materialize(state.join(apart, "grp", "left_semi").select("id", "comp"))
    if rest.limit(1).count() == 0:
        return links
    pairs = wide.join(rest, "id").withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("peer <> block")
    pairs = pairs.withColumn("other", F.greatest("block", "peer") + 2).withColumn("block", F.least("block", "peer")).drop("peer")
    return links.unionByName(searched(pairs))


def _led(wide: DataFrame, leaders: DataFrame, total: DataFrame) -> DataFrame:
    """The members of wide that are leaders, with comp, dealt over as many blocks as they take themselves."""
    room = total.join(leaders, "id").groupBy("grp").agg(_blocks().alias("room_"))
    few = wide.join(leaders, "id").join(room, "grp").withColumn("block", F.pmod(F.xxhash64("id", F.lit(13)), F.col("room_")).cast("int"))
    return few.drop("room_").withColumn("other", F.lit(1))


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with comp, the component that the links put them in."""
    comp = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    return members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def keep_first(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs without those that are in a component of a smaller id; documents without shingles and null ids stay."""
    found = materialize(jaccard_components(docs, n, num, den).where("doc_id <> component_id").select("doc_id").distinct())
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
