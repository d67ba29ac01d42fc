"""SimHash near-duplicates, linked through vantage-point trees over Hamming space.

1. Each text becomes a 64-bit fingerprint of its word shingles (one pass over the texts).
2. Equal fingerprints are merged first, so copies cost nothing further.
3. A vantage-point tree over a bounded sample of distinct fingerprints deals all of them into shards; shards that come out too large
   are sampled and dealt again, each by a tree of its own, until none is or can be cut. At a node with
   vantage v and radius m a fingerprint x goes inside if d(x, v) <= m and outside otherwise; if it lies outside within
   m + r it also goes inside. By the triangle inequality two fingerprints within r meet in one child at every node
   (both inside, both outside, or the outer one overlaps the boundary), hence in one shard, and no branch needs
   a second look.
4. In a shard the same rule builds a deeper tree down to small leaves; each leaf is searched exactly, by growing
   components: a found member is compared with the members not yet found only, so a dense ball of near copies
   costs about its own size. A leaf returns a star of links per component, not its pairs.
5. Stars are joined to components across shards (see components.py).

Defined cases: null and empty texts have the fingerprint zero and are linked like any other; ids may repeat or be
null (component_id is the least id that is not null, null if there is none); other columns are ignored; an empty
table gives an empty result. Memory: a task holds one batch of texts, or one shard of 8-byte fingerprints.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import ROW, discard_since, materialize, scratch_mark, text_or_empty, with_row_key
from readloom.llm.components import connected_components
from readloom.llm.similar import similar_groups, small

SEED = 42
SAMPLE = 1 << 15
SHARD = 1 << 14
MAX_SHARDS = 1 << 12  # of one tree
LEAF = 512
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of A-Z-lower-cased, space-joined word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is \x20 \x09-\x0D
    n = len(words) - width + 1
    if n <= 1:
        # One shingle alone is over half of all shingles in each of its bits.
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    line, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last, h = (ends - lens)[:n].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = [h(line[i:j], SEED) for i, j in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """Nodes as rows of (vantage, radius, inner child, outer child); a negative child -k-1 is leaf k."""

    def __init__(self, points: np.ndarray, leaf: int, most: int, reach: int):
        self.vantage: list[np.uint64] = []
        self.radius: list[int] = []
        self.kids: list[list[int]] = []
        self.reach, self.leaves = reach, 0
        # Built breadth first, until there are enough leaves.
        self.root = self._grow(points, leaf, most)

    def _grow(self, points: np.ndarray, leaf: int, most: int) -> int:
        queue: list[tuple[np.ndarray, int, int]] = [(points, -1, 0)]  # points, parent, side
        root = 0
        while queue:
            s, parent, side = queue.pop(0)
            cut = None if len(s) <= leaf or self.leaves + len(queue) + 1 >= most else best_cut(s, self.reach)
            if cut is None:
                ref, self.leaves = -self.leaves - 1, self.leaves + 1
            else:
                v, m, d = cut
                ref = len(self.vantage)
                self.vantage.append(v)
                self.radius.append(m)
                self.kids.append([0, 0])
                queue += [(s[d <= m + self.reach], ref, 0), (s[d > m], ref, 1)]
            if parent < 0:
                root = ref
            else:
                self.kids[parent][side] = ref
        return root

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``points`` that go there)."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            ref, rows = stack.pop()
            if not len(rows):
                continue
            if ref < 0:
                yield -ref - 1, rows
                continue
            d, m = np.bitwise_count(points[rows] ^ self.vantage[ref]), self.radius[ref]
            stack += [(self.kids[ref][0], rows[d <= m + self.reach]), (self.kids[ref][1], rows[d > m])]


def best_cut(points: np.ndarray, reach: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage and radius that leave the fewest pairs to compare; None if no cut saves a twentieth."""
    best, n = None, len(points)
    for v in points[np.linspace(0, n - 1, 5).astype(int)]:
        d = np.bitwise_count(points ^ v)
        upto = np.cumsum(np.bincount(d, minlength=65 + reach))
        for m in range(64):
            cost = (upto[m + reach] / n) ** 2 + (1 - upto[m] / n) ** 2
            if (best is None or cost < best[0]) and 0 < upto[m] < n:
                best = (cost, v, m, d)
    return None if best is None or best[0] > 0.95 else best[1:]


def leaf_stars(points: np.ndarray, reach: int) -> list[np.ndarray]:
    """Components (of two or more) of distinct points linked at ``reach`` or fewer differing bits."""
    if len(points) <= LEAF:
        near = np.bitwise_count(points[:, None] ^ points) <= reach
        linked = np.count_nonzero(near, axis=1) > 1
        points = points[linked]  # most have no partner
    out, left = [], points
    while len(left) > 1:
        members, frontier = [left[:1]], [left[0]]
        left = left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= reach
            if near.any():
                found, left = left[near], left[~near]
                members.append(found)
                frontier.extend(found)
        if len(members) > 1:
            out.append(np.concatenate(members))
    return out


def shard_stars(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (root, member) that connect what is linked within a shard of distinct points."""
    roots, others, stack = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [points]
    while stack:
        s = stack.pop()
        cut = best_cut(s, reach) if len(s) > LEAF else None
        if cut is not None:
            _, m, d = cut
            stack += [s[d <= m + reach], s[d > m]]
            continue
        for c in leaf_stars(s, reach):
            roots.append(np.full(len(c) - 1, c.min()))
            others.append(c[c != c.min()])
    return np.concatenate(roots), np.concatenate(others)


def _deal_again(dealt: DataFrame, reach: int, level: int) -> DataFrame | None:
    """The shards of more than four times SHARD points dealt by trees of their own, the others as they are; None if no shard is too large.

    ``dealt`` has shard, fp and whole: that the shard could not be cut, as a ball of near copies.
    """
    big = dealt.where("not whole").groupBy("shard").agg(F.count("*").alias("points")).where(F.col("points") > 4 * SHARD)
    big = materialize(big, "simhash-large")
    n = big.count()
    if not n:
        return None
    sent = F.broadcast(big) if n <= 1 << 16 else big
    # About SAMPLE points of each, by a hash, whatever the number of partitions.
    threshold = F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(SAMPLE) / F.col("points"))
    drawn = dealt.join(sent, "shard").where(F.pmod(F.xxhash64("fp", F.lit(f"vantage{level}")), F.lit(1 << 40)) < threshold)

    def grow(shard: pa.Table) -> pa.Table:
        points = np.sort(shard.column("fp").to_numpy().view(np.uint64))
        shards = min(MAX_SHARDS, max(2, shard.column("points")[0].as_py() // SHARD))
        tree = VantageTree(points, max(LEAF, len(points) // shards), shards, reach)
        return pa.table({"shard": shard.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, VantageTree] = {}
        for b in batches:
            shards, points = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for k in np.unique(shards).tolist():
                at = np.nonzero(shards == k)[0]
                if k not in trees:
                    if len(trees) > 64:
                        trees.clear()
                    trees[k] = pickle.loads(b.column(2)[int(at[0])].as_py())
                cut = trees[k].leaves > 1
                for leaf, rows in trees[k].route(points[at]):
                    cols = [np.full(len(rows), (k * MAX_SHARDS + leaf + 1) if cut else k), points[at[rows]].view(np.int64), np.full(len(rows), not cut)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "fp", "whole"])

    trees = materialize(drawn.select("shard", "fp", "points").groupBy("shard").applyInArrow(grow, "shard long, tree binary"), "simhash-trees")
    sent_trees = F.broadcast(trees) if n <= 64 else trees  # of some 10 kB each
    again = dealt.join(sent, "shard", "left_semi").select("shard", "fp").join(sent_trees, "shard").select("shard", "fp", "tree")
    rest = dealt.join(sent, "shard", "left_anti")
    return materialize(again.mapInArrow(route, "shard long, fp long, whole boolean").unionByName(rest), "simhash-dealt")


def link_fingerprints(fps: DataFrame, reach: int = 3) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct column fp within ``reach`` bits."""

    def search(shard: pa.Table) -> pa.Table:
        points = shard.column("fp").to_numpy().view(np.uint64)
        a, b = shard_stars(points, reach)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt, level = fps.select(F.lit(0).cast("long").alias("shard"), "fp", F.lit(False).alias("whole")), 0
    while level < 5 and (again := _deal_again(dealt, reach, level)) is not None:  # 4,096 shards at each level fit into a long
        dealt, level = again, level + 1
    shards = max(1, dealt.select("shard").distinct().count())
    return dealt.select("shard", "fp").repartition(min(shards, 100_000), "shard").groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 3
) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the least id reachable over links)."""
    rows = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    kinds = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-kinds")
    roots = connected_components(link_fingerprints(kinds.select("fp"), reach))
    named = kinds.join(roots, kinds.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # Both sides of the join are tables, so a fingerprint that a third of all rows have is split among tasks.
    by_fp = materialize(named.join(least, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per group of similar texts (see similar.py), that of the least id, with all columns.

    Not op1's rule alone: 3 of 64 bits reach few of the pairs of similarity 0.8, so its links are the first of several. Rows are dropped by a key of their own, not by id.
    """
    keyed = with_row_key(docs)
    rows = keyed.select(ROW, F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    mark = scratch_mark()
    kept = materialize(similar_groups(rows, link_fingerprints).where(f"{ROW} = kept_row").select(ROW), "kept")
    discard_since(docs.sparkSession, mark, kept)
    return keyed.join(small(kept), ROW, "left_semi").select(*docs.columns)
