"""SimHash near-dedup: 64-bit fingerprints, a binary trie self-join, connected components.

Fingerprint: lower-case A-Z, words split at ASCII white space, 4-word shingles with repeats (a
text of fewer words is one shingle; one without words has fingerprint zero), XXH64 with seed 42;
a bit is set if it is set in over half of the shingle hashes. Two fingerprints link at a Hamming
distance of at most 4.

Join: the bits are cut into m >= 5 blocks. Two fingerprints within 4 bits agree on at least m - 4
whole blocks, so the distinct fingerprints are permuted once for each choice of m - 4 blocks, which
come first, and joining within equal first bits loses nothing. m follows their number, so that an
average group stays small: 5 choices of 12 bits up to some 16 million, then 15 of 20, 35 of 27, 70 of 32. In
a group the binary trie over the remaining bits is joined with itself: node pairs descend together, their differing bits add up, and a pair ends when it exceeds
the budget. The budget rises from 0 to 4, and a pair of nodes that already lie in one component
is not descended into, so a dense cluster costs its components, not all its pairs; a task emits a
forest, at most one edge for each fingerprint. A group larger than an average partition is dealt
into slices, and each pair of slices is a task of its own.

Components: large-star / small-star contraction of the forests' edges, each round written to the
shared checkpoint folder. Hubs, giant components and fingerprints of many rows are dealt into
slices (``common.spread_join``), so no task gets all rows of one key.

Edge cases: null text counts as empty; a null doc_id is no candidate for component_id unless all
members lack an id; repeated rows share a fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terselake.llm import common

BITS, MAX_DIFF, WORDS = 64, 4, 4
#: Average rows of a group beyond which the bits are cut into more blocks.
GROUP = 4096
#: Groups up to this size are never split.
LEAST_SPLIT = 512
#: Node pairs held at once by a traversal.
_FRONTIER = 2_000_000


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: both are ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[WORDS - 1:]
    starts = starts[:len(ends)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist())), repeat(42)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_280):
        part = h[k:k + 65_280]
        full = len(part) // 255 * 255
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if full:
            ones += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(df: DataFrame, text_col: str, name: str, field: str | None = None) -> DataFrame:
    """``df`` with one column more: the fingerprint, as a (signed) long, of a text column or of a field of a struct column."""

    def run(batch: pa.RecordBatch):
        prints = pa.array([_signed(fingerprint(t)) for t in common.texts_of(batch, text_col, field)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, name])

    return common.map_batches(df, run, StructType([*df.schema.fields, StructField(name, LongType())]))


# ---------------------------------------------------------------- trie self-join of one partition


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-label union of the pairs (a, b)."""
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_forest(key: np.ndarray, prints: np.ndarray, max_diff: int = MAX_DIFF, shared: int = 0) -> np.ndarray:
    """parent[i]: the smallest member linked with i in its key's group, through links within max_diff bits.

    Inputs are sorted by (key, prints), prints as unsigned 64-bit numbers. All rows of a group
    join one another; they agree on their first `shared` bits.
    """
    n = len(prints)
    parent = np.arange(n)
    if n < 2:
        return parent
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    group_start, group_end = bounds[:-1], bounds[1:]
    many = group_end - group_start > 1
    group_start, group_end = group_start[many], group_end[many]
    for budget in range(max_diff + 1):
        # uniform[j] - uniform[i]: changes of component within rows i..j, 0 if a node lies in one component
        uniform = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
        stack = [(shared, group_start, group_end, group_start, group_end, np.zeros(len(group_start), np.int8))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        while stack:
            depth, a0, a1, b0, b1, err = stack.pop()
            if len(a0) > _FRONTIER:
                half = len(a0) // 2
                stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, err))), (depth, *(x[:half] for x in (a0, a1, b0, b1, err)))]
                continue
            # a node pair within one component has nothing to add
            one = (uniform[a1 - 1] == uniform[a0]) & (uniform[b1 - 1] == uniform[b0]) & (parent[a0] == parent[b0])
            leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
            if (x := leaf & ~one).any():
                i, j = a0[x], b0[x]
                ok = _popcount(prints[i] ^ prints[j]) <= budget
                found.append((i[ok], j[ok]))
                held += int(ok.sum())
                if held > _FRONTIER:
                    parent = _unite(parent, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                    uniform = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
                    found, held = [], 0
            go = ~leaf & ~one
            if depth == BITS or not go.any():
                continue
            a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
            same = (a0 == b0) & (a1 == b1)
            am, bm = _split(prints, a0, a1, depth), _split(prints, b0, b1, depth)
            # children: both zero, both one, and the two mixed ones (only one of them for a node with itself)
            na0 = np.concatenate([a0, am, a0, am[~same]])
            na1 = np.concatenate([am, a1, am, a1[~same]])
            nb0 = np.concatenate([b0, bm, bm, b0[~same]])
            nb1 = np.concatenate([bm, b1, b1, bm[~same]])
            ne = np.concatenate([err, err, err + 1, err[~same] + 1])
            keep = (na1 > na0) & (nb1 > nb0) & (ne <= budget)
            keep &= ~((na0 == nb0) & (na1 == nb1) & (na1 - na0 == 1))  # a leaf with itself
            if keep.any():
                stack.append((depth + 1, na0[keep], na1[keep], nb0[keep], nb1[keep], ne[keep]))
        if found:
            parent = _unite(parent, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    return parent


def _split(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """The first row of each node whose bit at depth is set: binary search, all nodes at once."""
    bit = np.uint64(1 << (BITS - 1 - depth))
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) >> 1
        is_set = (prints[np.minimum(mid, len(prints) - 1)] & bit) != 0
        hi = np.where(live & is_set, mid, hi)
        lo = np.where(live & ~is_set, mid + 1, lo)
    return lo


@dataclass(frozen=True)
class Scheme:
    """The blocks, (first bit from the top, length), and the choices of blocks that come first."""

    blocks: tuple[tuple[int, int], ...]
    chosen: tuple[tuple[int, ...], ...]
    shared: int  # bits that all members of a group share


def scheme(n: int) -> Scheme:
    """The fewest blocks that keep an average group of n fingerprints small."""
    for m in range(MAX_DIFF + 1, 2 * MAX_DIFF + 1):
        edges = [BITS * k // m for k in range(m + 1)]
        blocks = tuple((a, b - a) for a, b in zip(edges, edges[1:]))
        chosen = tuple(combinations(range(m), m - MAX_DIFF))
        shared = min(sum(blocks[k][1] for k in c) for c in chosen)
        if n >> shared <= GROUP:
            break
    return Scheme(blocks, chosen, shared)


def _partition_edges(shared: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        key, permuted, fp = (t.column(c).to_numpy() for c in ("task", "permuted", "fp"))
        permuted = permuted.astype(np.int64).view(np.uint64)
        order = np.lexsort((permuted, key))
        parent = trie_forest(key[order], permuted[order], shared=shared)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        fp = fp[order]
        for k in range(0, len(child), 50_000):
            c = child[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(fp[c]), pa.array(fp[parent[c]])], ["a", "b"])

    return edges


def _permutations(fp: Column, s: Scheme) -> Column:
    """Of each choice: (its number, the first ``shared`` bits, the permuted fingerprint)."""
    field = [F.shiftrightunsigned(F.shiftleft(fp, at), BITS - n) for at, n in s.blocks]
    out = []
    for k, first in enumerate(s.chosen):
        permuted, at = F.lit(0).cast("long"), 0
        for j in (*first, *(j for j in range(len(s.blocks)) if j not in first)):
            at += s.blocks[j][1]
            permuted = permuted.bitwiseOR(F.shiftleft(field[j], BITS - at))
        out.append(F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(permuted, BITS - s.shared).alias("block"), permuted.alias("permuted")))
    return F.array(*out)


def _parts(spark, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 400_000)


def link_edges(prints: DataFrame) -> DataFrame:
    """Forest edges ``a, b`` between distinct fingerprints (column ``fp``) that connect all links."""
    n = prints.count()
    by = scheme(n)
    parts = _parts(prints.sparkSession, n * len(by.chosen))
    limit = max(LEAST_SPLIT, n * len(by.chosen) // parts)  # rows of a group beyond which it is split: an average partition
    dealt = prints.select("fp", F.explode(_permutations(F.col("fp"), by)).alias("r")).select("fp", "r.*")
    large = (
        dealt.groupBy("turn", "block").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        .select("turn", "block", F.ceil(F.col("n") / limit).alias("slices"))
    )  # at most n * choices / limit groups, that is `parts` rows
    sliced = dealt.join(F.broadcast(large), ["turn", "block"], "left")
    s = F.coalesce(F.col("slices"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), s)
    # task (i, j) of a split group holds slices i and j; slice i goes to all pairs that contain it
    tasks = F.transform(
        F.sequence(F.lit(0).cast("long"), s - 1),
        lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")),
    )
    spread = sliced.select("fp", "permuted", "turn", "block", F.explode(tasks).alias("t")).select("fp", "permuted", F.xxhash64("turn", "block", "t.i", "t.j").alias("task"))
    edges = common.map_arrow(spread.repartition(parts, "task"), _partition_edges(by.shared), "a long, b long")
    return edges.distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; root is the least node of its component."""
    spark = edges.sparkSession
    path = common.shared_dir(spark, "edges")
    now = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    seen = _shape(now)
    while True:
        limit = max(LEAST_SPLIT, 2 * seen[0] // _parts(spark, seen[0]))  # edges of a node beyond which it is a hub
        # large star: every neighbour above u goes to the least of u and its neighbours
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = common.spread_join(both.where("b > a"), least, "a", "n", limit, F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its neighbours below go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = common.spread_join(large, low, "a", "n", limit, F.xxhash64("b")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, path = path, common.shared_dir(spark, "edges")
        now = common.written(small, path)
        shape = _shape(now)
        common.remove_path(spark, last)
        if shape == seen:
            break
        seen = shape
    rooted = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return rooted.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _shape(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return tuple(r)


def classes(printed: DataFrame, place: list[str] | None = None) -> DataFrame:
    """``fp, n, component_id, keeper_fp`` and ``keeper`` of every fingerprint in ``printed`` (columns ``id, fp``, already written).

    n counts its rows; component_id is the least id of the component (null ids last), keeper_fp the
    fingerprint it has, and keeper the ``place`` columns of that row.
    """
    first = F.struct(F.col("id").isNull().alias("none"), "id", *(place or []))
    prints = printed.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    roots = components(link_edges(printed.select("fp").distinct()))
    rooted = common.materialise(prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", "n", "root"), "rooted")
    linked = rooted.where("root is not null")
    least = linked.groupBy("root").agg(F.min(F.struct("first", "fp")).alias("k"), F.count("*").alias("members"))
    size = rooted.count()
    together = common.spread_join(linked.select("fp", "n", "root"), least, "root", "members", max(LEAST_SPLIT, size // _parts(printed.sparkSession, size)), F.xxhash64("fp"))
    found = rooted.where("root is null").select("fp", "n", "first", F.col("fp").alias("keeper_fp")).unionByName(together.select("fp", "n", F.col("k.first").alias("first"), F.col("k.fp").alias("keeper_fp")))
    return found.select("fp", "n", F.col("first.id").alias("component_id"), "keeper_fp", F.col("first").alias("keeper"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    printed = common.materialise(with_fingerprint(named, "text", "fp").select("id", "fp"), "prints")
    rows = printed.count()
    found = common.materialise(classes(printed).select("fp", "n", "component_id"), "classes")
    every = common.spread_join(printed, found, "fp", "n", max(LEAST_SPLIT, rows // _parts(docs.sparkSession, rows)))
    return every.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the least id (of its repeated rows any one), with every column it came with.

    The choice is made on ids, fingerprints and places in the written files; whole rows move once, to
    meet their places, which no two rows share.
    """
    columns = docs.columns
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), docs[id_col].cast("long").alias("id"))
    printed = common.materialise(with_fingerprint(marked, "row", "fp", text_col), "printed-docs").withColumns({"file": F.col("_metadata.file_name"), "line": F.col("_metadata.row_index")})
    keepers = classes(printed.select("id", "fp", "file", "line"), ["file", "line"]).where("fp = keeper_fp").select("keeper.file", "keeper.line")
    return printed.join(keepers, ["file", "line"], "left_semi").select("row.*")
