"""SimHash near-duplicates with BK-trees.

Equal fingerprints are one node. Fingerprints within RADIUS bits agree on all but RADIUS of BLOCKS bit blocks, so each
choice of agreeing blocks deals the distinct fingerprints into shards that hold every link. A shard's fingerprints go
into a BK-tree (children keyed by their Hamming distance to the parent; a query follows only edges within the radius of
its distance) that returns a spanning forest of their links, never all pairs. The shards' trees are built where the
shuffle brings their members instead of being broadcast: all trees together are as large as the corpus has fingerprints,
which has no bound. A shard of more than MOST_IN_TREE members is linked exactly without comparing pairs: two
fingerprints within two bits have a value within one bit of both, and at most 65 fingerprints are within one bit of a value.

``alike`` finds near-duplicates by the similarity of their shingle sets instead. Of 64 bits, sets 0.8 alike differ in ten,
some of them in twenty, more than blocks or trees tell from others. So it takes SimHashes of hundreds of bits, each bit a side
of a random hyperplane, deals them by each of their bit blocks and links a shard's within WIDE_RADIUS by a BK-tree. What a
tree connects is looked at again with more bits, and the shingle sets then confirm or reject what stays connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .text import fresh, per_text, table, tidy

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Bit blocks by the count of distinct fingerprints: more blocks mean longer keys, and so smaller shards.
BLOCKS = ((1 << 24, 3), (1 << 34, 4), (1 << 64, 5))
MOST_IN_TREE = 256
#: Texts are alike if LEAST_SAME / LEAST_OF of the shingles of either are shingles of both.
ALIKE_SHINGLE, LEAST_SAME, LEAST_OF = 5, 4, 5
#: By the count of texts, the bits of a block and the blocks of a wide fingerprint. Sets just alike differ in 0.1515 of all bits, those of
#: five words' texts in 0.158: that no block agrees happens to one pair of either in ten million at most, (1 - 0.842 ** bits) ** blocks.
WIDE = ((1 << 20, 8, 60), (1 << 24, 12, 124), (1 << 64, 16, 248))
#: Trees compare the first 192 bits. Of pairs just alike one in a hundred million differs in more than the radius, of unrelated ones all but one in a million do.
TREE_WORDS, WIDE_RADIUS = 3, 62
#: What a tree connects is connected again by the first 448 bits, which few unrelated texts pass. Of pairs just alike one in a hundred million differs in more.
CLOSE_WORDS, CLOSE_RADIUS = 7, 118
#: A group of more members is compared in cells: first each with its hub, then parts of these sizes with each other where they are still apart.
#: So many shingles, in all sets of a cell's side, split it as well.
CELL, SIDE, MOST_SHINGLES = 64, 256, 1 << 20
#: So many fingerprints of a tree are compared with all that reach them at once, without edges; and with so many others at a time.
LEAF, AT_ONCE = 64, 1 << 14

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each word shingle of a text in its order, all words being one shingle if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) per row, fp as a signed 64-bit number."""

    def prepare():
        return lambda x: (f - (1 << 64) if (f := fingerprint(x, shingle)) >> 63 else f,)

    return docs.select(F.col(key), F.col(text).alias("_text")).select(F.col(key), per_text(prepare, "fp bigint")(F.col("_text"))["fp"].alias("fp"))


class BKTree:
    """Fingerprints in a tree by Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indices of members within the radius; only edges whose key is within the radius of the node's distance are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            todo += [child for k, child in self.children[node].items() if d - radius <= k <= d + radius]
        return found

    def add(self, value: int) -> None:
        node, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[node] ^ value).bit_count()
            child = self.children[node].setdefault(d, new)
            if child == new:
                return
            node = child


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that connect the distinct unsigned values as all such links do: at most one fewer than values."""
    tree, parent, links = BKTree(), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        new = len(parent)
        parent.append(new)
        for node in tree.near(value, radius):
            if (a := root(node)) != (b := root(new)):
                parent[b] = a
                links.append((value, tree.values[node]))
        tree.add(value)
    return links


def _shards(distinct: DataFrame, blocks: int) -> DataFrame:
    """(shard, rest, fp): for each choice of agreeing blocks the fingerprint with its shard; a shard is the choice's number and the bits of its blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - RADIUS):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    choices = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(masks)])
    return distinct.select("fp", F.explode(choices).alias("s")).select(F.col("s.choice").alias("choice"), F.col("s.bits").alias("bits"), "fp")


_MASK = (1 << 64) - 1
_signed = lambda x: x - (1 << 64) if x >> 63 else x


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each shard from rows sorted by shard; a shard may go on in the next batch."""
    shard, members = None, []

    def done() -> list[tuple[int, int]]:
        return forest(members) if len(members) > 1 else []

    for batch in batches:
        links = []
        for choice, bits, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != (choice, bits):
                links += done()
                shard, members = (choice, bits), []
            members.append(fp & _MASK)
        yield _link_batch(links)
    yield _link_batch(done())


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _crowd_links(crowd: DataFrame) -> DataFrame:
    """Links (u, v) that connect the fingerprints as all pairs within two bits do, by values within one bit of both."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << k)) for k in range(64)])
    middles = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    groups = middles.groupBy("mid").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select("fps", F.array_min("fps").alias("v"))
    return groups.select(F.explode("fps").alias("u"), "v").filter("u <> v").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) links between distinct fingerprints (column fp) that give the same components as all pairs within RADIUS bits."""
    n = distinct.count()
    blocks = next(b for most, b in BLOCKS if n <= most)
    shards = _shards(distinct, blocks)
    counts = shards.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = counts.filter(F.col("n") > MOST_IN_TREE).select("choice", "bits")
    dealt = shards.join(counts, ["choice", "bits"])
    trees = dealt.filter(F.col("n") <= MOST_IN_TREE).select("choice", "bits", "fp").repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp").mapInArrow(_tree_links, "u bigint, v bigint")
    crowd = shards.join(crowded, ["choice", "bits"]).select("fp").distinct()
    return trees.unionByName(_crowd_links(crowd))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fp (signed), component_id: the smallest key that it reaches over links of RADIUS bits or fewer.

    Null and empty texts have fingerprint zero and link like any other; rows with a null key get their component's
    smallest key that is not null; repeated rows each give a row. Other columns of the input are left out.
    """
    prints = cut(fingerprints(docs, key, text))
    nodes = cut(prints.groupBy("fp").agg(F.min(key).alias("rep")))
    roots = cut(components(links(nodes.select("fp"))).withColumnRenamed("u", "fp"))
    linked = nodes.join(roots, "fp")
    # written first: the join then reads two plain shuffles, and a large component's rows can be split over tasks
    least = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = roots.join(least, "root").select("fp", "component_id")
    alone = nodes.join(roots, "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
    return prints.join(named.unionByName(alone), "fp").select(key, "fp", "component_id")


def _planes(bits: int) -> np.ndarray:
    """An odd factor for each eight hyperplanes."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, -(-bits // 8), np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(hashes: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The bits of a SimHash by hyperplanes: each has a number from -128 to 127 for a hash, and a bit is 1 if they sum to more than is expected."""
    sums = np.zeros(8 * len(planes), np.int64)
    for at in range(0, len(hashes), 1 << 10):
        x = hashes[at : at + (1 << 10), None] * planes
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        sums += x.view(np.int8).sum(axis=0, dtype=np.int32)
    return 2 * sums > -len(hashes)


def _distances(prints: np.ndarray, others: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differing bits of each of some fingerprints and each of others."""
    return sum(np.bitwise_count(prints[at, k][:, None] ^ prints[others, k]) for k in range(prints.shape[1]))


def tree_groups(prints: np.ndarray, radius: int) -> np.ndarray:
    """A label for each fingerprint (a row of unsigned words), the same for all that links within the radius connect.

    One BK-tree of all, whose searches go down together: a node is compared at once with its subtree and with all whose
    search reaches it, and they follow only edges within the radius of their distance. A subtree of one label is no
    longer compared within itself or with that label, so that a large group of copies costs one look at each.
    """
    label = np.arange(len(prints), dtype=np.int32)

    def unite(at: np.ndarray) -> None:
        old = label[at]
        if (old != old[0]).any():
            label[np.isin(label, old)] = old.min()

    todo = []

    def later(members: np.ndarray, queries: np.ndarray) -> None:
        first = label[members[0]]
        if (label[members] == first).all():
            queries = queries[label[queries] != first]
            if not len(queries):
                return
        todo.append((members, queries))

    later(label.copy(), label[:0].copy())
    while todo:
        members, queries = todo.pop()
        if len(members) <= LEAF:
            others = np.concatenate([members, queries])
            for at in range(0, len(others), AT_ONCE):
                near = _distances(prints, part := others[at : at + AT_ONCE], members) <= radius
                a, b = (x[k] for x, k in zip((members, part), np.nonzero(near), strict=True))
                for k in np.unique(a[label[a] != label[b]]):
                    unite(np.append(b[a == k], k))
            continue
        node, rest = members[:1], members[1:]
        of_rest, of_queries = (_distances(prints, x, node)[0].astype(np.int64) for x in (rest, queries))
        unite(np.concatenate([node, rest[of_rest <= radius], queries[of_queries <= radius]]))
        by, by_queries = np.argsort(of_rest, kind="stable"), np.argsort(of_queries, kind="stable")
        rest, of_rest, queries, of_queries = rest[by], of_rest[by], queries[by_queries], of_queries[by_queries]
        edges, starts = np.unique(of_rest, return_index=True)
        ends = np.append(starts[1:], len(rest))
        # of two subtrees the one at the longer edge is searched for the other's members
        lows, (q_lows, q_highs) = np.searchsorted(of_rest, edges - radius), (np.searchsorted(of_queries, edges - radius), np.searchsorted(of_queries, edges + radius, "right"))
        for a, b, low, q_low, q_high in zip(starts, ends, lows, q_lows, q_highs, strict=True):
            later(rest[a:b], np.concatenate([rest[low:a], queries[q_low:q_high]]))
    return label


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of whole runs of the first column, by which they are sorted; a run may go on in the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        last = int(np.searchsorted(first, first[-1]))
        if last or (waiting and waiting[-1].column(0)[-1].as_py() != first[0]):
            yield pa.Table.from_batches([*waiting, *([batch.slice(0, last)] if last else [])]).combine_chunks()
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _bounds(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of two or more equal numbers starts and ends."""
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return ((a, b) for a, b in zip(starts, np.append(starts[1:], len(of)), strict=True) if b - a > 1)


def _shard_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(band, head, d, n) of all groups of n > 1 members that the shards' trees connect, from rows (shard, d, words) sorted by shard and d; the head is the least d."""
    for table_ in _runs(batches):
        rows = np.stack([c.to_numpy() for c in table_.columns])
        found = [np.empty((4, 0), np.int64)]
        for a, b in _bounds(rows[0]):
            d = rows[1, a:b]
            label = tree_groups(np.ascontiguousarray(rows[2:, a:b].T).view(np.uint64), radius)
            n = np.bincount(label, minlength=b - a)[label]
            if (many := n > 1).any():
                head = d[label[many]]
                with np.errstate(over="ignore"):
                    band = rows[0, a] * np.int64(0x1E3779B97F4A7C15) ^ head  # equal ones of two groups would only be compared in vain
                found.append(np.stack([band, head, d[many], n[many]]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(found, axis=1)], names=["band", "head", "d", "n"])
    tidy()


def _set(text: str | None) -> tuple[int, np.ndarray]:
    """The digest of a text's set of shingles, signed, and the sorted set."""
    hashes = np.unique(shingle_hashes(text, ALIKE_SHINGLE))
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)), hashes


def cell_links(d: np.ndarray, part: np.ndarray, side: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (u, v) that connect a cell's members as do all its pairs of different parts and sides, or of side 2, that are close and alike.

    A pair that is connected already is not compared; the others are, set by set, so that no row is made of a pair.
    """
    label = np.unique(part, return_inverse=True)[1]
    size, links = np.array([len(x) for x in sets]), []
    for k in range(len(d) - 1):
        other = k + 1 + np.flatnonzero((label[k + 1 :] != label[k]) & ((side[k + 1 :] != side[k]) | (side[k] == 2)))
        other = other[(LEAST_OF * size[other] >= LEAST_SAME * size[k]) & (LEAST_OF * size[k] >= LEAST_SAME * size[other])]
        other = other[np.bitwise_count(prints[other] ^ prints[k]).sum(axis=1) <= CLOSE_RADIUS]
        if not len(other):
            continue
        theirs = np.concatenate([sets[x] for x in other])
        at = np.minimum(np.searchsorted(sets[k], theirs), size[k] - 1)
        same = np.add.reduceat(sets[k][at] == theirs, np.append(0, np.cumsum(size[other])[:-1]), dtype=np.int64)
        other = other[same * (LEAST_SAME + LEAST_OF) >= LEAST_SAME * (size[k] + size[other])]
        for x in other[np.unique(label[other], return_index=True)[1]]:
            links.append((int(d[k]), int(d[x])))
        label[np.isin(label, label[other])] = label[k]
    return links


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each cell from rows (cell, d, part, side, print, hashes) sorted by cell."""
    for rows in _runs(batches):
        cell, d, part, side = (rows.column(k).to_numpy() for k in range(4))
        prints = rows.column(4).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(d), -1)
        hashes = rows.column(5).combine_chunks()
        hashes = hashes.chunk(0) if isinstance(hashes, pa.ChunkedArray) else hashes
        ends = np.append(0, np.cumsum(hashes.value_lengths().to_numpy()))
        values = hashes.flatten().to_numpy().view(np.uint64)
        links = []
        for a, b in _bounds(cell):
            links += cell_links(d[a:b], part[a:b], side[a:b], prints[a:b], [values[ends[k] : ends[k + 1]] for k in range(a, b)])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])
    tidy()


def _in_cells(rows: DataFrame) -> DataFrame:
    """Links (u, v) from rows (cell, d, part, side, print, hashes)."""
    return rows.select("cell", "d", "part", "side", "print", "hashes").repartition("cell").sortWithinPartitions("cell", "d").mapInArrow(_cells, "u bigint, v bigint")


def _number(n: str, total: str, most: int) -> Column:
    """Into how many cells or sides go n sets of so many shingles in all."""
    return F.ceil(F.greatest(F.col(n) / most, F.col(total) / MOST_SHINGLES)).cast("int")


def _still_apart(sets: DataFrame, near: DataFrame) -> DataFrame:
    """Links between the parts that the links so far leave in groups of several cells: every two sides of a group, but never two of one part."""
    roots = cut(components(near).withColumnRenamed("u", "d"))
    parts = cut(sets.filter("cells > 1").select("grp", "d", "size").join(roots, "d", "left").select("grp", "d", "size", F.coalesce("root", "d").alias("part")))
    of_part = cut(parts.groupBy("grp", "part").agg(F.count("*").alias("n"), F.sum("size").alias("total")))
    apart = of_part.groupBy("grp").agg(F.count("*").alias("k")).filter("k > 1").select("grp")
    # a part that fills sides has its own, the rest of the group's share theirs
    own = F.when((F.col("n") > SIDE) | (F.col("total") > MOST_SHINGLES), F.col("part"))
    of_part = cut(of_part.join(apart, "grp").withColumn("own", own))
    number = of_part.groupBy("grp", "own").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    number = cut(number.select("grp", "own", _number("n", "total", SIDE).alias("k")))
    sides = number.select("grp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at")).select("grp", "own", F.xxhash64("grp", F.coalesce("own", F.lit(0)), F.col("own").isNull(), "at").alias("a"))
    sides = cut(sides)
    pairs = sides.alias("x").join(sides.alias("y"), F.expr("x.grp = y.grp AND (x.a < y.a AND NOT coalesce(x.own = y.own, false) OR x.a = y.a AND x.own IS NULL)"))
    pairs = pairs.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.xxhash64("x.a", "y.a").alias("cell"))
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("a"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("a"), F.lit(0).alias("side")), F.struct(F.col("b").alias("a"), F.lit(1).alias("side"))))
    cells = cut(pairs.select("cell", F.explode(ends).alias("e")).select("cell", "e.a", "e.side"))
    mine = of_part.select("grp", "part", "own").join(number.select("grp", F.col("own").alias("own_"), "k"), ["grp"]).filter("own <=> own_")
    placed = cut(parts.select("d", "grp", "part").join(mine.select("grp", "part", "own", "k"), ["grp", "part"]))
    placed = placed.select("d", "part", F.xxhash64("grp", F.coalesce("own", F.lit(0)), F.col("own").isNull(), F.expr("cast(pmod(xxhash64(d), k) as int)")).alias("a"))
    return _in_cells(placed.join(cells, "a").join(sets.filter("cells > 1").select("d", "print", "hashes"), "d"))


def alike(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row with a key: key, component_id: the smallest key that it reaches over pairs of texts that are alike.

    Equal sets are one node. Each bit block of the wide fingerprints deals them into shards, whose BK-trees give bands: what
    a shard's links connect. More of the bits split the bands, and what they leave connected are the groups, each set being
    in one at most. A group's sets meet in cells, where all pairs are compared that are close and not yet connected. Those of
    a large group meet first in one cell each, beside the one that has most others in its bands, the least changed of a
    group of copies; only parts that this leaves apart meet again.
    """
    named = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = named.count()
    bits, blocks = next((b, k) for most, b, k in WIDE if n <= most)
    words = -(-bits * blocks // 64)

    def sketches():
        planes = _planes(bits * blocks)

        def one(x: str) -> tuple:
            d, hashes = _set(x)
            packed = np.zeros(8 * words if len(hashes) else 0, np.uint8)
            if len(hashes):
                packed[: len(planes)] = np.packbits(wide_fingerprint(hashes, planes), bitorder="little")
            return d, len(hashes), packed.view("<i8")

        return one

    def whole():
        def one(x: str) -> tuple:
            d, hashes = _set(x)
            return d, hashes.view(np.int64)

        return one

    def block(k: int) -> Column:
        word, at = divmod(k * bits, 64)
        found = F.shiftrightunsigned(F.col("print")[word], at)
        if at + bits > 64:
            found = found.bitwiseOR(F.shiftleft(F.col("print")[word + 1], 64 - at))
        return found.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).bitwiseOR(F.lit(k << bits).cast("bigint"))

    def first(n: int) -> list[Column]:
        return [F.col("print")[k].alias(f"w{k}") for k in range(n)]

    def trees(shards: DataFrame, radius: int) -> DataFrame:
        found = shards.repartition(shards.columns[0]).sortWithinPartitions(*shards.columns[:2])
        return cut(found.mapInArrow(partial(_shard_groups, radius=radius), "band bigint, head bigint, d bigint, n bigint"))

    rows = cut(named.select("key", per_text(sketches, "d bigint, size int, print array<bigint>")(F.col("text")).alias("s")).select("key", "s.*"))
    nodes = cut(rows.groupBy("d").agg(F.min("key").alias("rep")))
    prints = cut(rows.filter("size > 0").dropDuplicates(["d"]).select("d", "size", "print"))
    bands = trees(prints.select(F.explode(F.array(*[block(k) for k in range(blocks)])).alias("shard"), "d", *first(TREE_WORDS)), WIDE_RADIUS)
    close = trees(bands.select("band", "d").join(prints, "d").select("band", "d", *first(CLOSE_WORDS)), CLOSE_RADIUS)
    groups = cut(components(close.select(F.col("d").alias("u"), F.col("head").alias("v"))).select(F.col("u").alias("d"), F.col("root").alias("grp")))
    weights = close.groupBy("d").agg(F.sum("n").alias("w"))
    groups = cut(groups.join(weights, "d").join(prints.select("d", "size", F.slice("print", 1, CLOSE_WORDS).alias("print")), "d"))
    hubs = groups.groupBy("grp").agg(F.max(F.struct("w", "d"))["d"].alias("hub"), F.count("*").alias("n"), F.sum("size").alias("total"))
    hubs = cut(hubs.select("grp", "hub", _number("n", "total", CELL).alias("cells")))
    groups = groups.join(hubs, "grp").select("grp", "d", "size", "hub", "cells", "print")
    texts = named.join(nodes.join(groups.select("d"), "d").select(F.col("rep").alias("key")).distinct(), "key", "left_semi")
    found = texts.select(per_text(whole, "d bigint, hashes array<bigint>")(F.col("text")).alias("s")).select("s.*")
    sets = cut(found.join(groups, "d").dropDuplicates(["d"]))
    at = F.expr("if(d = hub, sequence(0, cells - 1), array(cast(pmod(xxhash64(d), cells) as int)))")
    near = cut(_in_cells(sets.select(F.explode(at).alias("at"), "*").select(F.xxhash64("grp", "at").alias("cell"), "d", F.col("d").alias("part"), F.lit(2).alias("side"), "print", "hashes")))
    roots = cut(components(near.unionByName(_still_apart(sets, near))).withColumnRenamed("u", "d"))
    linked = nodes.join(roots, "d")
    least = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id")))
    of = roots.join(least, "root").select("d", "component_id")
    alone = nodes.join(roots, "d", "left_anti").select("d", F.col("rep").alias("component_id"))
    return rows.select("key", "d").join(of.unionByName(alone), "d").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", by: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each component, that with the smallest key, with all its columns; of rows with equal keys one. Rows with a null key can't be named and all stay."""
    found = cut(by(docs, key, text))
    kept = fresh(docs, "_kept")
    stay = found.filter(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias(kept)).agg(F.count("*").alias("_n"))
    repeated = not stay.filter("_n > 1").isEmpty()
    out = docs.join(stay.select(kept), F.col(key) == F.col(kept), "left_semi")
    out = out.dropDuplicates([key]) if repeated else out
    return out if docs.filter(F.col(key).isNull()).isEmpty() else out.unionByName(docs.filter(F.col(key).isNull()))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
