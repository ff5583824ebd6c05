"""Near-duplicates by bottom-k sketches.

Words are lower-cased (A-Z) and hashed, ``words`` of them in a row are a shingle, and one hash
function orders the shingles; a document's ``SKETCH`` smallest values are its sketch.

1. Documents with the same shingle set are one node (grouped by a 128-bit digest of the set).
2. Inverted lists of retained values: the first ``PROBES`` values of each node name the lists it
   is in.  A value in more than ``COMMON`` nodes says little; nodes skip such values and take the
   next, except those made mostly of them, which use both.  Two nodes above the threshold share
   none of their lists with a chance below 10^-4 at the very threshold, and far less above it.
3. In a list, overlaps of sketches are counted and the union sketch estimates the similarity;
   pairs far below the threshold (six standard deviations) are dropped.  Only links that join
   two groups of the list are written, so a list of n nodes gives n rows at most.  Lists longer
   than ``LIST_ROWS`` are cut into blocks and compared block by block.
4. Nodes joined by estimates form bundles.  Each bundle's texts are read once, and all pairs of
   full shingle sets in it are compared exactly, again writing only links that join groups.
   Bundles over ``BLOCK_SHINGLES`` are cut into blocks by shingles, each pair of blocks a group of its own.
5. Exact links give the components; a component is named by its smallest id.

No list, bundle or group is held whole by one task or the driver, and no pair within a group is
written out.  Work inside a bundle of near copies grows with its blocks' pairs.

Null or empty text, or text without words, has an empty set: no links, a component of its own.
A document of fewer words than a shingle has its whole sequence as one shingle.  A null id has
no links, a null component and is kept.  Repeated rows of one id share its component, also
with different texts (each text's links count); only a row with an empty set stays by itself.
Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import cut, map_batches, ship

SKETCH, RETAINED, PROBES, COMMON = 64, 32, 12, 200
LIST_ROWS, BLOCK_SHINGLES = 1024, 400_000
#: Bytes hashed at once.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_LANES = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F,
                   0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit values (three rounds of shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint64)
    upper = (codes >= 65) & (codes <= 90)
    value = mixed(np.where(upper, codes + np.uint64(32), codes) + np.uint64(1))
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return value, space


class Shingler:
    """Hashes of words and shingles, vectorised over chunks of bytes."""

    def __init__(self, words: int):
        self.words = words
        self.value, self.space = _tables()
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.power = np.multiply.accumulate(steps)
            back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            back[0] = 1
            self.inverse = np.multiply.accumulate(back)

    def word_hashes(self, raw: bytes) -> np.ndarray:
        """A hash of each word; the text is cut at white space into chunks."""
        out, at, n = [], 0, len(raw)
        while at < n:
            to = min(at + CHUNK, n)
            while to < n and not self.space[raw[to]]:
                to += 1
            out.append(self._chunk(np.frombuffer(raw, np.uint8, to - at, at)))
            at = to
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _chunk(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        solid = np.concatenate([[False], ~self.space[data], [False]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.power[:len(data)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def set_of(self, raw: bytes | None) -> np.ndarray:
        """The distinct shingles of a text, as sorted hashes."""
        words = self.word_hashes(raw) if raw else np.empty(0, np.uint64)
        size = min(self.words, len(words))
        if not size:
            return words
        count = len(words) - size + 1
        total = np.full(count, size, np.uint64)
        for j in range(size):
            total += words[j:j + count] * _LANES[j]
        return np.unique(mixed(total))


def _sketcher(words: int):
    made: list[Shingler] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Shingler(words))
        sizes, digests, sketches = [], [], []
        for value in batch.column(1):
            found = made[0].set_of(value.as_py())
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            sketches.append(found[:SKETCH].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
            ["key", "n", "digest", "sketch"])

    return run


# ---- groups of sorted rows ------------------------------------------------------------------


class Groups:
    """Union-find over the places of one group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        low, high = sorted((int(self.label[a]), int(self.label[b])))
        self.label[self.label == high] = low


def close(shared, union, percent: int):
    return 100 * shared >= percent * union


def _links(sets: list[np.ndarray], sides: np.ndarray | None, least, verify):
    """Pairs that join two groups: candidates by overlap counts, each put to ``verify``.

    ``sides`` given: only pairs of different sides are looked at.
    """
    n = len(sets)
    if n < 2:
        return
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), lengths)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    groups = Groups(n)
    for x in range(n - 1):
        low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        spans = high - low
        total = int(spans.sum())
        if total == len(sets[x]):  # every value is its own alone
            continue
        where = np.repeat(low - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(total)
        shared = np.bincount(owner[where], minlength=n)
        open_ = (np.arange(n) > x) & (groups.label != groups.label[x]) & least(shared, lengths[x], lengths)
        if sides is not None:
            open_ &= sides != sides[x]
        for y in np.flatnonzero(open_):
            if groups.label[x] != groups.label[y] and verify(x, y, shared[y]):
                groups.join(x, y)
                yield x, int(y)


def _estimated(sets: list[np.ndarray], sides, percent: int):
    """Links by the union sketch; sketches that hold whole sets are compared exactly."""
    margin = percent - 30

    def least(shared, a, b):
        return 100 * shared >= margin * np.maximum(a, b)

    def verify(x, y, shared):
        union = np.union1d(sets[x], sets[y])
        whole = len(sets[x]) < SKETCH and len(sets[y]) < SKETCH
        if whole:
            return close(shared, len(union), percent)
        edge = union[:SKETCH][-1]
        both = np.intersect1d(sets[x], sets[y], assume_unique=True)
        return 100 * np.count_nonzero(both <= edge) >= margin * min(SKETCH, len(union))

    return _links(sets, sides, least, verify)


def _exact(sets: list[np.ndarray], sides, percent: int):
    def least(shared, a, b):
        return close(shared, a + b - shared, percent)

    return _links(sets, sides, least, lambda x, y, shared: True)


def _by_group(batches, group_of, row_of, finish):
    """Rows come sorted by group; each group is finished as soon as the next one begins."""
    current, rows = None, []
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            group = group_of(columns, i)
            if group != current:
                yield from finish(current, rows)
                current, rows = group, []
            rows.append(row_of(columns, i))
    yield from finish(current, rows)


def _pair_batches(pairs, kind, limit: int = 10_000):
    left, right = [], []
    for a, b in pairs:
        left.append(a)
        right.append(b)
        if len(left) == limit:
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["u", "v"])
            left, right = [], []
    yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["u", "v"])


def _list_links(percent: int):
    """Rows ``list, one, other, side, key, sketch`` sorted by the first three."""

    def finish(group, rows):
        sets = [np.sort(np.asarray(r[2], np.int64).view(np.uint64)) for r in rows]
        sides = np.array([r[0] for r in rows]) if group and group[1] != group[2] else None
        for x, y in _estimated(sets, sides, percent):
            yield rows[x][1], rows[y][1]

    def run(batches):
        group_of = lambda c, i: (c[0][i].as_py(), c[1][i].as_py(), c[2][i].as_py())
        row_of = lambda c, i: (c[3][i].as_py(), c[4][i].as_py(), c[5][i].values.to_numpy())
        yield from _pair_batches(_by_group(batches, group_of, row_of, finish), pa.int64())

    return run


def _bundle_links(words: int, percent: int):
    """Rows ``bundle, one, other, side, key, digest, body`` sorted by the first three."""

    def run(batches):
        shingler = Shingler(words)

        def row_of(c, i):
            found = shingler.set_of(c[6][i].as_py())
            same = hashlib.blake2b(found.tobytes(), digest_size=16).digest() == c[5][i].as_py()
            return c[3][i].as_py(), c[4][i].as_py(), found if same else None, c[5][i].as_py()

        def finish(group, rows):
            rows = list({(r[1], r[3]): r for r in rows if r[2] is not None}.values())
            sides = np.array([r[0] for r in rows]) if group and group[1] != group[2] else None
            for x, y in _exact([r[2] for r in rows], sides, percent):
                yield rows[x][1], rows[y][1]

        group_of = lambda c, i: (c[0][i].as_py(), c[1][i].as_py(), c[2][i].as_py())
        yield from _pair_batches(_by_group(batches, group_of, row_of, finish), pa.int64())

    return run


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of."""
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    return rows.withColumn("blocks", blocks.cast("long")).withColumn("side", own).withColumn(
        "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).withColumns({"one": F.least("side", "at"), "other": F.greatest("side", "at")}).drop("blocks", "at")


def _grouped(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    keys = [group, "one", "other"]
    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, "key")


def components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of each document; ids are whole numbers."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("body"))
    sketched = cut(map_batches(rows, _sketcher(words), "key long, n long, digest binary, sketch array<long>"))
    named = sketched.where("n > 0 and key is not null")
    nodes = named.groupBy("digest").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes)
    edges = _exact_links(rows, nodes, words, percent).where("u <> v").union(_id_links(named, nodes))
    labels = connected_components(edges.select("u").union(edges.select(F.col("v").alias("u"))).distinct(), edges, node="u")
    of_set = nodes.select(F.col("digest").alias("d"), F.col("key").alias("node")).join(labels, F.col("node") == F.col("u"), "left").select(
        "d", F.coalesce("component", "node").alias("component"))
    found = sketched.join(of_set, (F.col("digest") == F.col("d")) & F.col("key").isNotNull() & (F.col("n") > 0), "left")
    component = F.coalesce("component", "key")
    return found.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def _id_links(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``u, v``: the nodes of an id that has several sets, each linked to the id itself."""
    several = named.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("key")
    sets = named.select("key", "digest").join(several, "key").distinct()
    return sets.join(nodes.select("digest", F.col("key").alias("node")), "digest").where("node <> key").select(
        F.col("node").alias("u"), F.col("key").alias("v"))


def _exact_links(rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """``u, v``: links of nodes that span every component."""
    bundles = _bundles(nodes, percent)
    sizes = bundles.groupBy("bundle").agg(F.sum("n").alias("total"))
    members = _in_blocks(bundles.join(sizes, "bundle"), F.ceil(F.col("total") / BLOCK_SHINGLES))
    texts = rows.withColumnRenamed("key", "k").join(members, F.col("k") == F.col("key"))
    grouped = _grouped(texts, "bundle", ["side", "key", "digest", "body"])
    return cut(grouped.mapInArrow(_bundle_links(words, percent), "u long, v long"))


def _bundles(nodes: DataFrame, percent: int) -> DataFrame:
    """``bundle, key, n, digest`` of the nodes that some estimate joins to another."""
    values = nodes.select("key", F.posexplode(F.slice("sketch", 1, RETAINED)).alias("at", "value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = values.join(counts, "value").groupBy("key").agg(F.collect_list(F.struct("at", "value", "c")).alias("shared"))
    shared = shared.join(nodes.select("key", "n"), "key")
    common = F.filter("shared", lambda s: s["c"] > COMMON)
    rare = F.filter("shared", lambda s: s["c"] <= COMMON)
    before = lambda s: F.size(F.filter("common", lambda y: y["at"] < s["at"]))
    mostly = 2 * F.size("common") >= F.least(F.col("n"), F.lit(RETAINED))
    listed = cut(shared.withColumns({"common": common, "rare": rare}).select(
        "key", F.explode(F.array_distinct(F.concat(
            F.transform(F.filter("rare", lambda s: s["at"] - before(s) < PROBES), lambda s: s["value"]),
            F.when(mostly, F.transform(F.filter("shared", lambda s: s["at"] < PROBES), lambda s: s["value"])).otherwise(
                F.array().cast("array<long>")),
        ))).alias("list")))
    lengths = listed.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    placed = _in_blocks(listed.join(lengths, "list"), F.ceil(F.col("rows") / LIST_ROWS))
    sketched = placed.join(nodes.select("key", "sketch"), "key")
    joined = _grouped(sketched, "list", ["side", "key", "sketch"]).mapInArrow(_list_links(percent), "u long, v long")
    joined = cut(joined.distinct())
    ends = joined.select("u").union(joined.select(F.col("v").alias("u"))).distinct()
    labels = connected_components(ends, joined, node="u").select(F.col("u").alias("key"), F.col("component").alias("bundle"))
    return labels.join(nodes.select("key", "n", "digest"), "key")


ship(__name__)
