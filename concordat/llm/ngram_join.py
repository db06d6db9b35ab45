"""N-gram Jaccard join by chosen paths, and near-duplicate classes from its links.

The self-join finds all pairs of different shingle sets with Jaccard similarity of at least
``threshold``. Sets are embedded by minwise hashing, so each coordinate is a sampled token that two
sets share with probability equal to their similarity. Every *run* starts a tree: its root splits
the sets on one sampled token, and a node with more than ``small`` sets is split again on further
sampled tokens until its sets are few, or until a split would no longer halve the pairs to compare,
because its members agree on so many tokens. What remains are leaves, compared by brute force: a bit
sketch first, then the exact sets. The number of runs follows from the recall that is asked for, at
any depth of the trees.

Large leaves are cut into blocks and each pair of blocks is one unit of work, so no task holds an
unbounded group. Leaves count the links of their members and give a spanning forest; pairs are
never written out. A pair that meets in several leaves counts in the first one only.

Defined results:

* Words are lower-cased runs of characters other than ASCII white space. A text with fewer words
  than a shingle takes has one shingle. A text with none (null, empty, white space) is a class of
  its own and has no link.
* Texts with equal shingle sets are copies: one class member stands for them, links count
  different sets, and ``n_copies`` tells how many rows have the set.
* ``class_id`` is the smallest id of the class. Rows with a null id, and with a null id only,
  form classes whose ``class_id`` is null.
* Repeated ids are rows of their own; the smallest id of a class may then occur more than once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import Scratch, free_name, maybe_in, mix64, shingle_hashes, tidy, valid_text, word_hashes

BITS = 128
COORDS = 48


def _binomial(n: int, k: int, p: float) -> float:
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)


@dataclass(frozen=True)
class JoinConfig:
    """``threshold`` is a fraction ``(numerator, denominator)``, so that the exact test stays in
    whole numbers."""

    width: int = 5
    threshold: tuple[int, int] = (4, 5)
    recall: float = 0.9999
    #: Sets of a leaf that are compared without a further split; at this size a set's comparisons in its
    #: leaf cost about as much as the two rows that a split would write for it.
    small: int = 512
    branches: int = 2
    max_depth: int = 8
    #: A node is split on if its children, all branches together, hold at most this share of its pairs.
    #: Families of near copies agree on most tokens: splitting them writes rows and spares no comparison.
    worth: float = 0.5
    block_sets: int = 1024
    block_shingles: int = 1 << 21
    filter_bits: int = 1 << 26
    seed: int = 20_240_917

    def miss(self, runs: int) -> float:
        """The rate at which a pair exactly at the threshold meets in no leaf or fails the sketch, if all
        trees are split ``max_depth`` times. All runs draw from the same ``COORDS`` coordinates, so the
        mean is taken over how many of these the pair shares. A pair stays together in a node if any
        branch takes it on, and ends where the node is not split."""
        same = self.threshold[0] / self.threshold[1]
        total = 0.0
        for k in range(COORDS + 1):
            held = 1.0
            children = [1.0]  # how many different children of a node hold the pair: branches may draw one coordinate twice
            for _ in range(self.branches):
                found = [k / COORDS - j / COORDS if j < k else 0.0 for j in range(len(children))]
                children = [(children[j] * (1 - found[j]) if j < len(children) else 0.0) + (children[j - 1] * found[j - 1] if j else 0.0) for j in range(len(children) + 1)]
            for _ in range(self.max_depth):
                held = 1 - sum(p * (1 - held) ** j for j, p in enumerate(children))
            total += _binomial(COORDS, k, same) * (1 - same * held) ** runs
        return total + sum(_binomial(BITS, k, (1 - same) / 2) for k in range(self.most_unlike_bits + 1, BITS + 1))

    @property
    def runs(self) -> int:
        """The fewest runs with the asked recall at the threshold, however deep the trees get."""
        if self.miss(1 << 20) > 1 - self.recall:
            raise ValueError(f"a recall of {self.recall} cannot be reached with {self.branches} branches, {COORDS} coordinates and {BITS} sketch bits")
        return next(n for n in range(1, (1 << 20) + 1) if self.miss(n) <= 1 - self.recall)

    @property
    def most_unlike_bits(self) -> int:
        """Sketch bits that may differ: 4.8 standard deviations above the mean of a pair that is
        exactly at the threshold."""
        p = (1 - self.threshold[0] / self.threshold[1]) / 2
        return math.ceil(BITS * p + 4.8 * math.sqrt(BITS * p * (1 - p)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    words = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))
    return np.unique(shingle_hashes(words, width))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class _Embedding:
    """Minwise hashing of a shingle set: root tokens, sketch bits and split coordinates."""

    def __init__(self, config: JoinConfig):
        draw = np.random.default_rng(config.seed)
        self.root = draw.integers(0, 1 << 63, config.runs, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.odd = draw.integers(0, 1 << 31, BITS + COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = draw.integers(0, 1 << 32, BITS + COORDS, dtype=np.uint32)

    def __call__(self, shingles: np.ndarray) -> bytes:
        tokens = [shingles[np.argmin(mix64(shingles * a))] for a in self.root]
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(BITS + COORDS, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(short), 4096):
            np.minimum(least, (short[at : at + 4096, None] * self.odd + self.add).min(axis=0), out=least)
        least = least * np.uint32(0x9E3779B1)
        bits = np.packbits((least[:BITS] >> np.uint32(31)).astype(np.uint8))
        return np.array(tokens, dtype=">u8").tobytes() + bits.tobytes() + (least[BITS:] >> np.uint32(16)).astype(">u2").tobytes()


def _embed(config: JoinConfig):
    schema = pa.schema([("id", pa.int64()), ("cls", pa.binary()), ("size", pa.int32()), ("pay", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = _Embedding(config)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[tuple] = []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text, config.width)
                    rows.append((digest(s), len(s), embedding(s)) if len(s) else (None, 0, None))
                cls, size, pay = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(size, pa.int32()), pa.array(pay, pa.binary())], schema=schema)

    return run


class Group:
    """The rows of one unit of work, as columns."""

    def __init__(self, key: tuple, cols: dict[str, list]):
        self.key, self.cols = key, cols
        self.size = np.array(cols["size"], dtype=np.int64)
        self.bits = np.frombuffer(b"".join(cols["bits"]), dtype=np.uint64).reshape(-1, BITS // 64)

    def __len__(self) -> int:
        return len(self.size)

    def candidates(self, config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs whose sizes and sketches allow a link, and whose first common leaf this is."""
        leaf, one, two = self.key
        block = np.array(self.cols["block"])
        num, den = config.threshold
        left, right = [], []
        for at in range(0, len(self), 256):
            rows = slice(at, at + 256)
            fits = np.minimum(self.size[rows, None], self.size) * den >= np.maximum(self.size[rows, None], self.size) * num
            unlike = np.zeros(fits.shape, dtype=np.uint8)
            for k in range(self.bits.shape[1]):
                unlike += np.bitwise_count(self.bits[rows, None, k] ^ self.bits[None, :, k])
            fits &= unlike <= config.most_unlike_bits
            if one != two:
                fits &= block[rows, None] != block
            i, j = np.nonzero(fits)
            ahead = i + at < j
            left.append((i[ahead] + at).astype(np.int32))
            right.append(j[ahead].astype(np.int32))
        i, j = np.concatenate(left), np.concatenate(right)
        return self._first_here(leaf, i, j)

    def _first_here(self, leaf: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        earlier = [frozenset(x for x in leaves if x < leaf) for leaves in self.cols["leaves"]]
        if len(i) <= 4 * len(self):
            keep = np.fromiter((earlier[a].isdisjoint(earlier[b]) for a, b in zip(i.tolist(), j.tolist())), dtype=bool, count=len(i))
            return i[keep], j[keep]
        seen: dict[int, int] = {}
        for leaves in earlier:
            for x in leaves:
                seen[x] = seen.get(x, 0) + 1
        column = {x: k for k, x in enumerate(x for x, n in seen.items() if n > 1)}
        shared = np.zeros((len(self), len(self)), dtype=np.float32)
        for at in range(0, len(column), 4096):
            part = np.zeros((len(self), min(4096, len(column) - at)), dtype=np.float32)
            for row, leaves in enumerate(earlier):
                for x in leaves:
                    if at <= column.get(x, -1) < at + 4096:
                        part[row, column[x] - at] = 1
            shared += part @ part.T
        keep = shared[i, j] == 0
        return i[keep], j[keep]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Rows arrive sorted by ``(leaf, one, two)``; each run of equal keys is a group."""
    key, cols = None, None
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024).to_pydict()
            keys = list(zip(batch["leaf"], batch["one"], batch["two"]))
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if keys[start] != key:
                    if cols is not None and len(cols["leaf"]) > 1:
                        yield Group(key, cols)
                    key, cols = keys[start], {name: [] for name in batch}
                for name, values in batch.items():
                    cols[name] += values[start:end]
                start = end
    if cols is not None and len(cols["leaf"]) > 1:
        yield Group(key, cols)


def _flag(config: JoinConfig):
    schema = pa.schema([("leaf", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("block", pa.int32()), ("cls", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            i, j = g.candidates(config)
            if len(i):
                rows = np.union1d(i, j)
                leaf, one, two = g.key
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([leaf] * n, pa.int64()), pa.array([one] * n, pa.int32()), pa.array([two] * n, pa.int32()), pa.array([g.cols["block"][k] for k in rows], pa.int32()), pa.array([g.cols["cls"][k] for k in rows], pa.binary())], schema=schema)

    return run


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``i`` and ``j``. Few pairs are merged one by one; many
    go through products of incidence matrices over the shingles that at least two sets have."""
    if len(i) <= 2 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())), dtype=np.int64, count=len(i))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    return both[i, j].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray, names: list[bytes]) -> list[bytes]:
    """For each member the smallest name of its component in this group. Members take the least place
    of their neighbours, and of whoever stands at that place, until nothing changes."""
    order = sorted(range(n), key=names.__getitem__)
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    a, b, least = place[i], place[j], np.arange(n, dtype=np.int32)
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        now = now[now]
        if (now == least).all():
            return [names[order[k]] for k in least[place]]
        least = now


def _verify(config: JoinConfig):
    schema = pa.schema([("cls", pa.binary()), ("root", pa.binary()), ("deg", pa.int64())])
    num, den = config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            seen: set[bytes] = set()
            sets, rows = [], []
            for k, (cls, text) in enumerate(zip(g.cols["cls"], g.cols["text"])):
                s = shingle_set(text, config.width)
                if cls not in seen and digest(s) == cls:  # a repeated id may bring other texts along
                    seen.add(cls)
                    sets.append(s)
                    rows.append(k)
            if len(rows) < 2:
                continue
            if len(rows) < len(g):
                g = Group(g.key, {name: [values[k] for k in rows] for name, values in g.cols.items()})
            i, j = g.candidates(config)
            if not len(i):
                continue
            common = common_counts(sets, i, j)
            link = common * (num + den) >= num * (g.size[i] + g.size[j])
            i, j = i[link], j[link]
            degree = np.bincount(i, minlength=len(g)) + np.bincount(j, minlength=len(g))
            root = _roots(len(g), i, j, g.cols["cls"])
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array([g.cols["cls"][k] for k in some], pa.binary()), pa.array([root[k] for k in some], pa.binary()), pa.array(degree[some], pa.int64())], schema=schema)

    return run


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of the graph of ``(cls, root)`` edges as ``(cls, comp)``, ``comp`` being the least
    name. Large-star and small-star steps alternate until the edges stay as they are; every other round
    is written to the shared folder."""

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        return both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(low, "a")
        return out.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a != b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.write(edges.toDF("a", "b").filter("a != b").distinct(), "edges-0")
    before, turn = None, 0
    while (state := mark(now)) != before:
        before, turn = state, turn + 1
        after = scratch.write(small(large(small(large(now)))), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        now = after
    return now.toDF("cls", "comp")


def _leaves(classes: DataFrame, config: JoinConfig, scratch: Scratch) -> DataFrame:
    """The leaves of all trees as ``(cls, leaf)``; leaves with one member are left out. Sizes of nodes are
    written before they are joined, so that both sides of such a join are plain shuffles, of which
    Spark splits the hot ones."""
    runs = config.runs
    roots = F.array(*[F.xxhash64(F.lit(config.seed), F.lit(r), F.substring("pay", 8 * r + 1, 8)) for r in range(runs)])
    nodes = classes.select("cls", F.explode(roots).alias("node"))
    sizes = scratch.write(nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    live = scratch.write(nodes.join(sizes, "node").select("cls", "node", "n"), "level-0")
    leaves = live.filter(F.col("n") <= config.small).select("cls", F.col("node").alias("leaf"))
    coords = F.substring("pay", 8 * runs + BITS // 8 + 1, 2 * COORDS).alias("coords")
    large = live.filter(F.col("n") > config.small)
    depth = 0
    while not large.isEmpty():
        depth += 1

        def kid(branch: int) -> Column:
            return F.pmod(F.xxhash64(F.lit(config.seed + branch), "node"), F.lit(COORDS)).cast("int")

        tokens = F.array(*[F.xxhash64("node", kid(b), F.substring(F.col("coords"), 2 * kid(b) + 1, F.lit(2))) for b in range(config.branches)])
        here = large.join(classes.select("cls", coords), "cls")
        kids = scratch.write(here.select("cls", "node", "n", F.explode(F.array_distinct(tokens)).alias("child")), f"kids-{depth}")
        counts = scratch.write(kids.groupBy("node", "child").agg(F.count("*").alias("k"), F.first("n").alias("n")), f"counts-{depth}")
        left = F.sum(F.col("k").cast("double") * F.col("k")) / (F.first("n").cast("double") * F.first("n"))
        split = counts.groupBy("node").agg(left.alias("left"))  # one row for each node of more than ``small`` sets
        done = F.col("left") > config.worth if depth < config.max_depth else F.lit(True)
        leaves = leaves.union(large.join(split.filter(done).select("node"), "node").select("cls", F.col("node").alias("leaf")))
        if depth >= config.max_depth:
            break
        going = counts.filter("k > 1").join(split.filter(~done).select("node"), "node", "left_semi").select("node", "child", "k")
        live = scratch.write(kids.join(going, ["node", "child"]).select("cls", F.col("child").alias("node"), F.col("k").alias("n")), f"level-{depth}")
        scratch.drop(f"kids-{depth}")
        leaves = leaves.union(live.filter(F.col("n") <= config.small).select("cls", F.col("node").alias("leaf")))
        large = live.filter(F.col("n") > config.small)
    return scratch.write(leaves.distinct(), "leaves")


def digest_of(text: Column, width: int) -> Column:
    """The digest that names the shingle set of a text, null if it has none."""

    @F.arrow_udf("binary")
    def named(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py(), width) for t in texts)
        return pa.array([digest(s) if len(s) else None for s in sets], pa.binary())

    return named(valid_text(text))


def _judge(docs: DataFrame, id_col: str, text_col: str, config: JoinConfig) -> tuple[DataFrame, DataFrame]:
    """The rows as ``(id, cls)`` and what is known of each shingle set: ``(cls, rep, n_copies, n_links,
    class_id, comp)``; ``rep`` is the smallest id of its rows, ``comp`` the name of its class."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), valid_text(F.col(text_col)).alias("text"))
    rows = scratch.write(slim.mapInArrow(tidy(_embed(config)), "id long, cls binary, size int, pay binary"), "rows")
    classes = scratch.write(rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.max("size").alias("size"), F.max("pay").alias("pay")), "classes")
    leaves = _leaves(classes, config, scratch)

    lists = leaves.groupBy("cls").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    facts = classes.select("cls", "rep", "size", F.substring("pay", 8 * config.runs + 1, BITS // 8).alias("bits"))
    facts = scratch.write(lists.join(facts, "cls"), "members")
    cut = leaves.join(facts.select("cls", "size"), "cls").groupBy("leaf").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    pieces = F.greatest(F.ceil(F.col("n") / config.block_sets), F.ceil(F.col("total") / config.block_shingles)).cast("int")
    blocks = scratch.write(cut.select("leaf", pieces.alias("cut")).filter("cut > 1"), "blocks")  # few: each holds a block at least
    own = leaves.join(blocks, "leaf", "left").withColumn("pieces", F.coalesce("cut", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("cls", "leaf"), F.col("pieces")).cast("int"))
    spread = own.select("cls", "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    units = spread.select("cls", "leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block")
    key = ["leaf", "one", "two"]
    sketched = units.join(facts.select("cls", "size", "bits", "leaves"), "cls").repartition(*key).sortWithinPartitions(*key)
    flagged = scratch.write(sketched.mapInArrow(tidy(_flag(config)), "leaf long, one int, two int, block int, cls binary"), "flagged")

    wanted = facts.join(flagged.select("cls").distinct(), "cls", "left_semi")
    near = maybe_in(wanted.filter("rep is not null").select(F.col("rep").alias("id")), F.col("id"), config.filter_bits)
    texts = slim.filter(F.col("id").isNotNull() & near).join(wanted.select("cls", F.col("rep").alias("id"), "size", "bits", "leaves"), "id").drop("id")
    nameless = wanted.filter("rep is null").drop("rep")
    if not nameless.isEmpty():  # sets of rows without an id are found by their digest
        lone = slim.filter("id is null").select(digest_of(F.col("text"), config.width).alias("cls"), "text").filter("cls is not null").dropDuplicates(["cls"])
        texts = texts.unionByName(scratch.write(lone.join(nameless, "cls"), "nameless"))
    exact = flagged.join(texts, "cls").repartition(*key).sortWithinPartitions(*key)
    links = scratch.write(exact.mapInArrow(tidy(_verify(config)), "cls binary, root binary, deg long"), "links")

    components = connected(links.select("cls", "root"), scratch)
    named = components.join(classes.select("cls", "rep"), "cls")
    ends = components.select("comp").distinct().join(classes.select(F.col("cls").alias("comp"), "rep"), "comp")
    least = named.select("comp", "rep").union(ends).groupBy("comp").agg(F.min("rep").alias("low"))
    member = components.union(components.select("comp", "comp").distinct().toDF("cls", "comp")).join(least, "comp").select("cls", "comp", "low")
    degree = links.groupBy("cls").agg(F.sum("deg").alias("n_links"))
    known = classes.select("cls", "rep", "n_copies").join(degree, "cls", "left").join(member, "cls", "left")
    known = known.select("cls", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("low", "rep").alias("class_id"), F.coalesce("comp", "cls").alias("comp"))
    # Written, so that a join of the rows with it is one of plain shuffles: Spark splits the text that has the most copies.
    return rows.select("id", "cls"), scratch.write(known, "known")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: JoinConfig = JoinConfig()) -> DataFrame:
    """One row per input row: the id, ``class_id``, ``n_links`` (different shingle sets linked to this
    row's set) and ``n_copies`` (rows with the same set, this one included)."""
    rows, known = _judge(docs, id_col, text_col, config)
    out = rows.join(known, "cls", "left")
    alone = F.col("cls").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: JoinConfig = JoinConfig()) -> DataFrame:
    """One document of each class, a row with its smallest id, with the input's own columns. A row goes
    only if its own class has another survivor, whatever other rows have its id. Rows with a null id
    and texts without a word all stay. Only rows that may have to go are shuffled."""
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    rows, known = _judge(docs, id_col, text_col, config)
    first = known.filter("rep is not null").groupBy("comp").agg(F.min(F.struct("rep", "cls")).alias("first"))
    chosen = first.select(F.col("first.cls").alias("cls"), F.col("first.rep").alias("rep"))
    judged = rows.filter("id is not null").join(chosen, "cls", "left")
    stays = F.col("cls").isNull() | F.coalesce(F.col("id") == F.col("rep"), F.lit(False))
    texts = scratch.write(judged.groupBy("id", "cls").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("times")), "texts")
    ids = scratch.write(texts.groupBy("id").agg(F.bool_or("stays").alias("some"), F.sum("times").alias("times")), "ids")
    name, mark, lost_mark = free_name(docs, "__gone"), free_name(docs, "__cls"), free_name(docs, "__lost")
    gone = ids.filter("not some").select("id")
    doubtful = F.col(id_col).isNotNull() & maybe_in(gone, F.col(id_col), config.filter_bits)
    kept = docs.filter(doubtful).join(gone.withColumnRenamed("id", name), F.col(id_col) == F.col(name), "left_anti").unionByName(docs.filter(~doubtful))
    mixed = ids.filter("some and times > 1").select("id")
    if not mixed.isEmpty():  # repeated ids: which of their rows go is told by the texts
        unsure = F.col(id_col).isNotNull() & maybe_in(mixed, F.col(id_col), config.filter_bits)
        named = scratch.write(kept.filter(unsure).withColumn(mark, digest_of(F.col(text_col), config.width)), "named")
        lost = texts.filter("not stays").select(F.col("id").alias(name), F.col("cls").alias(lost_mark))
        held = named.join(lost, (F.col(id_col) == F.col(name)) & (F.col(mark) == F.col(lost_mark)), "left_anti")
        one = held.filter(F.col(mark).isNotNull()).dropDuplicates([id_col, mark])
        kept = kept.filter(~unsure).unionByName(one.unionByName(held.filter(F.col(mark).isNull())).drop(mark))
    return kept
