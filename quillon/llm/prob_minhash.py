"""Near-duplicates by ProbMinHash: sketches of weighted shingles, banding, exact verification, classes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.tables import small_batches, with_python, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Registers of a sketch, and how many make a band. A pair of similarity 0.8 shares no band of 32 once in 2e7.
REGISTERS = 128
BAND_ROWS = 4
BANDS = REGISTERS // BAND_ROWS
#: Central nodes that every node is compared with first.
HEADS = 3
#: Nodes on a side of a cell, the part of a bucket whose pairs are made under one key.
CELL = 1000
#: Shingles on a side of a cell whose links are made under one key, 8 MB, and how many a node counts for besides its own.
CELL_SHINGLES = 1 << 20
NODE_SHINGLES = 128
#: Bits of a node's signature for each of its shingles at least, and at least in all; see ``parity``.
BITS_A_SHINGLE = 4
LEAST_BITS = 512
#: Nodes of a bucket whose pairs are made before they are tested; of larger buckets only links are made.
SMALL_BUCKET = 32
#: What rounding may add to a bound.
SLACK = 1e-9
#: Candidate ids up to this number (16 bytes each) may be broadcast; beyond, ids and texts are shuffled.
BROADCAST_IDS = 1_000_000

WORD = re.compile(r"\w+")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[str]:
    """Lower-case words: runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


def weighted_shingles(words: list[str], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the shingles and how often each occurs. Fewer words than ``size`` are one shingle."""
    if not words:
        return np.empty(0, _U), np.empty(0, np.int64)
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), _U, len(words))
    shingles = np.full(n, min(size, len(words)), _U)
    for i in range(min(size, len(words))):
        shingles = mix(shingles * _U(0x9E3779B97F4A7C15) + hashes[i:i + n])
    return np.unique(shingles, return_counts=True)


def sketch(shingles: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The ProbMinHash sketch: for each register the shingle that arrives there first.

    Every shingle sends arrivals by a Poisson process with its weight as the rate; its hash fixes the gaps and the
    register of each arrival. Two texts agree in a register with the probability of their probability Jaccard
    similarity. Arrivals come in blocks; a shingle whose last arrival is later than the slowest register's first
    can't win any more and stops, and the sketch is done when all have stopped.
    """
    best = np.full(registers, np.inf)
    winner = np.zeros(registers, _U)
    live, rate = shingles, weights.astype(float)
    clock, step = np.zeros(len(live)), 0
    while len(live):
        # few shingles need many arrivals to reach every register, many need one or two each
        block = max(1, min(512, int(registers * 8 / len(live))))
        number = np.arange(step, step + block, dtype=_U)
        draw = mix(live[:, None] + (number * _U(2) + _U(1)) * _U(0x9E3779B97F4A7C15))
        gap = -np.log(((draw >> _U(11)).astype(float) + 0.5) / 2.0 ** 53) / rate[:, None]
        at = clock[:, None] + np.cumsum(gap, axis=1)
        register = ((mix(draw ^ _U(0xD6E8FEB86659FD93)) >> _U(33)) % _U(registers)).astype(np.int64)
        early = at < best.max()
        times, slots, owner = at[early], register[early], np.repeat(live, block)[early.ravel()]
        first = np.full(registers, np.inf)
        np.minimum.at(first, slots, times)
        won = np.flatnonzero(times == first[slots])[::-1]  # of equal times the smallest shingle counts
        name = np.zeros(registers, _U)
        name[slots[won]] = owner[won]
        better = (first < best) | ((first == best) & (name < winner))
        best[better], winner[better] = first[better], name[better]
        clock, step = at[:, -1], step + block
        going = clock < best.max()
        live, rate, clock = live[going], rate[going], clock[going]
    return winner


def bands_of(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit hash for each band of ``rows`` registers; the band's number is part of it."""
    parts = signature.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=_U)
    for i in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, i])
    return out.astype(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two sets of (sorted hashes, counts); 0 if either is empty.

    For a common shingle i it adds 1 / sum over j of max(x_j / x_i, y_j / y_i); sorted by x/y, the sum is one prefix of y
    and one suffix of x. With equal counts it is the plain Jaccard similarity.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        order = np.argsort(np.where(y > 0, x / np.maximum(y, 1e-300), np.inf), kind="stable")
    x, y = x[order], y[order]
    before_y = np.concatenate(([0.0], np.cumsum(y)[:-1]))
    after_x = np.cumsum(x[::-1])[::-1]
    both = (x > 0) & (y > 0)
    return float((1.0 / (after_x[both] / x[both] + before_y[both] / y[both])).sum())


def parity(shingles: np.ndarray) -> bytes:
    """Bits, a power of two, that say whether an odd number of shingles falls on each. Bits in which two sets differ are never
    more than the shingles that only one of them has."""
    bits = max(LEAST_BITS, 1 << (BITS_A_SHINGLE * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(signatures: np.ndarray, width: int) -> np.ndarray:
    """Signatures, a row of 64-bit numbers each, with half the bits, and so on: what they would be with fewer bits."""
    while signatures.shape[1] > width:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def _may_reach(only: np.ndarray, rest: np.ndarray, only_other: np.ndarray, rest_other: np.ndarray, threshold: float) -> np.ndarray:
    """If two nodes may reach the threshold, by the weights of the shingles that one has alone and of its others at most.

    Let u be the weight share of a node's shingles that the other one lacks, and v that of the other's. Their
    probability Jaccard similarity is at most 1 / (1 + u / (1 - u) + v / (1 - v)), and just that if all shingles weigh one.
    """
    return only * rest_other + only_other * rest <= (1 / threshold - 1 + SLACK) * rest * rest_other


class Facts:
    """What is known of some nodes without their shingles: how many they are, their weight, and the signatures."""

    def __init__(self, sizes: list[int], masses: list[int], signatures: list[bytes]) -> None:
        self.sizes, self.masses = np.array(sizes, float), np.array(masses, float)
        self.widths = np.array([len(s) // 8 for s in signatures], np.int64)
        self.rows = {int(w): np.flatnonzero(self.widths == w) for w in np.unique(self.widths)}
        self.signatures = {w: np.frombuffer(b"".join(signatures[i] for i in rows), _U).reshape(len(rows), w) for w, rows in self.rows.items()}
        self._shorter: dict[tuple[int, int], np.ndarray] = {}

    def _at_most(self, width: int, most: int) -> np.ndarray:
        if (width, most) not in self._shorter:
            self._shorter[width, most] = _folded(self.signatures[width], most)
        return self._shorter[width, most]

    def may_link(self, size: float, mass: float, signature: bytes, threshold: float = THRESHOLD) -> np.ndarray:
        """Which of the nodes may reach the threshold with one that has these facts; never false for a link.

        At least as many shingles as there are different bits are in one set only, the difference of the sizes says how many in
        which, and each weighs one or more; see ``_may_reach``.
        """
        one = np.frombuffer(signature, _U)[None, :]
        apart = np.empty(len(self.sizes))
        for width, rows in self.rows.items():
            least = min(width, one.shape[1])
            apart[rows] = np.bitwise_count(self._at_most(width, least) ^ _folded(one, least)).sum(axis=1)
        more = size - self.sizes
        apart = np.maximum(apart, np.abs(more))
        only, only_other = (apart + more) / 2, (apart - more) / 2
        return _may_reach(only, mass - only, only_other, self.masses - only_other, threshold)


def node_of(doc_id: int | None, text: str | None, words: list[str]) -> bytes:
    """17 bytes that stand for a row's words; without words for its whole text, and null for its own id."""
    if words:
        return b"w" + hashlib.sha256(" ".join(words).encode()).digest()[:16]
    return b"e" + hashlib.sha256((f"null {doc_id}" if text is None else f"text {text}").encode()).digest()[:16]


def sketches(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_key, node, bands`` of every row; no bands without words."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))

    def run(ids: list[int | None], texts: list[str | None]) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts):
            words = words_of(text)
            bands = bands_of(sketch(*weighted_shingles(words, size))).tolist() if words else None
            yield node_of(doc_id, text, words), bands

    return with_python(docs, ["doc_id", "text"], {"node": ("binary", pa.binary()),
                                                  "bands": ("array<long>", pa.list_(pa.int64()))}, run,
                       ["doc_id", "text_key"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``node, hashes, counts, size, mass, signature`` of the wanted nodes (``doc_id, node``, one row per node), read from their
    texts: the shingles, how often they occur (null where all are one, as in most texts), how many they are without and with
    repetitions, and their ``parity``."""
    ids = wanted.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    if wanted.count() <= BROADCAST_IDS:  # 25 bytes each
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("_node", "text")

    def run(nodes: list[bytes], found: list[str | None]) -> Iterator[tuple]:
        for node, text in zip(nodes, found):
            words = words_of(text)
            if node_of(None, text, words) == node:  # a repeated id may have other texts
                hashes, counts = weighted_shingles(words, size)
                yield (hashes.astype(np.int64), counts.astype(np.int32) if counts.max() > 1 else None, len(hashes), int(counts.sum()),
                       parity(hashes))
            else:
                yield None, None, None, None, None

    sets = with_python(texts, ["_node", "text"], {"hashes": ("array<long>", pa.list_(pa.int64())),
                                                  "counts": ("array<int>", pa.list_(pa.int32())), "size": ("long", pa.int64()),
                                                  "mass": ("long", pa.int64()), "signature": ("binary", pa.binary())},
                       run, ["_node"])
    sets = sets.where("hashes is not null").withColumnRenamed("_node", "node")
    return written(sets.dropDuplicates(["node"]), "shingles")


def _set(hashes: pa.ListScalar, counts: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    keys = np.asarray(hashes.values).view(_U)
    return keys, np.asarray(counts.values) if counts.is_valid else np.ones(len(keys), np.int32)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b`` of the pairs whose exact similarity is ``threshold`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (list(zip(batch.column(h), batch.column(c))) for h, c in (("ha", "ca"), ("hb", "cb")))
            alike = [probability_jaccard(_set(*x), _set(*y)) >= threshold for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    ends = pairs.select("a").union(pairs.select("b")).distinct()
    if 2 * pairs.count() <= BROADCAST_IDS:  # 17 bytes each: sets that no pair needs are not shuffled
        left = left.join(F.broadcast(ends), "a", "left_semi")
        right = right.join(F.broadcast(ends.withColumnRenamed("a", "b")), "b", "left_semi")
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def facts(sets: DataFrame, node: str, name: str) -> DataFrame:
    return sets.select(F.col("node").alias(node), *[F.col(c).alias(f"{c}{name}") for c in ("size", "mass", "signature")])


def plausible(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs ``a, b`` that may reach the threshold, by the signatures, a tenth of the sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(f"{c}{side}").to_pylist() for side in ("_a", "_b") for c in ("size", "mass", "signature")])
            passed = [bool(Facts([n], [m], [g]).may_link(*one, threshold)[0]) for *one, n, m, g in rows]
            yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    both = pairs.join(facts(sets, "a", "_a"), "a").join(facts(sets, "b", "_b"), "b")
    return both.mapInArrow(run, "a binary, b binary")


def _cell_pairs(threshold: float):
    """The pairs of a cell that may link, made one left node at a time against all right ones."""
    def run(table: pa.Table) -> pa.Table:
        left, right = table.filter(table["left"]), table.filter(table["right"])
        found: tuple[list, list] = ([], [])
        if len(left) and len(right):
            known = Facts(*[right[c].to_pylist() for c in ("size", "mass", "signature")])
            names = sorted({name for side in (left, right) for c in ("node", "root") for name in side[c].to_pylist()})
            number = {name: i for i, name in enumerate(names)}
            nodes, roots = (np.array([number[name] for name in right[c].to_pylist()]) for c in ("node", "root"))
            inner = np.array(right["inner"].to_pylist())
            for node, root, *one in zip(*[left[c].to_pylist() for c in ("node", "root", "size", "mass", "signature")]):
                passed = known.may_link(*one, threshold) & (roots != number[root]) & (inner | (nodes > number[node]))
                others = nodes[passed].tolist()
                found[0].extend([node] * len(others))
                found[1].extend(names[i] for i in others)
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})

    return run


def _cell_links(threshold: float):
    """Links of a cell that join its classes as all its links would: no more than there are nodes.

    Each left node meets all right ones of other classes. The signatures rule most out, the weights of the common shingles nearly all
    others that are no links; the exact similarity decides. A link makes two classes one.
    """
    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_pylist()
        found: list[tuple[int, int]] = []
        is_left, is_right, inner = (np.array(table[c].to_pylist(), bool) for c in ("left", "right", "inner"))
        rights = np.flatnonzero(is_right)
        if is_left.any() and len(rights):
            hashes, counts = table["hashes"].combine_chunks(), table["counts"].combine_chunks()
            ends = np.cumsum(hashes.value_lengths().to_numpy())
            spans = [slice(start, end) for start, end in zip([0, *ends[:-1].tolist()], ends.tolist())]
            flat = hashes.flatten().to_numpy().view(_U)
            weights = np.ones(len(flat), np.int32)
            for i in np.flatnonzero(counts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                weights[spans[i]] = counts[i].values.to_numpy()
            different, keys = np.unique(flat, return_inverse=True)
            number = np.zeros(len(different))
            size, mass, signature = (table[c].to_pylist() for c in ("size", "mass", "signature"))
            known = Facts(*[[column[i] for i in rights] for column in (size, mass, signature)])
            masses = np.array(mass, float)
            order, root = (np.unique(np.array(table[c].to_pylist(), object), return_inverse=True)[1] for c in ("node", "root"))
            once = inner[rights], order[rights]
            for i in np.flatnonzero(is_left).tolist():
                passed = known.may_link(size[i], mass[i], signature[i], threshold) & (root[rights] != root[i])
                others = rights[passed & (once[0] | (once[1] > order[i]))]
                if not len(others):
                    continue
                number[keys[spans[i]]] = weights[spans[i]]
                theirs = [spans[j] for j in others.tolist()]
                first = np.cumsum([0, *(x.stop - x.start for x in theirs[:-1])])
                common = number[np.concatenate([keys[x] for x in theirs])]
                number[keys[spans[i]]] = 0
                rest = np.add.reduceat(common, first)
                rest_other = np.add.reduceat(np.concatenate([weights[x] for x in theirs]) * (common > 0), first)
                others = others[_may_reach(masses[i] - rest, rest, masses[others] - rest_other, rest_other, threshold)]
                while len(others):
                    j, others = int(others[0]), others[1:]
                    if probability_jaccard((flat[spans[i]], weights[spans[i]]), (flat[spans[j]], weights[spans[j]])) >= threshold:
                        found.append((i, j))
                        root[root == root[j]] = root[i]
                        others = others[root[others] != root[i]]
        return pa.table({c: pa.array([nodes[pair[k]] for pair in found], pa.binary()) for k, c in enumerate("ab")})

    return run


def mixed_buckets(members: DataFrame, labels: DataFrame, cell: int) -> DataFrame:
    """``band, node, root, main, n, columns, lines``: the members (``band, node, room``) of buckets of several classes, each with its
    class, the largest class of the bucket, the bucket's nodes, and how many cells of this room all its nodes and those outside the largest
    class take."""
    classed = members.select("band", "node", "room").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = classed.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("room").alias("room"))
    mixed = sizes.groupBy("band").agg(F.max_by("root", F.struct("room", "root")).alias("main"), F.sum("n").alias("n"), F.sum("room").alias("room"),
                                      F.max("room").alias("most"), F.count("*").alias("classes")).where("classes > 1")
    mixed = mixed.select("band", "main", "n", F.ceil(F.col("room") / cell).cast("int").alias("columns"),
                         F.ceil((F.col("room") - F.col("most")) / cell).cast("int").alias("lines"))
    return written(classed.drop("room").join(mixed, "band"), "mixed")


def cells(rows: DataFrame) -> DataFrame:
    """``band, line, column, node, root, inner, left, right``: rows of ``mixed_buckets`` in their cells. A node outside the largest class is
    a left one in its line, and every node a right one in its column, so that all pairs of them meet in a cell; ``inner`` tells the largest class."""
    own = F.xxhash64("node")
    placed = rows.withColumns({"own_line": F.pmod(own, "lines").cast("int"), "own_column": F.pmod(own, "columns").cast("int"),
                               "inner": F.col("root") == F.col("main")})
    left = placed.where("not inner").withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).select(
        "band", F.col("own_line").alias("line"), "column", "node", "root", "inner", F.lit(True).alias("left"),
        (F.col("column") == F.col("own_column")).alias("right"))
    right = placed.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("lines") - 1))).where("inner or line <> own_line").select(
        "band", "line", F.col("own_column").alias("column"), "node", "root", "inner", F.lit(False).alias("left"), F.lit(True).alias("right"))
    return left.union(right)


def cross_pairs(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, cell: int = CELL,
                small: int | None = SMALL_BUCKET) -> DataFrame:
    """``a, b``, once: the pairs of nodes of different classes that share a bucket and may reach the threshold.

    One end of such a pair is outside the largest class of the bucket, so only those nodes meet all others. Buckets of up
    to ``small`` nodes (None: all) make their pairs, which are then tested. A larger one is cut into cells of about ``cell`` nodes by
    ``cell`` nodes, each a key of its own, and makes the pairs alone that pass the test. These may still grow with the square of a family
    around the threshold; where links will do, ``cross_links`` makes no more than there are nodes.
    """
    rows = mixed_buckets(members.withColumn("room", F.lit(1)), labels, cell)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    little = rows if small is None else rows.where(F.col("n") <= small)
    left = little.where("root <> main").select("band", F.col("node").alias("a"), F.col("root").alias("ra"))
    right = little.select("band", F.col("node").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("inner"))
    few = left.join(right, "band").where("ra <> rb and (inner or a < b)").select(*pair).distinct()
    few = plausible(few, sets, threshold)
    if small is None:
        return few
    wide = cells(rows.where(F.col("n") > small)).join(facts(sets, "node", ""), "node")
    many = wide.groupBy("band", "line", "column").applyInArrow(_cell_pairs(threshold), "a binary, b binary")
    return few.union(many.select(*pair)).distinct()


def cross_links(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                cell: int = CELL_SHINGLES) -> DataFrame:
    """``a, b``: links between nodes of different classes that share a bucket. With the classes of ``labels`` they join the same nodes as all
    such links would, and a cell makes fewer of them than it has nodes, also in a large family around the threshold.

    A bucket is cut into cells of about ``cell`` shingles by ``cell`` shingles, each a key of its own, which hold the sets of their nodes.
    """
    room = sets.select("node", (F.col("size") + NODE_SHINGLES).alias("room"))
    rows = mixed_buckets(members.select("band", "node").join(room, "node"), labels, cell)
    full = cells(rows).join(sets.select("node", "hashes", "counts", "size", "mass", "signature"), "node")
    return full.groupBy("band", "line", "column").applyInArrow(_cell_links(threshold), "a binary, b binary")


def star_pairs(members: DataFrame, heads: int = HEADS) -> DataFrame:
    """``a, b``, once: every node with the ``heads`` most central nodes that it shares a bucket with, those whose buckets are the
    largest. So a group of any size makes a few pairs for each of its nodes, nearly all to the same ones."""
    # Spark keeps the first of each bucket in every task before it shuffles
    order = Window.partitionBy("band").orderBy(F.desc("weight"), "node")
    first = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= heads).select(
        "band", F.col("node").alias("head"), F.struct(F.col("weight"), F.col("node")).alias("rank"))
    met = members.select("band", "node").join(first, "band").where("node <> head")
    # a node has at most this number of heads in each of its bands
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("rank"), asc=False), 1, heads).alias("best"))
    pairs = best.select("node", F.explode("best.node").alias("head"))
    return pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, text_key, root, class_id`` of every row of ``docs``: its class and the smallest doc_id in it.

    Rows with the same words are one node. Nodes meet in buckets of equal bands; a link is a pair that shares a bucket
    and whose exact similarity is ``threshold`` or more. Classes are the components of the links. A large group of near copies
    has more links than can be looked at, and its class needs few of them: first every node is compared with the ``HEADS`` most
    central nodes that it shares a bucket with (``star_pairs``). Then all pairs that share a bucket,
    are in different classes and may reach the threshold by an exact bound are compared, those of small buckets as rows
    (``cross_pairs``), those of large ones where they meet (``cross_links``), so that no class misses a link.

    ``text_key`` tells rows of a repeated doc_id apart. Repeated rows get the same class. Texts without words are alike only if equal; a null text is alone. Null ids
    don't count for the smallest id: a class of null ids has a null class_id. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, threshold, size)


def _classes(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    drawn = written(sketches(docs, size), "sketches")
    nodes = written(drawn.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    placed = nodes.where("bands is not null").select("node", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(placed.join(shared, "band"), "buckets")
    weights = sized.groupBy("node").agg(F.sum("n").alias("weight"))
    members = written(sized.join(weights, "node").select("band", "node", "weight", "n"), "members")
    wanted = nodes.select("node", "doc_id").join(members.select("node"), "node", "left_semi")
    sets = shingle_sets(docs, written(wanted, "wanted"), size)
    tried = written(plausible(star_pairs(members), sets, threshold), "pairs")
    links = written(verified(tried, sets, threshold), "links")
    labels = components(links)
    little, wide = members.where(F.col("n") <= SMALL_BUCKET), members.where(F.col("n") > SMALL_BUCKET)
    rest = written(cross_pairs(little, sets, labels, threshold, small=None).join(tried, ["a", "b"], "left_anti"), "pairs")
    found = written(verified(rest, sets, threshold).union(cross_links(wide, sets, labels, threshold)), "links")
    if not found.isEmpty():
        labels = components(links.union(found))

    named = nodes.select("node", "doc_id").join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = named.select("node", "root").join(smallest, "root")
    return drawn.select("doc_id", "text_key", "node").join(known, "node").drop("node")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, class_id`` of every row of ``docs``: the smallest doc_id of all rows linked to it, directly or not."""
    return classes(docs, threshold, size).select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` less all but one of each class, with their columns: the one with the smallest doc_id (nulls
    last). Rows that repeat that one's id and text go too."""
    rows = written(classes(docs, threshold, size), "classes")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    more = rows.join(first, "root")
    gone = written(more.where(place != F.col("first")).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "copies")
    twice = more.where(place == F.col("first")).groupBy("doc_id", "text_key").count().where("count > 1")
    twice = written(twice.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "repeats")
    def same(other: str) -> Column:
        return F.col("d.doc_id").eqNullSafe(F.col(f"{other}._id")) & (
            F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col(f"{other}._key"))

    if gone.count() <= BROADCAST_IDS:  # 16 bytes each; beyond, the texts are shuffled
        gone = F.broadcast(gone)
    kept = docs.alias("d").join(gone.alias("g"), same("g"), "left_anti").alias("d")
    if not twice.limit(1).count():
        return kept
    one = kept.join(twice.alias("t"), same("t"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice.alias("t"), same("t"), "left_anti").union(one)
