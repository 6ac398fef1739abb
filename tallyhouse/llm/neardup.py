"""Near-duplicate documents with SetSketch registers.

A document's set is its distinct word shingles.  A sketch has ``REGISTERS``
registers; register i holds the exponentially spaced, truncated minimum
``clamp(floor(1 - log_b(min_i)), 0, Q + 1)`` of exponential variates of the set's
elements, so sketches of unions are the maxima of registers.  Equal registers
become likelier with the similarity, hence bands of registers give candidates.
A candidate pair's similarity is estimated from the counts of greater, smaller
and equal registers by maximum likelihood (the set sizes are known); pairs that
can't reach the threshold by a likelihood ratio of e^18 go, all others are
verified on their full shingle sets.

Equal sets are one class from the start, whatever their number.  Inside a bucket
of a band up to ``SMALL`` classes are paired; of a larger one each class is
compared with its two most central members only.  Where a bucket then still holds
several components, the members outside the largest one are compared with ``LEADERS``
of its members, and what is left is compared across components, block against block;
two blocks of the largest component never meet.  So nothing is lost, and a task gets two
blocks of about ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles each, whichever are fewer.
Bands are as wide as the threshold allows: a pair just at it shares no bucket with
probability 1e-6 at most (8e-7 at 0.85).

Defined results: a text without words (or null) has an empty set, is linked with
nothing and kept; fewer words than ``WIDTH`` are one shingle; a null doc_id is
linked with nothing and kept; repeated rows are of one class and judged alike;
an empty table gives no rows; other columns pass ``drop_near`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import wordhash
from tallyhouse.llm.common import discard, small, stored

WIDTH, PERCENT = 5, 85
REGISTERS, BASE, RATE, Q = 120, 1.02, 20.0, (1 << 16) - 2
SMALL, LEADERS, BLOCK, BLOCK_SHINGLES = 12, 4, 128, 1 << 16
#: Texts whose words are hashed at once.
SLICE = 256
#: Cells of a task's matrix of sets and shared shingles that are held at once.
CELLS = 1 << 22
_random = np.random.Generator(np.random.PCG64(85))
_MASKS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_FACTORS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers_of(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16) of non-empty sets of 64-bit elements that follow one another."""
    lowest = np.empty((len(sizes), REGISTERS), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for first, last in _blocks(sizes, 1 << 16):
        part = elements[starts[first] : starts[last - 1] + sizes[last - 1]]
        own = starts[first:last] - starts[first]
        for i in range(REGISTERS):
            lowest[first:last, i] = np.minimum.reduceat((part ^ _MASKS[i]) * _FACTORS[i], own)
    minima = -np.log1p(-(lowest + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(minima) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of sets with about ``most`` elements together, so that they stay in the cache."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _set_ids(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bytes that stand for each non-empty set: two sums of differently mixed elements, mixed with the size."""
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = np.empty((len(sizes), 2), np.uint64)
    for k, salt in enumerate((np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))):
        sums = np.add.reduceat(wordhash.mix(elements ^ salt), starts) if len(sizes) else np.zeros(0, np.uint64)
        out[:, k] = wordhash.mix(sums + sizes.astype(np.uint64) * salt)
    return out


def _rows(matrix: np.ndarray, present: np.ndarray) -> pa.Array:
    """A binary array with the rows of ``matrix`` where ``present``, else nulls."""
    values = iter(matrix[i].tobytes() for i in range(len(matrix)))
    return pa.array([next(values) if p else None for p in present], pa.binary())


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: hashes of words take several times the room of the texts."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set (16 bytes), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches):
            elements, sizes = wordhash.shingles(*wordhash.words(part.column(1)), width)
            there = sizes > 0
            yield pa.record_batch(
                [part.column(0), pa.array(sizes, pa.int64()), _rows(_set_ids(elements, sizes[there]), there), _rows(registers_of(elements, sizes[there]), there)],
                ["doc_id", "n_shingles", "set", "registers"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, set binary, registers binary")


def could_reach(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, percent: int, ratio: float = 18.0) -> tuple[np.ndarray, np.ndarray]:
    """(maximum-likelihood similarity, whether the threshold is still possible) of pairs of sketches."""
    above, below = (first > second).sum(1), (first < second).sum(1)
    total = n_first + n_second
    u, v = n_first / total, n_second / total
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        greater, smaller = p(u - v * j), p(v - u * j)
        same = 1 - greater - smaller
        return above * np.log(np.maximum(greater, 1e-12)) + below * np.log(np.maximum(smaller, 1e-12)) + (REGISTERS - above - below) * np.log(np.maximum(same, 1e-12))

    shares = np.linspace(0, 1, 101)
    values = np.stack([likelihood(most * s) for s in shares])
    best = values.argmax(0)
    needed = percent / 100
    beyond = np.stack([likelihood(needed + (most - needed) * s) for s in np.linspace(0, 1, 26)]).max(0)
    return most * shares[best], (most >= needed - 1e-9) & (values.max(0) - beyond <= ratio)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for ordered distinct elements."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def band_of(percent: int) -> int:
    """Registers in a band: the most for which all bands differ with probability 1e-6 at most at the threshold."""
    widths = [w for w in range(1, 25) if REGISTERS % w == 0]
    return max((w for w in widths if (1 - (percent / 100) ** w) ** (REGISTERS // w) <= 1e-6), default=1)


def _registers(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint16) for x in column.to_pylist()])


def held_texts(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """set, text: one text for each of the sets in ``wanted`` (set, doc_id; stored)."""
    texts = docs.select("doc_id", "text").join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            elements, sizes = wordhash.shingles(*wordhash.words(batch.column(0)), width)
            there = sizes > 0
            yield pa.record_batch([_rows(_set_ids(elements, sizes[there]), there), batch.column(0)], ["set", "text"])

    held = texts.select("text").mapInArrow(with_sets, "set binary, text string").join(small(wanted.select("set")), "set", "left_semi").dropDuplicates(["set"])
    return stored(held, "near-texts")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Of the pairs (a, b) of sets those that are similar."""
    own = {x: classes.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "ab"}
    known = pairs.join(own["a"], "a").join(own["b"], "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (np.asarray(batch.column(i)).astype(float) for i in (2, 4))
                _, keep = could_reach(_registers(batch.column(3)), _registers(batch.column(5)), n_a, n_b, percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    possible = stored(known.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(estimate, "a binary, b binary"), "near-possible")
    wanted = stored(possible.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(classes.select("set", "doc_id"), "set"), "near-wanted")
    held = held_texts(wanted, docs, width)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            (a, n_a), (b, n_b) = (wordhash.shingles(*wordhash.words(batch.column(i)), width) for i in (2, 3))
            a, b = (np.split(x, np.cumsum(n)[:-1]) for x, n in ((a, n_a), (b, n_b)))
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_()))

    both = possible.join(held.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")
    links = stored(both.select("a", "b", "x", "y").mapInArrow(confirm, "a binary, b binary"), "near-links")
    discard(possible, wanted, held)
    return links


def components(links: DataFrame) -> DataFrame:
    """set, component (its least member) of the sets in ``links`` (a, b).

    Each round every vertex hooks onto its least neighbour and edges move to the new parents.
    """
    edges = stored(links.select("a", "b").distinct(), "near-edges")
    mapping = stored(edges.select(F.explode(F.array("a", "b")).alias("set")).distinct().withColumn("component", F.col("set")), "near-mapping")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "near-parents")
        moved = edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        before = edges, mapping, parent
        edges = stored(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "near-edges")
        mapping = stored(mapping.join(parent, mapping["component"] == parent["v"], "left").select("set", F.coalesce("p", "component").alias("component")), "near-mapping")
        discard(*before)
    discard(edges)
    return mapping


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _first_pairs(shared: DataFrame) -> DataFrame:
    """All pairs in small buckets; in larger ones each member with the two most central."""
    left = shared.where(F.col("size") <= SMALL).select("bucket", "set")
    pairs = left.join(left.withColumnRenamed("set", "other"), "bucket").where("set < other").select(F.col("set").alias("a"), F.col("other").alias("b"))
    central = shared.groupBy("set").agg(F.sum("size").alias("central"))
    large = shared.where(F.col("size") > SMALL).join(central, "set").select("bucket", "set", "central")
    leaders = large.groupBy("bucket", F.pmod(F.xxhash64("set"), F.lit(2)).alias("slot")).agg(F.max(F.struct("central", "set")).alias("lead"))
    leaders = stored(leaders.select("bucket", F.col("lead.set").alias("leader")), "near-leaders")
    stars = large.join(small(leaders), "bucket").where("set <> leader").select(*_ordered("set", "leader"))
    return pairs.unionByName(stars).distinct()


def linked(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(links between sets: a, b; components: set, component)."""
    classes = sketches.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("registers").alias("registers"))
    classes = stored(classes, "near-classes")
    least = max(1, -(-percent // (100 - percent))) if percent < 100 else None  # smaller sets are similar only if equal
    band = band_of(percent)
    keys = F.array(*[F.xxhash64(F.substring("registers", 2 * band * i + 1, 2 * band), F.lit(i)) for i in range(REGISTERS // band)])
    banded = classes.where(F.col("n") >= (least or 1 << 62)).select(F.explode(keys).alias("bucket"), "set")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(banded.join(sizes, "bucket"), "near-shared")
    links = verified(_first_pairs(shared), classes, docs, percent, width)
    label = components(links)
    large = shared.where(F.col("size") > SMALL).select("bucket", "set")
    for more in (_led_pairs, None):
        members = _split(large, label)
        if members.isEmpty():
            break
        found = verified(more(members), classes, docs, percent, width) if more else across(members, classes, docs, percent, width)
        if not found.isEmpty():
            old = links, label, found
            links = stored(links.unionByName(found), "near-all-links")
            label = components(links)
            discard(*old)
        discard(members)
    discard(classes, shared)
    return links, label


def _split(large: DataFrame, label: DataFrame) -> DataFrame:
    """bucket, set, component, bulk (in the bucket's largest component) of buckets with several components, stored."""
    members = stored(large.join(label, "set", "left").select("bucket", "set", F.coalesce("component", "set").alias("component")), "near-members")
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("many")).where("many > 1").select("bucket", F.col("most.component").alias("largest"))
    split = stored(members.join(small(stored(most, "near-largest")), "bucket").select("bucket", "set", "component", (F.col("component") == F.col("largest")).alias("bulk")), "near-split")
    discard(members)
    return split


def _led_pairs(members: DataFrame) -> DataFrame:
    """Members outside a bucket's largest component with some of those inside."""
    slot = F.pmod(F.xxhash64("set", F.lit("slot")), F.lit(LEADERS))
    leaders = members.where("bulk").groupBy("bucket", slot.alias("slot")).agg(F.max_by("set", F.xxhash64("set", "bucket")).alias("leader"))
    leaders = stored(leaders.select("bucket", "leader"), "near-more-leaders")
    return members.where("not bulk").join(small(leaders), "bucket").select(*_ordered("set", "leader")).distinct()


def _units(members: DataFrame) -> DataFrame:
    """unit, set, component, bulk: where the pairs of members are sought.

    Buckets that share members form a cluster, in which each pair is met once; but where that
    makes more pairs than the buckets by themselves have, the buckets are units.
    """
    first = members.groupBy("bucket").agg(F.min("set").alias("least"), F.count("*").alias("n"))
    first = stored(first, "near-buckets")
    edges = members.select("bucket", "set").join(small(first), "bucket").where("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b")).distinct()
    cluster = components(edges).select("set", F.col("component").alias("cluster"))
    sizes = cluster.groupBy("cluster").agg(F.count("*").cast("double").alias("sets"))
    inside = first.join(cluster, first["least"] == cluster["set"]).groupBy("cluster").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    whole = sizes.join(inside, "cluster").select("cluster", (F.col("sets") * F.col("sets") <= F.col("pairs")).alias("whole"))
    placed = members.join(cluster, "set").join(small(stored(whole, "near-whole")), "cluster")
    placed = stored(placed.select(F.when(F.col("whole"), F.hex("cluster")).otherwise(F.col("bucket").cast("string")).alias("unit"), "set", "component").distinct(), "near-units")
    counts = placed.groupBy("unit", "component").agg(F.count("*").alias("n")).groupBy("unit").agg(F.max(F.struct("n", "component")).alias("most"))
    return placed.join(small(stored(counts, "near-bulk")), "unit").select("unit", "set", "component", (F.col("component") == F.col("most.component")).alias("bulk"))


def across(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between members (bucket, set, component) of one bucket that are of different components.

    A unit's largest component and its other sets are dealt into blocks apart; each task
    compares two blocks, of which one at least holds other sets.
    """
    own = stored(_units(members).join(classes.select("set", "doc_id", "n"), "set"), "near-placed")
    share = F.greatest(F.lit(1.0) / BLOCK, F.col("n") / BLOCK_SHINGLES)
    blocks = own.groupBy("unit").agg(*[F.ceil(F.coalesce(F.sum(F.when(F.col("bulk") == b, share)), F.lit(0.0))).cast("int").alias(name) for b, name in ((True, "bulks"), (False, "others"))])
    texts = held_texts(own.select("set", "doc_id").distinct(), docs, width)
    h = F.xxhash64("set")
    block = F.when(F.col("bulk"), F.pmod(h, F.col("bulks"))).otherwise(F.col("bulks") + F.pmod(h, F.col("others"))).cast("int")
    others = F.sequence(F.col("bulks"), F.col("bulks") + F.col("others") - 1)
    every = F.when(F.col("bulk"), others).otherwise(F.sequence(F.lit(0), F.col("bulks") + F.col("others") - 1))
    dealt = own.join(small(stored(blocks, "near-blocks")), "unit").withColumn("block", block).withColumn("other", F.explode(every)).join(texts, "set")
    dealt = dealt.select("unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "component", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets, own = table.column("set").to_pylist(), np.unique(np.array([x.hex() for x in table.column("component").to_pylist()]), return_inverse=True)[1]
        elements, sizes = wordhash.shingles(*wordhash.words(table.column("text").chunk(0)), width)
        found = [(sets[x], sets[y]) for x, y in pairs_across(elements, sizes, own, percent)]
        return pa.table({"a": pa.array([min(p) for p in found], pa.binary()), "b": pa.array([max(p) for p in found], pa.binary())})

    found = stored(dealt.groupBy("unit", "i", "j").applyInArrow(compare, "a binary, b binary"), "near-across")
    discard(own, texts)
    return found


def pairs_across(elements: np.ndarray, sizes: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (positions) of similar sets of different components, as far as they join components that weren't joined yet."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, place, times = np.unique(elements, return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[place[shared[place]]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared[place]][order]
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    at_once = max(1, CELLS // max(1, len(sizes)))
    for first in range(0, int(shared.sum()), at_once):
        begin, end = np.searchsorted(column, (first, first + at_once))
        matrix = np.zeros((len(sizes), at_once), np.float32)
        matrix[owner[begin:end], column[begin:end] - first] = 1
        common += matrix @ matrix.T
    common = common.astype(np.int64)
    both = sizes[:, None] + sizes[None, :]
    x, y = np.nonzero(np.triu((100 * common >= percent * (both - common)) & (component[:, None] != component[None, :]), 1))
    parent = list(range(int(component.max()) + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = root(component[i]), root(component[j])
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set, component_id, kept."""
    sketches = stored(sketch(docs, width), "near-sketches")
    _, label = linked(docs, sketches, percent, width)
    ours = sketches.select("doc_id", "n_shingles", "set")
    grouped = ours.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    grouped = stored(grouped.join(label, "set", "left").select("set", F.coalesce("component", "set").alias("component"), "least"), "near-grouped")
    first = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = stored(grouped.join(first, "component").where("least <> component_id or set <> component").select("set", "component_id"), "near-ids")
    ids = grouped.select("set", "least").join(ids, "set", "left").select("set", F.coalesce("component_id", "least").alias("component_id"))
    found = ours.join(ids, "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", "set", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller doc_id."""
    gone = stored(near_duplicates(docs, percent, width).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
