"""Containers of fixed capacity filled with documents by a grouping genetic algorithm on islands.

An individual is a packing: whole containers are its genes. Crossover injects well-filled containers of one parent into
the other, removes the containers there that hold any of the same documents, and puts the displaced ones where they fit
best. The documents are dealt into blocks of bounded size, each block evolves on several islands, and between epochs
the elite of every island migrates to the next one and competes there.

A block ends with a container or two that are not full. Their documents go on to the next level, where those of many
blocks are dealt into new blocks, until one block holds what is left; so the room left over does not grow with the
number of blocks.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import cut, width

#: Documents of a block, on average: the bound on what one call of the algorithm sees.
BLOCK_ITEMS = 2048
ISLANDS, EPOCHS, POPULATION, GENERATIONS, OFFSPRING, ELITE = 2, 2, 6, 8, 3, 2
#: Specs that the driver reads; more are an error.
MAX_SPECS = 1000
#: A container filled to this per cent is final, a poorer one is opened again on the next level.
FULL_PERCENT = 99
MAX_LEVELS = 6


class Packing:
    """An individual: containers as lists of item numbers, and how full they are."""

    __slots__ = ("bins", "fill")

    def __init__(self, bins: list[list[int]], fill: list[int]):
        self.bins, self.fill = bins, fill

    def score(self, capacity: int) -> float:
        """Fewer containers first; of as many, those whose room is left in few containers."""
        return -len(self.bins) + sum((f / capacity) ** 2 for f in self.fill) / max(1, len(self.bins)) / 2


def best_fit(packing: Packing, items: Sequence[int], sizes: Sequence[int], capacity: int) -> None:
    """Put each item, in the order given, into the fullest container that has room, else into a new one."""
    bins, fill = packing.bins, packing.fill
    room = sorted((capacity - f, b) for b, f in enumerate(fill))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
            fill.append(0)
        bins[b].append(i)
        fill[b] += sizes[i]
        insort(room, (left - sizes[i], b))


def seeded(sizes: Sequence[int], capacity: int, noise: float, rng: random.Random) -> Packing:
    """Best fit of the items by falling size, disturbed by `noise`."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    packing = Packing([], [])
    best_fit(packing, order, sizes, capacity)
    return packing


def crossover(into: Packing, donor: Packing, sizes: Sequence[int], capacity: int, rng: random.Random) -> Packing:
    """`into` with some of the donor's best-filled containers, whole."""
    ranked = sorted(range(len(donor.bins)), key=lambda b: -donor.fill[b])
    good = ranked[: max(1, len(ranked) // 2)]
    start = rng.randrange(len(good))
    injected = good[start : start + max(1, rng.randrange(1, len(good) + 1) // 2)]
    taken = {i for b in injected for i in donor.bins[b]}
    child, displaced = Packing([], []), []
    for items, fill in zip(into.bins, into.fill, strict=True):
        if taken.isdisjoint(items):
            child.bins.append(list(items))
            child.fill.append(fill)
        else:
            displaced += [i for i in items if i not in taken]
    for b in injected:
        child.bins.append(list(donor.bins[b]))
        child.fill.append(donor.fill[b])
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(child, displaced, sizes, capacity)
    return child


def mutate(packing: Packing, sizes: Sequence[int], capacity: int, rng: random.Random) -> Packing:
    """Empties the poorest containers and a few others and puts their items back."""
    n = len(packing.bins)
    poor = sorted(range(n), key=lambda b: packing.fill[b])[: max(1, n // 50)]
    out = {*poor, *(rng.randrange(n) for _ in range(max(2, n // 25)))}
    loose = [i for b in out for i in packing.bins[b]]
    kept = [b for b in range(n) if b not in out]
    child = Packing([list(packing.bins[b]) for b in kept], [packing.fill[b] for b in kept])
    loose.sort(key=lambda i: -sizes[i] * (1 + 0.2 * rng.random()))
    best_fit(child, loose, sizes, capacity)
    return child


def evolve(sizes: Sequence[int], capacity: int, start: Sequence[Packing], seed: int) -> list[Packing]:
    """The elite after one epoch on one island. It ends early when no packing can have fewer containers."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people = list(start)
    while len(people) < POPULATION:
        people.append(seeded(sizes, capacity, 0.0 if not people else 0.1 * len(people), rng))
        if len(people[-1].bins) <= least and not start:
            break
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: -p.score(capacity))
        if len(people[0].bins) <= least:
            break
        parents = people[: max(2, POPULATION // 2)]
        children = []
        for _ in range(OFFSPRING):
            a, b = rng.sample(parents, 2) if len(parents) > 1 else (parents[0], parents[0])
            children.append(crossover(a, b, sizes, capacity, rng))
            children.append(mutate(parents[0], sizes, capacity, rng))
        people = sorted(people + children, key=lambda p: -p.score(capacity))[:POPULATION]
    people.sort(key=lambda p: -p.score(capacity))
    return people[:ELITE]


def _decode(owner: Sequence[int], sizes: Sequence[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(owner, default=-1) + 1)]
    for i, b in enumerate(owner):
        bins[b].append(i)
    return Packing(bins, [sum(sizes[i] for i in b) for b in bins])


def _encode(packing: Packing, n: int) -> list[int]:
    owner = [0] * n
    for b, items in enumerate(packing.bins):
        for i in items:
            owner[i] = b
    return owner


_ELITE = "pack_id int, block bigint, island int, score double, owner array<int>"


def _epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pack_id, capacity, block, island, seed, sizes, elites -> the island's new elite."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for pack, capacity, block, island, seed, sizes, elites in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            start = [_decode(o, sizes) for o in elites or []]
            for packing in evolve(sizes, capacity, start, seed):
                for col, v in zip(out, (pack, block, island, packing.score(capacity), _encode(packing, len(sizes))), strict=True):
                    col.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["pack_id", "block", "island", "score", "owner"])


def _level(items: DataFrame, blocks: dict[int, int], level: int) -> DataFrame:
    """The items with the container (block and number) that each goes to, and how full that is."""
    spark = items.sparkSession
    of = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    block = F.pmod(F.xxhash64("row", "piece", F.lit(level)), of[F.col("pack_id")].cast("bigint"))
    held = F.sort_array(F.collect_list(F.struct("size", "row", "piece", "doc_id", "n_pieces", "start_pos"))).alias("items")
    dealt = cut(items.groupBy("pack_id", "capacity", block.alias("block")).agg(held), "blocks")
    lean = dealt.select("pack_id", "capacity", "block", F.col("items.size").alias("sizes"))
    n = width(spark)
    elite = None
    for epoch in range(EPOCHS):
        if elite is None:
            ready = lean.withColumn("elites", F.lit(None).cast("array<array<int>>")).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
        else:  # each elite stays at home and migrates to the next island of the ring
            sent = elite.withColumn("island", F.explode(F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)))
            met = sent.groupBy("pack_id", "block", "island").agg(F.sort_array(F.collect_set("owner")).alias("elites"))
            ready = lean.join(met, ["pack_id", "block"])
        seed = F.xxhash64("pack_id", "block", "island", F.lit(level), F.lit(epoch)).alias("seed")
        ready = ready.select("pack_id", "capacity", "block", "island", seed, "sizes", "elites")
        elite = cut(ready.repartition(n, "pack_id", "block", "island").mapInArrow(_epoch, _ELITE), "elite")
    best = elite.groupBy("pack_id", "block").agg(F.max(F.struct("score", "owner")).alias("best"))
    packed = dealt.join(best, ["pack_id", "block"]).select("pack_id", "capacity", "block", F.explode(F.arrays_zip("items", F.col("best.owner").alias("owner"))).alias("x"))
    packed = packed.select("pack_id", "capacity", "block", F.col("x.owner").alias("bin"), "x.items.*")
    fill = packed.groupBy("pack_id", "block", "bin").agg(F.sum("size").alias("fill"))
    return packed.join(fill, ["pack_id", "block", "bin"])


def _pieces(docs: DataFrame, packs: list[tuple[int, int]]) -> DataFrame:
    """A row for each piece of each document and pack: whole documents, and larger ones cut at multiples of the capacity."""
    specs = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in packs]))
    rows = docs.withColumn("pack", specs).select("doc_id", "row", "tokens", "pack.pack_id", "pack.capacity")
    rows = rows.withColumn("n_pieces", F.expr("cast(greatest(1L, (tokens + capacity - 1) div capacity) as int)"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    start = F.col("piece") * F.col("capacity")
    return rows.select("pack_id", "capacity", "doc_id", "row", "piece", "n_pieces", start.alias("start_pos"), F.least(F.col("capacity"), F.col("tokens") - start).alias("size"))


OUT = ["pack_id", "container", "doc_id", "piece", "n_pieces", "start_pos", "size"]


def pack(docs: DataFrame, specs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """pack_id, container, doc_id, piece, n_pieces, start_pos, size: where every document goes, for every pack_spec.

    A size is the number of UTF-8 bytes of the text. A document of at most the capacity is one piece; a larger one is
    cut at multiples of the capacity, start_pos being a piece's first byte, and its last piece is packed like a
    document. Null and empty texts have size 0 and go to a container too. Specs with null id or a capacity that is null
    or below 1 are left out and repeated ones count once; the specs are a short list of sizes, MAX_SPECS at most, and are read by the driver.
    Repeated documents are packed one by one; without documents or specs the result is empty.
    """
    valid = specs.where(F.col("pack_id").isNotNull() & (F.col("capacity") >= 1)).select("pack_id", "capacity").distinct()
    packs = sorted((int(p), int(c)) for p, c in valid.limit(MAX_SPECS + 1).collect())
    if len(packs) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    if len({p for p, _ in packs}) < len(packs):
        raise ValueError("a pack_id has two capacities")
    sizes = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("tokens"), F.monotonically_increasing_id().alias("row"))
    if not packs:
        return sizes.select(*[F.lit(None).cast(k).alias(c) for c, k in zip(OUT, "int string bigint int int bigint bigint".split(), strict=True)]).where("false")
    pieces = cut(_pieces(sizes, packs), "pieces")
    whole = F.col("size") >= F.col("capacity")
    # the row number tells apart repeated documents, each of which fills containers of its own
    own = F.concat_ws("-", F.lit("w"), F.col("row").cast("string"), F.col("piece").cast("string"))
    done = [pieces.where(whole).withColumn("container", own)]
    rest, before = pieces.where(~whole), None
    for level in range(MAX_LEVELS):
        counts = {r[0]: r[1] for r in rest.groupBy("pack_id").count().collect()}
        n = sum(counts.values())
        if not n:
            break
        blocks = {p: -(-counts.get(p, 0) // BLOCK_ITEMS) or 1 for p, _ in packs}
        last = max(blocks.values()) == 1 or level == MAX_LEVELS - 1 or before is not None and n * 2 > before
        placed = cut(_level(rest, blocks, level), "placed")
        name = F.concat_ws("-", F.lit(level).cast("string"), F.col("block").cast("string"), F.col("bin").cast("string"))
        final = F.lit(True) if last else F.col("fill") * 100 >= F.col("capacity") * FULL_PERCENT
        done.append(placed.where(final).withColumn("container", name))
        if last:
            break
        rest, before = placed.where(~final).select(*pieces.columns), n
    out = done[0].select(*OUT)
    for d in done[1:]:
        out = out.unionByName(d.select(*OUT))
    return out


def cut_documents(packed: DataFrame) -> DataFrame:
    """pack_id, doc_id: documents that fit no container whole."""
    return packed.where(F.col("n_pieces") > 1).select("pack_id", "doc_id").distinct()


def summary(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """pack_id, n_containers, n_tokens, least_containers (no packing can have fewer), fullness in per cent."""
    per = packed.groupBy("pack_id", "container").agg(F.sum("size").alias("t")).groupBy("pack_id")
    total = per.agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"))
    known = specs.select("pack_id", "capacity").distinct()
    full = F.round(F.col("n_tokens") * 100 / (F.col("n_containers") * F.col("capacity")), 3)
    return total.join(known, "pack_id").select("pack_id", "n_containers", "n_tokens", F.expr("(n_tokens + capacity - 1) div capacity").alias("least_containers"), full.alias("fullness"))
