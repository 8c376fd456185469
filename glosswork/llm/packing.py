"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's ids (with an end id) are cut into pieces of the sequence length;
only longer documents are cut and the first piece takes the remainder, so all
but one piece of a document fill a sequence. The other pieces are dealt over
blocks by hash, and the islands of a block evolve its packing:

* a chromosome names the bin of every piece; its fitness is few bins, then full
  ones (the mean squared fill);
* crossover injects well-filled bins of one parent whole into the other, drops
  the bins that hold a duplicate, and best-fits the displaced pieces;
* mutation empties some of the worst bins and best-fits their pieces anew;
* a population starts from random groupings (pieces in random order, best fit);
  in the first island one of them is best fit by decreasing size;
* an island evolves in its own task for an epoch; between epochs its best
  packings migrate to the next island of the ring. After the last epoch the best
  packing of all islands is decoded. An island that meets the lower bound rests.

Bins left under half full in any block are opened again and their pieces form
the next level, until one block is left or a level opens no fewer pieces.

Every piece carries what its block's evolution did: generations over all
islands, bins_start (the best starting packing of the islands), bins_end.

Defined cases: null text counts as empty and is a piece of the end id alone;
repeated rows are packed once each; ties of fitness go to the lower island; an
empty table gives no rows; only doc_id and text are read, so other columns may
have any name. No group of a task is larger than about BLOCK pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ROOT, materialize, table, text_of

CAPACITY = 2048
END_ID = 0
#: Pieces of a block, islands of a block, epochs (migrations and one), and an island's evolution.
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 8192, 3, 3, 6, 12
#: Packings that an island sends on, share of bins injected and share emptied.
ELITES, INJECTED, EMPTIED = 2, 0.3, 0.05


def best_fit(order, sizes, capacity, place=None, room=None):
    """(place, room): the bin of every item and what is left in each bin.

    Puts the items of order into the fullest bin that still has room for each;
    place and room hold what is packed already. Bins of equal room form a stack
    and a bit set names the rooms in use, so a step takes constant time.
    """
    place = [-1] * len(sizes) if place is None else place
    room = [] if room is None else room
    at: dict[int, list[int]] = {}
    used = 0
    for b, left in enumerate(room):
        at.setdefault(left, []).append(b)
        used |= 1 << left
    for item in order:
        size = sizes[item]
        above = used >> size
        if above:
            left = size + ((above & -above).bit_length() - 1)
            b = at[left].pop()
            if not at[left]:
                used &= ~(1 << left)
        else:
            b, left = len(room), capacity
            room.append(capacity)
        place[item] = b
        left -= size
        room[b] = left
        at.setdefault(left, []).append(b)
        used |= 1 << left
    return place, room


def fitness(packing, capacity):
    """Less is better: bins, then the negative mean squared fill."""
    import numpy as np

    room = np.asarray(packing[1], float)
    return (len(room), -float(np.mean((1 - room / capacity) ** 2)) if len(room) else 0.0)


def _refit(place, gone, sizes, capacity, order=None):
    """Best-fits the items whose place is -1; bins flagged gone are left out."""
    import numpy as np

    loose = np.flatnonzero(place < 0)
    loose = loose[np.argsort(-sizes[loose], kind="stable")] if order is None else order
    number = np.cumsum(~gone) - 1
    held = place >= 0
    place = place.copy()
    place[held] = number[place[held]]
    room = capacity - np.bincount(place[held], sizes[held], int((~gone).sum())).astype(np.int64)
    return best_fit(loose.tolist(), sizes.tolist(), capacity, place.tolist(), room.tolist())


def crossover(one, two, sizes, capacity, rng, share=INJECTED):
    """Injects well-filled bins of two into one: chosen at random, the fuller the likelier."""
    import numpy as np

    a, b, room = np.asarray(one[0]), np.asarray(two[0]), np.asarray(two[1])
    fill = 1 - room / capacity
    keys = rng.random(len(room)) ** (1 / np.maximum(fill**8, 1e-9))
    chosen = np.zeros(len(room), bool)
    chosen[np.argsort(-keys, kind="stable")[: max(1, int(len(room) * share))]] = True
    injected = chosen[b]
    bins = len(one[1])
    hit = np.zeros(bins + len(room), bool)
    hit[a[injected]] = True
    place = np.where(injected, bins + b, np.where(hit[a], -1, a))
    gone = hit.copy()
    gone[bins:] = ~chosen
    return _refit(place, gone, sizes, capacity)


def mutate(one, sizes, capacity, rng, share=EMPTIED):
    """Empties some of the worst-filled bins and best-fits their pieces in random order."""
    import numpy as np

    place, room = np.asarray(one[0]), np.asarray(one[1])
    count = max(2, int(len(room) * share))
    worst = np.argsort(-room, kind="stable")[: 2 * count]
    gone = np.zeros(len(room), bool)
    gone[rng.permutation(worst)[:count]] = True
    place = np.where(gone[place], -1, place)
    return _refit(place, gone, sizes, capacity, rng.permutation(np.flatnonzero(place < 0)))


def grouping(sizes, capacity, rng=None):
    """Best fit of all pieces: by decreasing size, or in random order with rng."""
    import numpy as np

    order = np.argsort(-sizes, kind="stable") if rng is None else rng.permutation(len(sizes))
    return best_fit(order.tolist(), sizes.tolist(), capacity)


def evolve(sizes, capacity, seed, pop=(), decreasing=False, population=POPULATION, generations=GENERATIONS):
    """(population, best first; generations run; bins of the best at the start).

    Starts from pop, or from random groupings, one of them by decreasing size if asked.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes = np.asarray(sizes, np.int64)
    bound = -(-int(sizes.sum()) // capacity)
    key = lambda one: fitness(one, capacity)
    pop = list(pop)
    if decreasing:
        pop.append(grouping(sizes, capacity))
    while len(pop) < population:
        pop.append(grouping(sizes, capacity, rng))
    pop = sorted(pop, key=key)[:population]
    start, ran = len(pop[0][1]), 0
    while ran < generations and len(pop[0][1]) > bound:
        ran += 1
        one, two = (pop[min(rng.integers(len(pop), size=2))] for _ in range(2))
        child = crossover(one, two, sizes, capacity, rng) if one is not two else one
        if one is two or rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        if key(child) < key(pop[-1]) and all(key(child) != key(p) for p in pop):
            pop[-1] = child
            pop.sort(key=key)
    return pop, ran, start


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, full_id of every document's pieces.

    full_id numbers the pieces that fill a sequence; it is null for others.
    """
    root = ROOT

    def run(batches):
        import sys
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.bpe import bulk_encoder

        coder, tail = bulk_encoder(tokenizer_path), end_id.to_bytes(4, "little")
        number = (TaskContext.get().partitionId() << 36) + 1
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(coder.encode(text.as_py()) + tail)
                n = len(ids) // 4
                start, piece = 0, 0
                length = n % capacity or capacity
                while start < n:
                    full = None
                    if length == capacity:
                        full, number = -number, number + 1
                    for column, x in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), full), strict=True):
                        column.append(x)
                    start, piece, length = start + length, piece + 1, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "full_id"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, full_id long")


_STATE = "block long, island int, generations long, bins_start long, packings array<array<int>>"
_ITEM = "item long, length long, sequence_id long, offset long, room long, generations long, bins_start long, bins_end long"


def _rooms(sizes, places, capacity):
    """Packings from the bins of their items."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    return [(list(p), (capacity - np.bincount(np.asarray(p), sizes).astype(np.int64)).tolist()) for p in places]


def _epoch(on_islands: DataFrame, state: DataFrame | None, level: int, epoch: int, capacity: int) -> DataFrame:
    """The islands' state after an epoch that starts from what has migrated."""
    root = ROOT

    def island(key, frame, arrived):
        import sys
        import zlib

        import pandas as pd

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.packing import ELITES, _rooms, evolve

        sizes = frame.sort_values("item")["length"].tolist()
        pop = [p for rows in arrived["packings"] for p in rows] if arrived is not None else []
        seed = zlib.crc32(f"{level}:{epoch}:{int(key[0])}:{int(key[1])}".encode())
        pop, ran, start = evolve(sizes, capacity, seed, _rooms(sizes, pop, capacity), decreasing=epoch == 0 and key[1] == 0)
        if arrived is not None and len(arrived):
            ran, start = ran + int(arrived["generations"].max()), int(arrived["bins_start"].min())
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "generations": [ran], "bins_start": [start], "packings": [[p for p, _ in pop[: 2 * ELITES]]]})

    keys = on_islands.groupBy("block", "island")
    if state is None:
        return keys.applyInPandas(lambda key, frame: island(key, frame, None), _STATE)
    return keys.cogroup(state.groupBy("block", "island")).applyInPandas(island, _STATE)


def _level(items: DataFrame, blocks: int, level: int, capacity: int, islands: int) -> DataFrame:
    """Packs items (item, length): adds sequence_id, offset, the room of its bin and the block's report."""
    root = ROOT

    def settle(key, frame, states):
        import sys

        import numpy as np
        import pandas as pd

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.packing import _rooms, fitness

        frame = frame.sort_values("item")
        sizes = frame["length"].to_numpy(np.int64)
        states = states.sort_values("island")
        found = _rooms(sizes, [rows[0] for rows in states["packings"]], capacity)
        place, room = min(found, key=lambda one: fitness(one, capacity))
        place = np.asarray(place, np.int64)
        order = np.argsort(place, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.searchsorted(place[order], place[order])
        out = {"item": frame["item"].to_numpy()[order], "length": sizes[order], "sequence_id": (level << 58) + (int(key[0]) << 24) + place[order], "offset": before - before[first], "room": np.asarray(room)[place[order]]}
        return pd.DataFrame(out).assign(generations=int(states["generations"].sum()), bins_start=int(states["bins_start"].min()), bins_end=len(room))

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
    on_islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = None
    for epoch in range(EPOCHS):
        if state is not None:
            # An island keeps its own packings; the best of them also go to the next island of the ring.
            sent = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "generations", "bins_start", F.slice("packings", 1, ELITES).alias("packings"))
            state = state.unionByName(sent.withColumn("generations", F.lit(0).cast("long")))
        state = materialize(_epoch(on_islands, state, level, epoch, capacity), "islands")
    return dealt.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(settle, _ITEM)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece;
    generations, bins_start, bins_end of its block (null where the piece fills a sequence)."""
    cut = pieces(docs, tokenizer_path, capacity, end_id).withColumn("item", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    loose = cut.where(F.col("full_id").isNull()).select("item", "length")
    done, level = None, 1
    count = loose.count()
    while True:
        blocks = max(1, -(-count // block))
        packed = _level(loose, blocks, level, capacity, islands)
        last = blocks == 1
        if not last:
            packed = materialize(packed, "packed")
            again = F.col("room") > capacity // 2
            left = packed.where(again).count()
            # A level that opens all its pieces again would do so for ever.
            last = left in (0, count)
            if not last:
                loose, packed, count = packed.where(again).select("item", "length"), packed.where(~again), left
        done = packed if done is None else done.unionByName(packed)
        if last:
            break
        level += 1
    report = ("generations", "bins_start", "bins_end")
    placed = done.select(F.col("item").alias("_item"), "sequence_id", "offset", *report)
    piece = ("doc_id", "piece", "start", "length", "ids_crc32")
    full = cut.where(F.col("full_id").isNotNull()).select(*piece, F.col("full_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(F.lit(None).cast("long").alias(c) for c in report))
    part = cut.where(F.col("full_id").isNull()).join(placed, F.col("item") == F.col("_item")).select(*piece, "sequence_id", "offset", *report)
    return full.unionByName(part)


def query(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
