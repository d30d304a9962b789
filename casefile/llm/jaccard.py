"""N-gram Jaccard join: all links between texts whose shingle sets are similar enough, as components.

Equal sets are one node. For the rest the join is exact and works in these steps:

1. Frequencies: every shingle adds to one of 2**20 counters, over all texts. Their levels (one byte each, 1 MB) only
   order shingles: those of low counters first, then by hash.
2. Signatures: per set its size, a parity bitmap of 1,024 bits (each shingle flips one) and its prefix in that
   order. Two sets that are similar enough share a shingle of both prefixes, whatever the order is.
3. Stars: sets that share one of their smallest hashes are compared with two members of that group, and links
   found are joined to components, so a group of near copies becomes one component from a few links per member.
4. Tiles: prefix shingles that occur in more than one component are live. The sets under a live shingle form a tile,
   sorted by size; a tile over ``TILE`` sets is cut into size bands and those into blocks, a tile for each pair. In a
   tile only sets of different components and of compatible sizes meet; bits that differ between two bitmaps
   bound the shingles that differ from below, and so the overlap from above; the shingle's place in both orders bounds
   it too, and for large sets a wider bitmap. What the bounds leave are candidates.
5. Candidates are verified on the sorted sets of their texts. In rounds every node tries its best candidate in another
   component, which joins dense groups with few pairs; when a round joins nothing, all candidates left are tried.

Nothing is dropped for being frequent: frequent shingles merely come last in the order, and so leave the prefixes of
all sets that have enough others.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import LOWER, batches_of, set_digest, shingle_set, text_bytes, word_hashes
from .held import drop, tidy
from .scratch import Workspace, written

BUCKET_BITS, BITMAP_WORDS, STARS, TILE = 20, 16, 8, 1024
#: Counters travel in this many segments; partial sums meet in this many groups.
SEGMENTS, FANS = 64, 64
#: Filter bits for the ids of texts to fetch.
FETCH_BITS = 1 << 23
#: Bytes of text whose sets are made together.
HELD = 1 << 20


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a string column."""
    for a, b in batches_of(column, HELD):
        data, offsets = text_bytes(column.slice(a, b - a))
        words, at = word_hashes(data, offsets, LOWER)
        for i in range(b - a):
            yield shingle_set(words[at[i] : at[i + 1]], k)


def levels_of(docs: DataFrame, text_col: str, k: int) -> bytes:
    """A byte per counter: how many texts have one of its shingles, in eighths of a standard deviation about the mean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        seen = False
        for batch in tidy(batches):
            for s in sets_of(batch.column(0), k):
                seen = True
                np.add.at(total, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
        if seen:
            fan = TaskContext.get().partitionId() % FANS
            parts = np.split(total, SEGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([fan] * SEGMENTS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["segment", "fan", "counts"])

    schema = "segment int, fan int, counts binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in table["counts"])
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"segment": table["segment"][:1], "fan": table["fan"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sums = docs.select(text_col).mapInArrow(count, schema)
    sums = sums.groupBy("segment", "fan").applyInArrow(add, schema).groupBy("segment").applyInArrow(add, schema)
    total = np.zeros(1 << BUCKET_BITS, np.float64)
    for r in sums.select("segment", "counts").collect():  # SEGMENTS rows, 4 MB together
        size = len(total) // SEGMENTS
        total[r[0] * size : (r[0] + 1) * size] = np.frombuffer(r[1], np.uint32)
    mean = total.mean()
    return np.clip(64 + 8 * (total - mean) / max(1.0, mean**0.5), 0, 255).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, levels: bytes) -> DataFrame:
    """doc_id, text_hash, n, d1, d2, bitmap, wide, prefix, stars for every text; empty sets have no prefix.

    wide: a second bitmap of at least n / 2 bits for sets that are too large for the first to tell apart, else empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        level = np.frombuffer(levels, np.uint8)
        for batch in tidy(batches):
            n, d1, d2, maps, wide, prefixes, stars = [], [], [], [], [], [], []
            for s in sets_of(batch.column(1), k):
                a, b = set_digest(s)
                width = 1 << (len(s) // 2).bit_length() if len(s) > 128 * BITMAP_WORDS else 0
                bucket = (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                size = len(s) + (100 - percent * len(s)) // 100 if len(s) else 0  # len - ceil(percent * len / 100) + 1
                n.append(len(s))
                d1.append(a)
                d2.append(b)
                maps.append(parity(s, 64 * BITMAP_WORDS))
                wide.append(parity(s, width))
                prefixes.append(s[np.argsort(level[bucket], kind="stable")[:size]].view(np.int64))
                stars.append(s[:STARS].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists(maps), lists(wide), lists(prefixes), lists(stars)],
                ["doc_id", "text_hash", "n", "d1", "d2", "bitmap", "wide", "prefix", "stars"],
            )

    schema = "doc_id long, text_hash long, n int, d1 long, d2 long, bitmap array<long>, wide array<long>, prefix array<long>, stars array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col, F.xxhash64(F.col(text_col)).alias("text_hash")).mapInArrow(work, schema)


def parity(s: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits, each flipped by the hashes that end in its number."""
    if not width:
        return np.zeros(0, np.int64)
    bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *values]))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def folded(a: Column, b: Column) -> Column:
    """A bitmap twice as wide as the other, folded to its width: the bits of its halves that differ."""
    half = F.floor(F.size(a) / 2).cast("int")
    return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(a)


def sifted(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the wide bitmaps of large sets leave; sizes of a pair differ by less than a doubling."""
    about = nodes.select("node", "n", F.when(F.size("wide") > 0, F.col("wide")).alias("wide"))
    left = about.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    right = about.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    both = pairs.join(left, "a").join(right, "b")
    bits = differing(folded(F.col("wa"), F.col("wb")), folded(F.col("wb"), F.col("wa")))
    return both.filter(F.col("wa").isNull() | F.col("wb").isNull() | possible(F.col("na"), F.col("nb"), bits, percent)).select("a", "b")


def possible(na: Column, nb: Column, bits: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked if at least ``bits`` shingles differ."""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * (na + nb - bits) >= percent * (na + nb + bits))


def pack(text: pa.Buffer) -> bytes:
    """A text for the exchange: its length and its compressed bytes."""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpack(packed: pa.Buffer) -> pa.Array:
    """The text of ``pack`` as a column of one row."""
    size = int.from_bytes(packed[:8].to_pybytes(), "little")
    data = pa.decompress(packed[8:], decompressed_size=size, codec="zstd") if size else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, size], np.int32)), data)


def texts_of(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, packed text) for the wanted nodes. One pass over the texts lets through those whose ids hit a filter of fixed
    size, so that few texts are exchanged; more nodes make the filter let through more, never less."""
    wanted = written(wanted.join(nodes.select("node", "label", "d1", "d2"), "node"), "jaccard-wanted")
    place = F.pmod(F.xxhash64("label"), F.lit(FETCH_BITS))
    # Bitmap functions number positions from 1.
    held = wanted.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    sieve = np.zeros(FETCH_BITS // 8, np.uint8)
    for r in held.collect():  # at most FETCH_BITS bits
        at = (r["bucket"] - 1) * 4096
        sieve[at : at + 4096] |= np.frombuffer(r["bits"], np.uint8)
    sieve_bytes = sieve.tobytes()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts whose ids may be wanted, with the digests of their sets."""
        bits = np.frombuffer(sieve_bytes, np.uint8)
        for batch in tidy(batches):
            at = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 > 0))
            digests = [set_digest(s) for s in sets_of(batch.column(0), k)]
            d1, d2 = ([d[i] for d in digests] for i in (0, 1))
            packed = [pack(x.as_buffer()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], ["packed", "d1", "d2"])

    ids = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    place_of = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FETCH_BITS))
    found = ids.select(F.col(text_col).alias("text"), place_of.alias("place"))
    found = found.mapInArrow(fetch, "packed binary, d1 long, d2 long")
    return written(wanted.join(found, ["d1", "d2"]).groupBy("node").agg(F.min("packed").alias("packed")), "jaccard-texts")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by intersection of the sorted sets of their texts."""
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        size = 0

        def get(node: int, packed: pa.BinaryScalar) -> np.ndarray:
            nonlocal size
            s = known.get(node)
            if s is None:
                s = next(iter(sets_of(unpack(packed.as_buffer()), k)))
                known[node] = s
                size += len(s)
                while size > 2_000_000 and len(known) > 2:
                    size -= len(known.popitem(last=False)[1])
            return s

        for batch in tidy(batches):
            keep = []
            for i in range(batch.num_rows):
                a, b = (get(batch.column(j)[i].as_py(), batch.column(j + 2)[i]) for j in (0, 1))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.mapInArrow(check, "a long, b long"), "jaccard-links")


def star_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Candidates between the members of each star group and two of them: the first and one as good as random."""
    slim = nodes.select("node", "n", "bitmap")
    member = nodes.select("node", F.explode("stars").alias("token"))
    flip = F.lit(0x2AAAAAAAAA)
    groups = member.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first"), F.min(F.col("node").bitwiseXOR(flip)).alias("other"))
    groups = groups.filter("members > 1").select("token", F.explode(F.array_distinct(F.array("first", F.col("other").bitwiseXOR(flip)))).alias("hub"))
    pairs = member.join(groups, "token").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = pairs.join(slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma")), "a")
    pairs = pairs.join(slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb")), "b")
    return pairs.filter(possible(F.col("na"), F.col("nb"), differing(F.col("ma"), F.col("mb")), percent)).select("a", "b")


def tiles(nodes: DataFrame, percent: int) -> DataFrame:
    """(tile, node, pos): every node under each of its live prefix shingles, with the shingle's place in the order."""
    posting = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    rooted = nodes.select("root", F.explode("prefix").alias("token"))
    live = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"))
    live = live.filter("low <> high").select("token", "members")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = posting.join(live, "token")
    bands = F.when(F.col("members") <= TILE, F.array(F.lit(-1))).otherwise(F.array(band, band - 1))
    rows = rows.select("token", "node", "pos", F.ceil(F.col("members") / TILE).cast("int").alias("blocks"), F.explode(bands).alias("band"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("token", "band", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "node", "pos")


def tile_pairs(rows: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, every: bool) -> DataFrame:
    """Candidates (a, b, diff) between different roots under a live shingle that sizes and bitmaps allow.

    roots: (r_node, r_root) of nodes that are not their own root. Without ``every`` a row of a tile gives the pair that
    differs in the fewest bits, and of those a node gives one, so there are no more pairs than nodes.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    about = nodes.join(roots, F.col("node") == F.col("r_node"), "left").select("node", "n", F.coalesce("r_root", "node").alias("root"), "bitmap")
    rows = rows.join(about, "node").select("tile", "n", "node", "root", "pos", "bitmap")
    rows = rows.repartition(tasks, "tile").sortWithinPartitions("tile", "n", "node")

    def meet(tile: np.ndarray, n: np.ndarray, node: np.ndarray, root: np.ndarray, pos: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
        """Pairs of rows at growing distance while tiles agree and sizes allow; rows are sorted by tile and size.

        If this shingle is the first that a pair shares, all it shares lies from here on in both orders; a pair for
        which that is too little shares an earlier one and is met there, or is no link.
        """
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        best, partner = np.full(len(tile), 1 << 30), np.zeros(len(tile), np.int64)
        at, gap = np.arange(len(tile) - 1), 1
        while len(at):
            at = at[at + gap < len(tile)]
            to = at + gap
            near = (tile[at] == tile[to]) & (100 * n[at] >= percent * n[to])
            at, to = at[near], to[near]
            need = percent * (n[at] + n[to])
            able = (root[at] != root[to]) & ((100 + percent) * (n[at] - pos[at]) >= need) & ((100 + percent) * (n[to] - pos[to]) >= need)
            a, b = at[able], to[able]
            if len(a):
                diff = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                both = n[a] + n[b]
                fits = 100 * (both - diff) >= percent * (both + diff)
                a, b, diff = a[fits], b[fits], diff[fits]
                if every:
                    for out, x in zip(found, (node[a], node[b], diff), strict=True):
                        out.append(x)
                else:
                    for x, y in ((a, b), (b, a)):
                        less = diff < best[x]
                        best[x[less]], partner[x[less]] = diff[less], node[y[less]]
            gap += 1
        if not every:
            has = best < 1 << 30
            return [node[has], partner[has], best[has]]
        return [np.concatenate(x) for x in found]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs_of(table: pa.Table) -> pa.RecordBatch:
            cols = [table[c].to_numpy().astype(np.int64, copy=False) for c in ("tile", "n", "node", "root", "pos")]
            bits = table["bitmap"].combine_chunks().flatten().to_numpy().reshape(-1, BITMAP_WORDS).view(np.uint64)
            pairs = np.unique(np.stack(meet(*cols, bits), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], ["a", "b", "diff"])

        for batch in tidy(batches):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tiles = held["tile"].to_numpy()
            if not len(tiles):
                continue
            cut = int(np.flatnonzero(tiles != tiles[-1])[-1]) + 1 if tiles[0] != tiles[-1] else 0
            if cut:
                yield pairs_of(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pairs_of(held)

    pairs = rows.mapInArrow(work, "a long, b long, diff long")
    if not every:
        pairs = pairs.groupBy("a").agg(F.min_by("b", F.struct("diff", "b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def rooted(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, detail: bool = False) -> DataFrame:
    """``id_col``, n_shingles, component_id for every row; with ``detail`` also text_hash and group.

    Words are runs of non-white-space bytes with A-Z lower-cased; a text's set holds its distinct k-word shingles, a
    shorter text's its whole sequence. Two texts are linked when 100 * intersection >= percent * union. component_id
    is the smallest id that links reach, the row's own included.

    Null texts and texts without words have an empty set and no links. Rows with a null id are linked with nothing
    and have no component. Repeated rows are equal sets; rows that repeat an id with other texts are sets of their
    own that share the id: text_hash (xxhash64 of the text) and group (a number per component, null for empty sets and
    null ids) tell them apart. Texts of any length are read whole, a set is in one task. An empty table gives an empty
    result; other columns are not read.
    """
    with Workspace() as w:
        levels = levels_of(docs, text_col, k)
        records = written(signatures(docs, id_col, text_col, k, percent, levels), "jaccard-signatures")
        ids = w.keep(written(records.select("doc_id", "text_hash", "n", "d1", "d2"), "jaccard-ids"))
        full = records.filter("n > 0 and doc_id is not null")
        nodes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("label"), *(F.first(c).alias(c) for c in ("n", "bitmap", "wide", "prefix", "stars")))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
        pairs = written(sifted(star_pairs(nodes, percent), nodes, percent), "jaccard-pairs")
        links = verified(pairs, texts_of(docs, id_col, text_col, nodes, ends(pairs), k), k, percent)
        roots = rooted(links)
        now = nodes.join(roots, nodes.node == F.col("r_node"), "left").withColumn("root", F.coalesce("r_root", "node"))
        rows = written(tiles(now, percent), "jaccard-tiles")
        # As in Boruvka's algorithm every node tries its best candidate, until a round joins nothing.
        pairs = written(tile_pairs(rows, nodes, roots, percent, every=False), "jaccard-pairs")
        open_nodes = written(ends(pairs), "jaccard-open")  # a node without a candidate now has none later
        texts = texts_of(docs, id_col, text_col, nodes, open_nodes, k)
        rows = written(rows.join(open_nodes, "node", "left_semi"), "jaccard-tiles")
        nodes_open = written(nodes.select("node", "n", "bitmap", "wide").join(open_nodes, "node", "left_semi"), "jaccard-open-nodes")
        new = verified(sifted(pairs, nodes_open, percent), texts, k, percent)
        while not new.isEmpty():
            links = links.unionByName(new)
            roots = rooted(links)
            pairs = tile_pairs(rows, nodes_open, roots, percent, every=False)
            new = verified(sifted(pairs, nodes_open, percent), texts, k, percent)
        pairs = tile_pairs(rows, nodes_open, roots, percent, every=True)
        links = links.unionByName(verified(sifted(pairs, nodes_open, percent), texts, k, percent))
        roots = rooted(links)
        member = roots.join(nodes.select("node", "label"), F.col("r_node") == F.col("node"))
        lowest = member.groupBy("r_root").agg(F.min("label").alias("component"))
        member = roots.join(lowest, "r_root").select(F.col("r_node"), "r_root", "component")
        classes = nodes.select("node", "d1", "d2", "label").join(member, F.col("node") == F.col("r_node"), "left")
        classes = w.keep(written(classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("r_root", "node").alias("group"), F.coalesce("component", "label").alias("component")), "jaccard-classes"))
    joined = ids.join(classes, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    group = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("group")).alias("group")
    return joined.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), *(["text_hash", group] if detail else []))
