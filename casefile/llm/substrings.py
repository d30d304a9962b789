"""Exact removal of repeated passages on the compacted De Bruijn graph of word k-mers.

Every window of k words is an edge between the (k-1)-mers at its ends. Within a text, neighbouring windows that share
their minimizer (the least hash of the m-word sequences in a window) are kept as one fragment, a path of edges
with its source coordinate (document, first word). Equal windows have equal minimizers, so what repeats can be
settled among the fragments of one minimizer:

1. Minimizers are counted over all texts. Only fragments of a minimizer that occurs twice go on.
2. Fragments of equal words are joined to one class with its earliest coordinate. A minimizer with a single class is
   straight: all of its windows first occur where the class first occurs.
3. A minimizer with several classes is where the graph branches or a text ends within a path. Only there the paths are
   opened: the edges of each class, taken once, at its first coordinate, are joined on their words, and every edge gets
   the earliest coordinate of all classes that hold it.
4. The graph of what repeats is compacted. Degrees of its nodes are sums over the (k-1)-mers at the ends of repeated
   classes. A straight class is linked to the one before it where the node between them has one edge in and one out and
   both are neighbours in their source. Links join to unitigs: within blocks of a source, whose size is bounded, in
   order; from block to block by joins with pointer jumping.
5. Occurrences are joined to their class. Those that lie behind their source coordinate repeat; along one document and
   one unitig they make a span, which is whole if its windows number as many as its coordinates say, and is kept in
   pieces otherwise. Per document the spans give the words to remove.

Counts, coordinates and degrees are sums and minima with partial aggregation, so a passage that a third of all texts
share adds a row per task; only joins see its fragments one by one, and those can be split. Filters that spare
exchanges are sized by what they hold, up to 2**FILTER_BITS bits; where they are full they let more through, and the
joins decide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import BASE, PLACE, batches_of, powers, text_bytes, windows, word_hashes
from .held import drop, tidy
from .scratch import Workspace, written

#: Words of a minimizer, most bits of a filter, windows that are cut into fragments together, bytes of text at a time.
MINIMIZER, FILTER_BITS, BLOCK, HELD = 6, 28, 1 << 17, 1 << 20
#: Words of a source that are ordered together when paths are compacted.
SOURCE_BLOCK = 1 << 16
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
_inverse = [np.ones(1, np.uint64)]


def inverse_powers(n: int) -> np.ndarray:
    if len(_inverse[0]) < n:
        size = 1 << (n - 1).bit_length()
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        _inverse[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, back, np.uint64))])
    return _inverse[0]


def fragments(words: np.ndarray, at: np.ndarray, k: int, edges: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, length, minimizer, content[, edge hashes of all windows, where each fragment's lie, head, tail]).

    head and tail are hashes of the (k-1)-mers in which a fragment's path starts and ends.

    words: hashes of all rows' words; at: where each row's words start; start counts within the row; length is in windows.
    """
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    width = k - min(MINIMIZER, k) + 1
    for a in range(0, max(0, len(words) - k + 1), BLOCK):
        part = words[a : a + BLOCK + k - 1]
        least = windows(part, min(MINIMIZER, k))
        n = len(part) - k + 1
        place = np.lib.stride_tricks.sliding_window_view(least, width).argmin(1) + np.arange(n)
        whole = row_of[a : a + n] == row_of[a + k - 1 : a + k - 1 + n]
        new = whole.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
        start = np.flatnonzero(new)
        if not len(start):
            continue
        length = np.bincount((np.cumsum(new) - 1)[whole], minlength=len(start))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers(len(part))[: len(part)])])
        back = inverse_powers(len(part) + 1)
        content = (total[start + length + k - 1] - total[start]) * back[start] + length.astype(np.uint64)
        row = row_of[a + start]
        out = (row, a + start - at[row], length, least[place[start]].view(np.int64), content.view(np.int64))
        if edges:
            node = lambda i: ((total[i + k - 1] - total[i]) * back[i]).view(np.int64)  # noqa: B023, E731
            out = (*out, windows(part, k).view(np.int64), start, node(start), node(start + length))
        yield out


def usable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, id, h (a hash of the text, which tells rows that repeat an id apart); null ids and texts are left out."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    return rows.filter("text is not null and id is not null").select("text", "id", F.xxhash64("text").alias("h"))


def sieve(keys: Column, rows: DataFrame) -> bytes:
    """A filter of the low bits of ``keys``: a power of two of them, at least eight per row up to 2**FILTER_BITS."""
    bits = min(FILTER_BITS, max(15, (8 * rows.count()).bit_length()))
    place = keys.bitwiseAND(F.lit((1 << bits) - 1))
    # Bitmap functions number positions from 1.
    held = rows.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in held.collect():  # 2**FILTER_BITS bits at most
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def hits(raw: bytes, keys: np.ndarray) -> np.ndarray:
    place = keys & (8 * len(raw) - 1)
    return (np.frombuffer(raw, np.uint8)[place >> 3] >> (place & 7)) & 1 > 0


def spot(c: Column, coordinate: Column) -> Column:
    """What a filter of classes at their first coordinates holds; ``spots`` is the same for numpy."""
    return c.bitwiseXOR(coordinate["id"]).bitwiseXOR(coordinate["word"].cast("long") * F.lit(8191))


def spots(c: np.ndarray, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
    return c ^ ids ^ (word * np.int64(8191))


def nested(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of ``sizes`` values each, which start at ``first``."""
    flat = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values[flat])


SCHEMAS = {
    "counts": "mm long, n long",
    "live": "mm long, c long, id long, h long, word int, len int",
    "paths": "mm long, c long, id long, word int, head long, tail long, edges array<long>",
}


def read_fragments(rows: DataFrame, k: int, kind: str, *filters: bytes) -> DataFrame:
    """One pass over the texts.

    kind "counts": mm, n per minimizer and batch; "live": the fragments whose minimizer hits the filter; "paths": those
    whose content and coordinate hit one of two filters, edges of those alone that hit the second.
    """
    names = T._parse_datatype_string(SCHEMAS[kind]).names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in tidy(batches):
            for a, b in batches_of(batch.column(0), HELD):
                ids, h = (batch.column(i).slice(a, b - a).to_numpy() for i in (1, 2))
                data, offsets = text_bytes(batch.column(0).slice(a, b - a))
                words, at = word_hashes(data, offsets)
                for found in fragments(words, at, k, kind == "paths"):
                    row, start, length, mm, c = found[:5]
                    if kind == "counts":
                        values, n = np.unique(mm, return_counts=True)
                        columns = [values, n.astype(np.int64)]
                    elif kind == "live":
                        keep = np.flatnonzero(hits(filters[0], mm))
                        columns = [mm[keep], c[keep], ids[row[keep]], h[row[keep]], start[keep].astype(np.int32), length[keep].astype(np.int32)]
                    else:
                        where = spots(c, ids[row], start)
                        opened = hits(filters[1], where)
                        keep = np.flatnonzero(opened | hits(filters[0], where))
                        edges = nested(found[5], found[6][keep], np.where(opened[keep], length[keep], 0))
                        columns = [mm[keep], c[keep], ids[row[keep]], start[keep].astype(np.int32), found[7][keep], found[8][keep], edges]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    return rows.mapInArrow(work, SCHEMAS[kind])


def classes_of(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Straight classes that repeat and the classes of branching minimizers: mm, c, n, first, len."""
    coordinate = F.struct("id", "word")
    classes = live.groupBy("mm", "c").agg(F.count(F.lit(1)).alias("n"), F.min(coordinate).alias("first"), F.max("len").alias("len"))
    classes = written(classes, "spans-classes")
    # Of a minimizer with one class the minima are that class.
    forms = classes.groupBy("mm").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"), F.min("c").alias("c"), F.min("first").alias("first"), F.min("len").alias("len"))
    forms = written(forms.filter("n > 1"), "spans-forms")
    straight = forms.filter("forms = 1").select("mm", "c", "n", "first", "len")
    return straight, written(classes.join(forms.filter("forms > 1").select("mm"), "mm", "left_semi"), "spans-branched")


def settled(opened: DataFrame) -> DataFrame:
    """Classes of branching minimizers that hold repeated edges, with the earliest coordinate of each edge in ``firsts``.

    opened: mm, c, n, first, head, tail, edges.
    """
    edges = written(opened.select("mm", "c", "n", "first", F.posexplode("edges").alias("i", "edge")), "spans-edges")
    own = F.struct(F.col("first.id").alias("id"), (F.col("first.word") + F.col("i")).alias("word"))
    earliest = edges.groupBy(F.col("mm").alias("g_mm"), F.col("edge").alias("g_edge")).agg(F.min(own).alias("low"))
    low = edges.join(earliest, (F.col("mm") == F.col("g_mm")) & (F.col("edge") == F.col("g_edge")))
    low = low.groupBy("mm", "c").agg(F.collect_list(F.struct("i", "low")).alias("lows"), F.max((F.col("n") > 1) | (F.col("low") < own)).alias("repeats"))
    low = low.filter("repeats").select(F.col("mm").alias("g_mm"), F.col("c").alias("g_c"), F.transform(F.array_sort("lows"), lambda x: x["low"]).alias("firsts"))
    return opened.drop("edges").join(low, (F.col("mm") == F.col("g_mm")) & (F.col("c") == F.col("g_c"))).drop("g_mm", "g_c")


def unitigs(straight: DataFrame, branched: DataFrame) -> DataFrame:
    """The straight classes (mm, c, first, len, head, tail) with ``root``: the word of their source at which their unitig starts.

    branched: head, tail of the other classes that repeat; their nodes count, and no path goes through them.
    """
    close = (F.col("first.word") + F.col("len")).alias("word")
    none = F.lit(None)
    ends = straight.select("head", "tail", F.col("first.id").alias("id"), close)
    ends = ends.unionByName(branched.select("head", "tail", none.cast("long").alias("id"), none.cast("int").alias("word")))
    leave = F.struct(F.col("head").alias("node"), F.lit(0).alias("ins"), F.lit(1).alias("outs"), none.cast("long").alias("id"), none.cast("int").alias("word"))
    enter = F.struct(F.col("tail").alias("node"), F.lit(1).alias("ins"), F.lit(0).alias("outs"), "id", "word")
    degrees = ends.select(F.explode(F.array(leave, enter)).alias("x")).select("x.*").groupBy("node")
    degrees = degrees.agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.max("id").alias("from_id"), F.max("word").alias("from_word"))
    passed = degrees.filter("ins = 1 and outs = 1 and from_id is not null").select("node", "from_id", "from_word")
    here = (F.col("from_id") == F.col("first.id")) & (F.col("from_word") == F.col("first.word"))
    linked = straight.join(passed, F.col("head") == F.col("node"), "left").withColumn("linked", F.coalesce(here, F.lit(False)))
    block = F.floor(F.col("first.word") / SOURCE_BLOCK).cast("int")
    order = Window.partitionBy("id", "block").orderBy("word", "c")
    linked = linked.select("mm", "c", F.col("first.id").alias("id"), F.col("first.word").alias("word"), "len", "linked", block.alias("block"))
    before = F.lag(F.col("word") + F.col("len")).over(order)
    joined = linked.withColumn("before", before).withColumn("across", F.col("linked") & F.col("before").isNull())
    start = F.when(F.col("linked") & (F.col("before") == F.col("word")), None).otherwise(F.col("word"))
    runs = joined.withColumn("run", F.last(start, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(runs.select("mm", "c", "id", "word", "len", "run", "across"), "spans-runs")
    # A run that goes on from the block before it points to the run that ends there; pointers jump until all are at their roots.
    goes_on = runs.filter("across").select(F.col("id").alias("o_id"), F.col("run").alias("o_run")).distinct()
    heads = runs.groupBy("id", "run").agg(F.max(F.col("word") + F.col("len")).alias("end"))
    points = goes_on.join(heads, (F.col("o_id") == F.col("id")) & (F.col("o_run") == F.col("end"))).groupBy("o_id", "o_run").agg(F.min("run").alias("root"))
    points = written(points.select(F.col("o_id").alias("id"), F.col("o_run").alias("run"), "root"), "spans-points")
    while True:
        next_of = points.select(F.col("id").alias("n_id"), F.col("run").alias("n_run"), F.col("root").alias("further"))
        jumped = points.join(next_of, (F.col("id") == F.col("n_id")) & (F.col("root") == F.col("n_run")), "left")
        points = written(jumped.select("id", "run", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spans-points")
        if points.filter("moved").isEmpty():
            break
    roots = points.select(F.col("id").alias("p_id"), F.col("run").alias("p_run"), "root")
    found = runs.join(roots, (F.col("id") == F.col("p_id")) & (F.col("run") == F.col("p_run")), "left")
    return found.select("mm", "c", F.struct("id", "word").alias("first"), F.coalesce("root", "run").alias("root"))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, h, spans): per document the windows that repeat, as [first, after the last] pairs of word numbers."""
    rows = usable(docs, id_col, text_col)
    counts = read_fragments(rows, k, "counts").groupBy("mm").agg(F.sum("n").alias("n")).filter("n > 1").select("mm")
    counts = written(counts, "spans-counts")
    live = written(read_fragments(rows, k, "live", sieve(F.col("mm"), counts)), "spans-live")
    straight, branched = classes_of(live)
    at_first = spot(F.col("c"), F.col("first"))
    paths = read_fragments(rows, k, "paths", sieve(at_first, straight), sieve(at_first, branched)).select(
        F.col("mm").alias("p_mm"), F.col("c").alias("p_c"), F.struct("id", "word").alias("p_first"), "head", "tail", "edges"
    )
    paths = paths.dropDuplicates(["p_mm", "p_c", "p_first"])
    wanted = straight.withColumn("straight", F.lit(True)).unionByName(branched.withColumn("straight", F.lit(False)))
    same = (F.col("p_mm") == F.col("mm")) & (F.col("p_c") == F.col("c")) & (F.col("p_first") == F.col("first"))
    wanted = written(wanted.join(paths, same).drop("p_mm", "p_c", "p_first"), "spans-wanted")
    parted = written(settled(wanted.filter("not straight")), "spans-settled")
    chains = unitigs(wanted.filter("straight").select("mm", "c", "first", "len", "head", "tail"), parted.select("head", "tail"))
    none = F.lit(None)
    chains = chains.withColumn("firsts", none.cast(parted.schema["firsts"].dataType))
    decided = chains.unionByName(parted.select("mm", "c", "first", none.cast("int").alias("root"), "firsts"))
    decided = decided.select(F.col("mm").alias("d_mm"), F.col("c").alias("d_c"), "first", "root", "firsts")
    met = live.join(decided, (F.col("mm") == F.col("d_mm")) & (F.col("c") == F.col("d_c")))
    own = lambda i: F.struct(F.col("id").alias("id"), (F.col("word") + i).alias("word"))
    met = met.filter(F.col("firsts").isNotNull() | (F.col("first") < own(F.lit(0))))
    # Windows of an opened class repeat one by one; runs of them are ranges.
    met = met.withColumn("gone", F.transform("firsts", lambda x, i: x < own(i)))
    at = lambda i: F.coalesce(F.get("gone", i), F.lit(False))
    places = F.sequence(F.lit(0), F.col("len") - 1)
    opens, closes = F.filter(places, lambda i: at(i) & ~at(i - 1)), F.filter(places, lambda i: at(i) & ~at(i + 1))
    ranges = F.zip_with(opens, closes, lambda a, b: F.struct((F.col("word") + a).alias("a"), (F.col("word") + b + 1).alias("b")))
    whole = F.array(F.struct(F.col("word").alias("a"), (F.col("word") + F.col("len")).alias("b")))
    met = met.select("id", "h", F.col("first.id").alias("source"), "root", (F.col("word") - F.col("first.word")).alias("shift"), F.explode(F.when(F.col("firsts").isNull(), whole).otherwise(ranges)).alias("r"))
    # One exchange serves both groupings.
    met = met.repartition("id", "h")
    spans = met.groupBy("id", "h", "source", "root", "shift").agg(F.collect_set("r").alias("parts"))
    low, high = F.array_min(F.transform("parts", lambda x: x["a"])), F.array_max(F.transform("parts", lambda x: x["b"]))
    size = F.aggregate("parts", F.lit(0), lambda s, x: s + x["b"] - x["a"])
    spans = spans.select("id", "h", F.when(size == high - low, F.array(F.struct(low.alias("a"), high.alias("b")))).otherwise(F.col("parts")).alias("parts"))
    return spans.groupBy("id", "h").agg(F.flatten(F.collect_list("parts")).alias("spans"))


def covered(n: int, first: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a repeated window; windows start at first .. after - 1."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(after + k - 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """Remove each word that a window of ``k`` words covers whose words also start earlier.

    Earlier is a smaller id, or an earlier word of the same document; windows are judged on the input. Returns
    ``id_col``, the ``keep`` columns, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with
    ``texts``, text (those words) and spans (array of [first word, word after the last] that were removed).

    Null texts have no words and stay null; rows with a null id are compared with nothing and stay whole. Rows that
    repeat an id with the same text are one occurrence: neither is earlier. With different texts they are one
    document, and only an earlier place counts. Ids may be any long, texts of any length. An empty table gives an empty
    result; other columns are not read. ``k`` is between 2 and 4,096; others raise.
    """
    if not 2 <= k <= len(PLACE):
        raise ValueError(f"windows of {k} words are not supported")
    with Workspace() as w:
        lists = repeated_spans(docs, id_col, text_col, k).select(F.col("id").alias("r_id"), F.col("h").alias("r_h"), "spans")
        lists = w.keep(written(lists, "spans-lists"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_h"), F.struct(*(F.col(c) for c in keep), F.lit(0).alias("_none")).alias("_keep"))
    joined = rows.join(lists, (F.col("_id").cast("long") == F.col("r_id")) & (F.col("_h") == F.col("r_h")), "left")
    joined = joined.select("_text", F.col("spans.a").alias("first"), F.col("spans.b").alias("after"), "_id", "_keep")
    out = "n_words long, n_removed long, kept_sha256 string, text string, spans array<array<int>>" if texts else "n_words long, n_removed long, kept_sha256 string"
    schema = T.StructType([T.StructField("_id", joined.schema["_id"].dataType), T.StructField("_keep", joined.schema["_keep"].dataType), *T._parse_datatype_string(out).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in tidy(batches):
            for begin, end in batches_of(batch.column(0), HELD):
                part = batch.slice(begin, end - begin)
                n, removed, sha, kept_text, spans = [], [], [], [], []
                for text, first, after in zip(part.column(0), part.column(1), part.column(2), strict=True):
                    words = WORD_BYTES.findall((text.as_py() or "").encode("utf-8"))
                    gone = None
                    if first.is_valid:
                        gone = covered(len(words), first.values.to_numpy(), after.values.to_numpy(), k)
                    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    data = b" ".join(kept)
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(data).hexdigest())
                    if texts:
                        # A text from which nothing goes stays as it is, with its own white space.
                        kept_text.append(text.as_py() if removed[-1] == 0 else data.decode("utf-8"))
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.zeros(0) if gone is None else gone.astype(int), [0]])))
                        spans.append(edge.reshape(-1, 2).tolist())
                columns = [part.column(3), part.column(4), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                if texts:
                    columns += [pa.array(kept_text, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    result = joined.mapInArrow(work, schema)
    names = [f.name for f in schema.fields[2:]]
    return result.select(F.col("_id").alias(id_col), *(F.col("_keep")[c].alias(c) for c in keep), *names)
