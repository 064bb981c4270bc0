"""Removal of repeated byte strings with suffix arrays.

A string of `LENGTH` bytes repeats if it also starts anywhere else, in the same text or another one.

* Every window of that length owns the least hashed `K`-byte string in it, leftmost first: its anchor.  Equal windows have
  equal anchors at equal offsets, so windows of different anchors need never meet.  Neighbouring windows with one anchor form
  a region (about 290 bytes for 85 windows); equal regions are counted and go on as one with a weight.
* Regions whose anchor occurs once are done.  The others are dealt by anchor, some 200 kB at a time.  For each portion the
  suffix array, to depth `LENGTH`, gives the Burrows-Wheeler transform; backward extension, breadth first, finds the
  intervals of all strings of 1, 2, ... bytes and with them the places where neighbouring suffixes share fewer bytes than
  that, in order of rising common prefixes.  It stops at `LENGTH`: what no boundary parts then is equal in that many bytes.
* An anchor with more than `HOT_REGIONS` different regions (a short line that very many texts share) does not fit in a
  portion.  Its windows are hashed one by one (128 bits) and counted, which is exact too and spreads them over all tasks.
* The marked windows come back to all texts that hold the region, and the union of their bytes is cut out.

Cases: a null text is an empty one; texts shorter than `LENGTH` stay whole; a text of a single byte value loses all of it
if it is longer than `LENGTH`.  All copies of a text lose their common bytes, the first one included: repeated rows are
copies too.  Cutting is by bytes, so a cut may part a character.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from topicspark.llm.registry import query, table, text_of
from topicspark.llm.stages import Steps

LENGTH = 200
K = 32
HOT_REGIONS = 4_096
_PORTION = 200_000        # bytes whose suffix array is made at once, and bytes cut to regions at once: both fit in a cache
_BUFFER = 250_000
_END = 0xFF               # no byte of UTF-8
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(1 << 63)


# ---------------------------------------------------------------- suffix array and interval expansion

def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the `depth` bytes from there on (cyclic); equal strings in any order."""
    n = len(text)
    index = np.arange(n)
    key, h = text.astype(np.uint64), 1
    while h < 8 and h < depth:
        key = key << np.uint64(8 * h) | np.roll(key, -h)
        h *= 2
    order = np.argsort(key)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, index, 0))
    while h < depth:
        # only places that still share their rank with a neighbour are sorted further
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        places = order[slots]
        key = rank[places] * n + rank[(places + h) % n]
        again = np.argsort(key)
        places, key = places[again], key[again]
        order[slots] = places
        first = np.empty(len(slots), bool)
        first[0] = True
        first[1:] = key[1:] != key[:-1]
        new[slots] = first
        rank[places] = np.maximum.accumulate(np.where(first, slots, 0))
        h *= 2
    return order


def boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """Marks p if the suffixes p - 1 and p share fewer than `length` bytes, for suffixes p - 1 that have that many.

    Level by level the intervals of all strings without `_END` are extended by a byte in front; an interval whose right end
    is already marked is the interval of a shorter string as far as its right side goes, and is not followed.
    """
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int32)                        # where the suffix that is one byte longer stands
    to[by_byte] = np.arange(n, dtype=np.int32)
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    after = np.full(n, n, np.int32)                   # next and last place of the same byte
    after[by_byte[:-1][same]] = by_byte[1:][same]
    before = np.full(n, -1, np.int32)
    before[by_byte[1:][same]] = by_byte[:-1][same]
    mark = np.zeros(n + 1, bool)
    left, right = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(length):
        size = right - left + 1
        ends = np.cumsum(size)
        q = np.repeat(left - (ends - size), size) + np.arange(ends[-1])
        inside = bwt[q] != _END
        lasts = to[q[(after[q] > np.repeat(right, size)) & inside]]
        firsts = to[q[(before[q] < np.repeat(left, size)) & inside]]
        lasts.sort()                                  # intervals are disjoint: both ends come in the same order
        firsts.sort()
        fresh = ~mark[lasts + 1]
        left, right = firsts[fresh].astype(np.int64), lasts[fresh].astype(np.int64)
        mark[right + 1] = True
        if not len(left):
            break
    return mark


def repeated_windows(contents: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each content, whether the window from each of its places on occurs twice or more, counted with the weights."""
    text = np.frombuffer(b"".join(c + bytes([_END]) for c in contents), np.uint8)
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes + 1) - sizes - 1
    counts = np.maximum(sizes - length + 1, 0)
    weight = np.zeros(len(text), np.int64)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    weight[at] = np.repeat(np.array(weights, np.int64), counts)
    order = suffix_array(text, length)
    mark = boundaries(text[order - 1], length)
    group = np.cumsum(mark[:len(text)])
    total = np.bincount(group, weight[order])
    many = np.empty(len(text), bool)
    many[order] = total[group] >= 2
    return [many[s:s + c] for s, c in zip(starts.tolist(), counts.tolist())]


def runs_of(flags: np.ndarray) -> list[int]:
    """First and last place of each run of set flags, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


# ---------------------------------------------------------------- anchors and regions

def regions(texts: list[bytes], length: int = LENGTH, k: int = K) -> list[np.ndarray]:
    """Columns text, start, n (windows), anchor and hash of all regions; all texts together have at most 2 ** 24 bytes."""
    blob = b"".join(texts)
    data = np.frombuffer(blob, np.uint8)
    sizes = np.array([len(t) for t in texts])
    if len(data) < length:
        return [np.empty(0, t) for t in ("i8", "i8", "i8", "i8", "i8")]
    h, have = data.astype(np.uint64), 1
    while have < k:                                     # k is a power of two: hashes of 2, 4, 8 ... bytes
        h = (h[:-have] * _MULTIPLY ^ (h[:-have] >> np.uint64(29))) + h[have:] * np.uint64(0xD6E8FEB86659FD93)
        have *= 2
    h ^= h >> np.uint64(32)
    h *= _MULTIPLY
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 24) - 1)
    least = h & ~low | np.arange(len(h), dtype=np.uint64)     # ties go to the leftmost place
    span, have = length - k + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - length + 1, 0)
    start = np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    text = np.repeat(np.arange(len(texts)), counts)
    if not len(start):
        return [np.empty(0, "i8")] * 5
    place = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(text) != 0)]))
    n = np.diff(np.concatenate([first, [len(start)]]))
    begin = start[first]
    view = memoryview(blob)
    hashes = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), (begin + n - 1 + length).tolist())]
    own = text[first]
    return [own, begin - (ends - sizes)[own], n, h[place[first]].view(np.int64), np.array(hashes, np.uint64).view(np.int64)]


def portions(texts: list[str], most: int = _BUFFER) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, some at a time: the number of the first, and the texts."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def long_text_parts(raw: bytes, length: int, most: int = 8_000_000) -> list[tuple[int, bytes]]:
    """A very long text in parts that overlap by a window less one byte: every window lies in exactly one part."""
    return [(0, raw)] if len(raw) <= most else [(a, raw[a:a + most]) for a in range(0, len(raw) - length + 1, most - length + 1)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, text, row: rows with equal (id, h) have equal texts; `row` holds all columns of the input."""
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("h"),
                       text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))


def all_regions(rows: DataFrame, length: int) -> DataFrame:
    names = ["id", "h", "start", "n", "anchor", "region"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, raw in portions(batch.column(2).to_pylist()):
                parts = [(first + i, at, part) for i, t in enumerate(raw) for at, part in long_text_parts(t, length)]
                for group in ([parts] if len(parts) == len(raw) else [[p] for p in parts]):
                    number, shift = np.array([p[0] for p in group]), np.array([p[1] for p in group])
                    text, start, n, anchor, region = regions([p[2] for p in group], length)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                        ids[number[text]], hs[number[text]], (start + shift[text]).astype(np.int32), n.astype(np.int32), anchor,
                        region)], names)

    return rows.mapInArrow(run, "id bigint, h bigint, start int, n int, anchor bigint, region bigint")


def contents(rows: DataFrame, units: DataFrame, length: int) -> DataFrame:
    """anchor, region, weight, hot, content: the bytes of each unit, cut from the text that holds its first place."""
    by_text = units.groupBy("id", "h").agg(F.collect_list(F.struct("start", "n", "anchor", "region", "weight", "hot")).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                lists = part.column(1)
                fields = [f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten()]
                raw = [t.encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()]
                text = np.repeat(np.arange(len(raw)), lists.value_lengths().to_numpy())
                cut = [raw[t][s:s + n - 1 + length] for t, s, n in zip(text.tolist(), fields[0].tolist(), fields[1].tolist())]
                yield pa.RecordBatch.from_arrays([*map(pa.array, fields[2:]), pa.array(cut, pa.binary())],
                                                 ["anchor", "region", "weight", "hot", "content"])

    return rows.join(by_text, ["id", "h"]).select("text", "units").mapInArrow(
        run, "anchor bigint, region bigint, weight bigint, hot boolean, content binary")


def marked_by_transform(units: DataFrame, length: int) -> DataFrame:
    """anchor, region, runs of repeated windows (first, last, first, last ...), portion by portion of whole anchors."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([r[3] for r in rows], [r[2] for r in rows], length)
        runs = [(r[0], r[1], runs_of(f)) for r, f in zip(rows, flags) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in runs], pa.int64()), pa.array([x[1] for x in runs], pa.int64()),
                                           pa.array([x[2] for x in runs], pa.list_(pa.int32()))], ["anchor", "region", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] == last:          # the same unit, from a repeated row of its text
                    continue
                if size >= _PORTION and row[0] != last[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[:2]
        if rows:
            yield solve(rows)

    return (units.select("anchor", "region", "weight", "content").repartition("anchor").sortWithinPartitions("anchor", "region")
            .mapInArrow(run, "anchor bigint, region bigint, runs array<int>"))


def marked_by_count(units: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many regions, from a count of 128-bit window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "anchor", "region", "place", "weight"]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(row[3])
                digests = b"".join(xxhash.xxh3_128_digest(view[i:i + length]) for i in range(len(view) - length + 1))
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                n = len(pair)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair[:, 0], pair[:, 1], np.full(n, row[0]), np.full(n, row[1]),
                                                                       np.arange(n, dtype=np.int32), np.full(n, row[2]))], names)

    windows = units.dropDuplicates(["anchor", "region"]).select("anchor", "region", "weight", "content").mapInArrow(
        run, "w1 bigint, w2 bigint, anchor bigint, region bigint, place int, weight bigint")
    many = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2")
    return (windows.join(many, ["w1", "w2"]).groupBy("anchor", "region")
            .agg(F.flatten(F.collect_list(F.array("place", "place"))).alias("runs")))


def repeated_spans(steps: Steps, rows: DataFrame, length: int) -> DataFrame:
    """id, h, hits (start of a region, its runs of repeated windows)."""
    rows = rows.select("id", "h", "text")
    found = steps.save(all_regions(rows, length), "regions")
    # written before the join, which then reads two plain shuffles: adaptive execution can split a frequent anchor
    again = steps.save(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "again")
    found = steps.save(found.join(again, "anchor"), "recurring")
    steps.keep_only("recurring")
    units = (found.groupBy("anchor", "region").agg(F.count("*").alias("weight"), F.min(F.struct("id", "h", "start", "n")).alias("at"))
             .select("anchor", "region", "weight", "at.*"))
    units = steps.save(units, "units")
    hot = units.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > HOT_REGIONS).select("anchor", F.lit(True).alias("hot"))
    hot = steps.save(hot, "hot")
    units = units.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = steps.save(contents(rows, units, length), "contents")
    marked = marked_by_transform(cut.where("NOT hot"), length)
    if not hot.isEmpty():
        marked = marked.unionByName(marked_by_count(cut.where("hot"), length))
    marked = steps.save(marked, "marked")
    steps.keep_only("recurring", "marked")
    hits = found.select("id", "h", "start", "anchor", "region").join(marked, ["anchor", "region"])
    # a set: repeated rows of one id bring the same hits
    hits = steps.save(hits.groupBy("id", "h").agg(F.collect_set(F.struct("start", "runs")).alias("hits")), "hits")
    steps.keep_only("hits")
    return hits


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                    as_text: bool = False) -> DataFrame:
    """A row per row of `docs`: row (its other columns), n_bytes, kept (the remaining bytes), spans (maximal removed runs, start
    and end exclusive).  With `as_text` kept is a string, without the characters that a cut has parted.
    """
    steps = Steps(docs.sparkSession, "repeats")
    rows = keyed(docs, id_col, text_col)
    hits = repeated_spans(steps, rows, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                raw = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                # all hits of the texts, flat: ends alternate between first and last windows of runs
                starts, runs = part.column(2).flatten().flatten()
                sizes_of_runs = runs.value_lengths().to_numpy(zero_copy_only=False)
                ends = runs.flatten().to_numpy(zero_copy_only=False) + np.repeat(starts.to_numpy(zero_copy_only=False), sizes_of_runs)
                hits_of_texts = pc.fill_null(part.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False)
                bounds = np.append(0, np.cumsum(sizes_of_runs))[np.append(0, np.cumsum(hits_of_texts))].tolist()
                kept, begins, stops, n_spans = [], [], [], []
                for text, lo, hi in zip(raw, bounds, bounds[1:]):
                    if lo == hi:
                        kept.append(text)
                        n_spans.append(0)
                        continue
                    step = np.bincount(ends[lo:hi:2], minlength=len(text) + 1)
                    step -= np.bincount(ends[lo + 1:hi:2] + length, minlength=len(text) + 1)
                    gone = np.cumsum(step[:-1]) > 0
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                    edges = runs_of(gone)
                    begins += edges[::2]
                    stops += edges[1::2]
                    n_spans.append(len(edges) // 2)
                spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spans)).astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(begins, pa.int32()), pa.array(np.array(stops, np.int32) + np.int32(1))], ["start", "end"]))
                out = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), out, spans],
                                                 ["row", "n_bytes", "kept", "spans"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("spans", span)])
    return rows.join(hits, ["id", "h"], "left").select("row", "text", "hits").mapInArrow(run, schema)


@query("op1_repeats")
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
