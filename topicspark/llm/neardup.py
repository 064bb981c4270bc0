"""Near-duplicate documents by HyperMinHash over 5-word shingles.

Texts with the same shingle set form a class and go on as one.  A sketch has a register per hash function: the leading-zero
count and ten mantissa bits of the least hash.  Bands of four registers are the keys under which classes meet; a pair at the threshold
shares no key with a probability of 1e-8.  Every class is compared with the leader of each of its keys, the class that meets the
most others: a pair is dropped if its collision-corrected estimate is far below the threshold, and linked if its full shingle
sets reach it.  What leaders do not connect is compared exactly:

* Classes whose estimates tie them to common leaders (`NEAR`, loosely) form a group.  If its members are in several components,
  all that are not in the largest one are compared with all others, block against block inside tasks: one matrix product gives
  the sizes of all intersections, and only as many links leave the task as join components.
* Classes that share a key with a leader they are not near to are few; their sketches are compared with all others under that
  key inside tasks, and the hopeful pairs in full.

Very many copies of one text are one class.  Very many near copies are linked through their leader: pairs grow with the members,
not with their square.

Cases: A-Z are lower-cased, words are parted by the six ASCII white-space characters.  Fewer than five words are one shingle;
null texts and texts without words have none and are linked with nothing.  Equal texts, and repeated rows, are in one
component.  Different texts of one id are compared like those of different ids: a row is in the component of its text, which is
named by the smallest id in it, and rows of that id are kept; two components have one name if that id has texts in both.
Rows with a null id are compared like all others, so documents that are linked only through them are in one component, but they
name none: their own component_id is null, and they are kept.  An empty table gives no rows.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicspark.llm.components import components
from topicspark.llm.registry import query, table, text_of
from topicspark.llm.stages import Steps

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100          # likeness asked for
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
ESTIMATE_SLACK = 0.2                      # six standard deviations of the estimate at the threshold
NEAR = 0.45                               # estimate to a leader from which classes form a group
BLOCK_SHINGLES = 400_000                  # of a block of classes that is compared with another in one task
BLOCK_CLASSES = 10_000                    # of one key
_COLUMNS = 4_096
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))   # fixed values: the finaliser of splitmix64


def _mixed(z: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), _MIX):
        z = (z ^ (z >> np.uint64(shift))) * factor
    return z ^ (z >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, REGISTERS, np.uint64)


class Shingler:
    """Hashed shingle sets; the hashes of words are kept between texts."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()      # of bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        get, known = self.known.get, self.known
        hashes = [get(w) for w in words]
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        h = np.array(hashes, np.uint64)
        n = len(h) - WORDS + 1
        out = h[:n].copy()
        for k in range(1, WORDS):
            out = _mixed(out) * _MULTIPLY + h[k:n + k]
        return np.unique(_mixed(out))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 16-bit registers: leading zeros of the least hash, then its next bits.  No set may be empty."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= 8_000:      # what stays in the cache
            size += len(sets[to])
            to += 1
        h = np.concatenate(sets[at:to])
        starts = np.cumsum([0] + [len(s) for s in sets[at:to - 1]])
        least = np.empty((to - at, REGISTERS), np.uint64)
        for k in range(REGISTERS):
            # the high half of a product is well mixed; the low half is folded in
            z = h * _FACTORS[k] + _OFFSETS[k]
            z ^= z >> np.uint64(32)
            z *= _MULTIPLY
            least[:, k] = np.minimum.reduceat(z, starts)
        top = np.frexp(np.maximum(least, 1).astype(np.float64))[1]     # bits in use; rounding up is the same for equal hashes
        zeros = 64 - top
        rest = (least << zeros.clip(0, 63).astype(np.uint64)) >> np.uint64(64 - 1 - MANTISSA)
        out[at:to] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | rest & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
        at = to
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b):
    """Likeness from equal registers, less those that two unlike sets of these sizes would share by chance; by rows."""
    chance = n_a * n_b / (n_a + n_b) ** 2 * 0.7213 / (1 << MANTISSA)
    return (np.mean(a == b, axis=-1) - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets reach the likeness asked for."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def text_key(text_col: str) -> Column:
    """Tells the texts of one id apart, a missing one from an empty one too."""
    return F.coalesce(F.unhex(F.sha2(text_col, 256)), F.lit(b""))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, set_key (hash of the whole set; null without shingles), registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                rows = iter(registers(full)) if full else iter(())
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                regs = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array(keys, pa.binary()), pa.array(regs, pa.binary())],
                                                 ["id", "text_key", "n_shingles", "set_key", "registers"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text")).mapInArrow(
        run, "id bigint, text_key binary, n_shingles bigint, set_key binary, registers binary")


def _of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The `rows` (rep, text_key, ...) that hold the text of a class (id, rep, text_key); of those with a null id one of each text."""
    # null ids meet by text alone and are thinned first: they may be many under one key
    nameless = rows.where("rep IS NULL").drop("rep").dropDuplicates(["text_key"])
    return (rows.join(classes, ["rep", "text_key"]).drop("rep")
            .unionByName(nameless.join(classes.where("rep IS NULL").drop("rep"), "text_key")))


def full_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, shingles (packed) of `classes` (id, rep, text_key): the class's number, and a document and text of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text"))
    return _of_classes(rows, classes).select("id", "text").mapInArrow(run, "id bigint, shingles binary")


def estimated(pairs: DataFrame, regs: DataFrame) -> DataFrame:
    """The pairs (a, b) with `est`, the estimate of their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "u2").reshape(-1, REGISTERS) for i in (2, 3))
                na, nb = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimate(ra, rb, na, nb))], ["a", "b", "est"])

    one = regs.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    two = regs.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb", "na", "nb")
            .mapInArrow(run, "a bigint, b bigint, est double"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"))
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))],
                                             ["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return full.mapInArrow(run, "a bigint, b bigint")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of membership matrices."""
    values, column = np.unique(np.concatenate(left + right), return_inverse=True)
    sizes = np.array([len(x) for x in left + right])
    row = np.repeat(np.arange(len(sizes)), sizes)
    cut = int(sizes[:len(left)].sum())
    both = (np.bincount(column[:cut], minlength=len(values)) > 0) & (np.bincount(column[cut:], minlength=len(values)) > 0)
    number = np.cumsum(both) - 1
    row, column = row[both[column]], number[column[both[column]]]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(both.sum()), _COLUMNS):
        here = (column >= at) & (column < at + _COLUMNS)
        m = np.zeros((len(sizes), _COLUMNS), np.float32)
        m[row[here], column[here] - at] = 1
        out += m[:len(left)] @ m[len(left):].T
    return out


def joining_links(ids: list[int], roots: list[int], sets: list[np.ndarray], left: list[bool]) -> list[tuple[int, int]]:
    """Links between sets on the left and all others that join different roots: as many as it takes, no more."""
    mine = [i for i, x in enumerate(left) if x]
    rest = [i for i, x in enumerate(left) if not x]
    if not mine or not rest:
        return []
    sizes, root = np.array([len(x) for x in sets]), np.array(roots)
    both = intersections([sets[i] for i in mine], [sets[i] for i in rest])
    found = DENOMINATOR * both >= NUMERATOR * (sizes[mine][:, None] + sizes[rest][None, :] - both)
    found &= root[mine][:, None] != root[rest][None, :]
    x, y = np.nonzero(found)
    pairs, first = np.unique(np.stack([root[mine][x], root[rest][y]]), axis=1, return_index=True)
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while parent.setdefault(r, r) != r:
            r = parent[r]
        return r

    out = []
    for r, q, k in zip(*pairs.tolist(), first.tolist()):
        r, q = top(r), top(q)
        if r != q:
            parent[max(r, q)] = min(r, q)
            out.append((ids[mine[x[k]]], ids[rest[y[k]]]))
    return out


def links_in_groups(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of one group.  `members(group, id, root, n)`.

    In each group the members outside its largest component are dealt to blocks, and all members to blocks of the other side; a
    task takes a pair of blocks.  Blocks have about equal numbers of shingles, whatever the size of the group.
    """
    roots = members.groupBy("group", "root").agg(F.sum("n").alias("n"))
    largest = roots.groupBy("group").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all_n"), F.count("*").alias("roots"))
    mixed = largest.where("roots > 1").select(
        "group", F.col("top.root").alias("top"), F.ceil(F.col("all_n") / BLOCK_SHINGLES).cast("int").alias("rights"),
        F.ceil((F.col("all_n") - F.col("top.n")) / BLOCK_SHINGLES).cast("int").alias("lefts"))
    rows = members.join(mixed, "group")
    own = F.xxhash64("id")
    as_left = rows.where("root <> top").select(
        "group", "id", "root", F.lit(True).alias("left"), F.pmod(own, F.col("lefts")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    as_right = rows.select(
        "group", "id", "root", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"),
        F.pmod(own, F.col("rights")).cast("int").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            links = joining_links([r[3] for r in rows], [r[4] for r in rows], [np.frombuffer(r[6], "u8") for r in rows], [r[5] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now and held:
                    yield solve(held)
                    held = []
                now = row[:3]
                held.append(row)
        if held:
            yield solve(held)

    full = as_left.unionByName(as_right).join(sets.select("id", "shingles"), "id")
    return (full.select("group", "i", "j", "id", "root", "left", "shingles").repartition("group", "i", "j")
            .sortWithinPartitions("group", "i", "j").mapInArrow(run, "a bigint, b bigint"))


def hopeful_under_keys(members: DataFrame, regs: DataFrame) -> DataFrame:
    """Pairs (a, b) of a far class and any other under one key, of different components, whose estimate gives hope.

    `members(key, id, far, root, fars, n)`.  The classes under a key are dealt to blocks of a bounded number; a task compares the
    registers of two blocks, and only hopeful pairs leave it.
    """
    own = F.xxhash64("id")
    rights, lefts = (F.ceil(F.col(c) / BLOCK_CLASSES).cast("int") for c in ("n", "fars"))
    cols = ["key", "id", "root", "far"]
    as_left = members.where("far").select(*cols, F.lit(True).alias("left"), F.pmod(own, lefts).cast("int").alias("i"),
                                          F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"))
    as_right = members.select(*cols, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"),
                              F.pmod(own, rights).cast("int").alias("j"))
    least = NUMERATOR / DENOMINATOR - ESTIMATE_SLACK

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        ids, roots, n = (np.array([r[k] for r in rows]) for k in (3, 4, 7))
        registers_ = np.frombuffer(b"".join(r[6] for r in rows), "u2").reshape(-1, REGISTERS)
        left = np.array([r[5] for r in rows])
        rest, out = np.flatnonzero(~left), []
        for i in np.flatnonzero(left):
            like = ((roots[rest] != roots[i]) & (n[rest] * NUMERATOR <= n[i] * DENOMINATOR) & (n[i] * NUMERATOR <= n[rest] * DENOMINATOR))
            near = rest[like]
            near = near[estimate(registers_[near], registers_[i], n[near].astype(float), float(n[i])) >= least]
            out.extend((max(ids[i], ids[j]), min(ids[i], ids[j])) for j in near)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now and held:
                    yield solve(held)
                    held = []
                now = row[:3]
                held.append(row)
        if held:
            yield solve(held)

    full = as_left.unionByName(as_right).join(regs.select("id", "registers", "n_shingles"), "id")
    return (full.select("key", "i", "j", "id", "root", "left", "registers", "n_shingles").repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct())


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))


def _components(steps: Steps, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, part, component_id: one row per row of `docs`.

    `part` numbers the component, and is null for a null id or without shingles; `component_id` is the smallest id in it.
    """
    table_ = steps.save(sketches(docs, id_col, text_col), "sketches")
    classes = steps.save(table_.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key")).alias("at"))
        .select("set_key", F.col("at.id").alias("rep"), "at.text_key"), "sets-of-texts")
    # numbers in the order of the smallest ids, classes without one last, so that the root of a component has its smallest id;
    # an id may have several classes
    order = [F.col("rep").asc_nulls_last(), F.col("set_key")]
    classes = steps.save(classes.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select(F.monotonically_increasing_id().alias("number"), "set_key", "rep", "text_key"), "classes")

    # one row per class and band
    regs = (_of_classes(table_.where("set_key IS NOT NULL").withColumnRenamed("id", "rep"),
                        classes.select(F.col("number").alias("id"), "rep", "text_key"))
            .select("id", "n_shingles", "registers").dropDuplicates(["id"]))
    regs = steps.save(regs, "registers")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda k: F.xxhash64(k, F.substring("registers", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = regs.select("id", F.explode(band).alias("key"))
    met = steps.save(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    shared = steps.save(bands.join(met, "key"), "meetings")              # key, id, n: only keys that classes share
    # the class that meets the most others leads
    weight = steps.save(shared.groupBy("id").agg(F.sum("n").alias("w")), "weights")
    led = shared.select("key", "id").join(weight, "id")
    leaders = steps.save(led.groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("x"))
                         .select("key", (-F.col("x.m")).alias("leader")), "leaders")
    shared = steps.save(shared.select("key", "id").join(leaders, "key"), "shared")
    star = shared.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    star = steps.save(estimated(star, regs), "star")

    wanted = classes.select(F.col("number").alias("id"), "rep", "text_key").join(weight.select("id"), "id")
    sets = steps.save(full_sets(docs, wanted, id_col, text_col).dropDuplicates(["id"]), "sets")
    hopeful = star.where(F.col("est") >= NUMERATOR / DENOMINATOR - ESTIMATE_SLACK)
    best = hopeful.groupBy("a").agg(F.max_by("b", F.struct("est", (-F.col("b")).alias("m"))).alias("b"))
    labels = components(steps, steps.save(confirmed(best, sets), "links-1"), "one")
    rest = steps.save(_apart(hopeful, labels), "star-rest")
    if not rest.isEmpty():
        labels = components(steps, steps.save(confirmed(rest, sets), "links-2"), "two", labels)

    # classes near to common leaders that are in several components
    sized = regs.select("id", F.col("n_shingles").alias("n"))
    groups = components(steps, star.where(F.col("est") >= NEAR).select("a", "b"), "near")
    members = (groups.select(F.col("node").alias("id"), F.col("root").alias("group"))
               .join(labels.select(F.col("node").alias("id"), "root"), "id", "left").join(sized, "id")
               .select("group", "id", F.coalesce("root", "id").alias("root"), "n"))
    members = steps.save(members, "members")
    links = steps.save(links_in_groups(members, sets), "links-3")
    if not links.isEmpty():
        labels = components(steps, links, "three", labels)

    # classes that share a key with a leader they are not near to, with all others under that key
    at = (shared.join(star.select(F.col("a").alias("id"), F.col("b").alias("leader"), "est"), ["id", "leader"], "left")
          .select("key", "id", (F.coalesce("est", F.lit(1.0)) < NEAR).alias("far")))
    keys = steps.save(at.groupBy("key").agg(F.count_if("far").alias("fars"), F.count("*").alias("n")).where("fars > 0"), "far-keys")
    at = at.join(keys, "key").join(labels.select(F.col("node").alias("id"), "root"), "id", "left")
    pairs = steps.save(hopeful_under_keys(at.withColumn("root", F.coalesce("root", "id")), regs), "hopeful-pairs")
    if not pairs.isEmpty():
        labels = components(steps, steps.save(confirmed(pairs, sets), "links-4"), "four", labels)

    named = classes.join(labels, F.col("number") == F.col("node"), "left").select("set_key", F.coalesce("root", "number").alias("part"))
    named = steps.save(named.join(classes.select(F.col("number").alias("part"), F.col("rep").alias("component_id")), "part"), "named")
    steps.keep_only("sketches", "named")
    out = table_.select("id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = F.col("set_key").isNull() | F.col("id").isNull()
    return out.select("id", "text_key", "n_shingles", F.when(~alone, F.col("part")).alias("part"),
                      F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _kept() -> Column:
    return F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (null for a null id), kept: one row per row of `docs`."""
    found = _components(Steps(docs.sparkSession, "neardup"), docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", _kept().alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one document of each component.

    Of equal rows one stays; rows that are in no component, without an id or without words, stay, one of each id and text.
    """
    steps = Steps(docs.sparkSession, "neardup")
    found = _components(steps, docs, id_col, text_col).where(_kept())
    # several texts of the smallest id may be in one component
    alone = F.when(F.col("part").isNull(), F.col("text_key"))
    stay = found.groupBy("id", "part", alone.alias("alone")).agg(F.min("text_key").alias("text_key"))
    # a null id is a value like any other: the keys of the join are never null
    keys = ["known", "number", "text_key"]
    known, number = F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("number")
    packed = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select(known, number, "text_key", "row").join(stay.select(known, number, "text_key"), keys, "left_semi")
    return rows.dropDuplicates(keys).select("row.*")


_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
rare AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
      WHERE a.s IN (SELECT s FROM rare) GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, w.doc_id = c.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)"""


@query("op7_near_dedup", _SQL)
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
