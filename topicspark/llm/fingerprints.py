"""Document fingerprints by consistent weighted sampling.

The weighted terms of a text are its lower-cased words, as white space parts them, and their counts.  For each of `samples` hash functions every term
draws r and c from Gamma(2, 1) and beta from (0, 1), all from a hash of the term and the number of the function; with
t = floor(ln(weight) / r + beta) the term of least ln(c) - r (t - beta + 1) is the sample, together with its t.  Two texts
agree in a sample with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima.

The draws are made once per distinct (term, weight) of a batch, by a 64-bit mix and inverse distribution tables; a text's
samples are the minima over its rows.  `with_next` compares each text with its successor: texts are dealt by ranges of (id, hash
of the text), a range to a task, and streamed in order; the first text of a range also goes to the range before it, so no window
over all rows is needed and rows of one id need not meet.  Equal rows are counted before they travel.

Cases: null and empty texts have no terms; they have the empty fingerprint, which is like itself (1) and unlike any other (0).
Equal texts have equal fingerprints.  Equal ids follow each other in order of the hashes of their texts, equal rows next to each other.  A single document is its own
successor; an empty table gives no rows.  Null ids come before all others.  Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from topicspark.llm.registry import query, table, text_of

SAMPLES = 64
EMPTY = 0xFFFFFFFF    # the bits of no number
_TABLE_BITS = 16
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))   # fixed values: the finaliser of splitmix64
_STEP = 0x9E3779B97F4A7C15
_DOCS_PER_RANGE, _MOST_RANGES = 4_000, 1_000_000   # the starts of all ranges, two numbers each, are sent to the driver
_BATCH_TEXTS, _BATCH_CHARS = 1_000, 3_000_000


@cache
def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1): the x with 1 - (1 + x) exp(-x) = u, by Newton steps on the logarithm."""
    n = 1 << _TABLE_BITS
    u = (np.arange(n) + 0.5) / n
    x = np.where(u < 0.5, np.sqrt(2 * u), 2 - 2 * np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4)
    return x


class Words:
    """Numbers of the words of a batch of texts."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def numbers(self, text: str) -> list[int]:
        ids = self.ids
        return [ids.setdefault(w, len(ids)) for w in text.lower().split()]

    def after_edit(self, text: str, own: list[int], following: str) -> list[int]:
        """Numbers of edited(text, following), without splitting again what the edit keeps; `own` are those of the text."""
        n = len(text) // 4
        kept = text[:len(text) - n]
        whole = kept.split()
        if whole and not kept[-1].isspace():      # the last word may go on behind the cut
            return own[:len(whole) - 1] + self.numbers(whole[-1] + following[:n])
        return own[:len(whole)] + self.numbers(following[:n])


class Sampler:
    def __init__(self, samples: int):
        gamma = _gamma_table()
        self.samples = samples
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.inverse_r = (1 / gamma).astype(np.float32)
        self.step = np.array([(i + 1) * _STEP % (1 << 64) for i in range(samples)], np.uint64)

    def draws(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """ln(a) of every (term, weight) and sample; one value for one (term, t), whatever the weight behind t."""
        z = hashes[:, None] + self.step
        for shift, factor in zip((30, 27), _MIX):
            z ^= z >> np.uint64(shift)
            z *= factor
        z ^= z >> np.uint64(31)
        i = (z & np.uint64(0xFFFF)).astype(np.intp)
        log_c = self.log_c[((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)]
        beta = ((z >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24)
        t = np.floor(np.log(weights).astype(np.float32)[:, None] * self.inverse_r[i] + beta)
        return log_c - self.r[i] * (t - beta + 1)

    def signatures(self, texts: list[str]) -> np.ndarray:
        words = Words()
        return self.sampled(words, [words.numbers(t) for t in texts])

    def sampled(self, words: Words, texts: list[list[int]]) -> np.ndarray:
        """Rows of `samples` codes: the bits of the least ln(a), which stand for its (term, t); EMPTY without terms."""
        ids = words.ids
        terms, counts, sizes = [], [], []
        for text in texts:
            found = Counter(text)
            terms.extend(found)
            counts.extend(found.values())
            sizes.append(len(found))
        out = np.full((len(texts), self.samples), EMPTY, np.uint32)
        if not ids:
            return out
        hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids], np.uint64)
        pairs, place = np.unique(np.array(terms, np.int64) << 32 | np.array(counts, np.int64), return_inverse=True)
        hashes, weight = hashes[pairs >> 32], (pairs & 0xFFFFFFFF).astype(np.float64)
        log_a = np.empty((len(pairs), self.samples), np.float32)
        for at in range(0, len(pairs), 4096):
            part = slice(at, at + 4096)
            log_a[part] = self.draws(hashes[part], weight[part])
        sizes = np.array(sizes)
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        ends = starts + sizes[full]
        at = 0
        while at < len(full):          # some texts at a time, at least one
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + 20_000, "right")))
            rows = log_a[place[starts[at]:ends[to - 1]]]
            out[full[at:to]] = np.minimum.reduceat(rows, starts[at:to] - starts[at], axis=0).view(np.uint32)
            at = to
        return out


def as_string(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode() if signature[0] != EMPTY else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; texts without terms are like each other only."""
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (base64 of the sample codes; empty without terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                signs = sampler.signatures(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(as_string, signs), pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")
            .withColumnRenamed("id", id_col))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def range_starts(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Smallest (id, h) of each of about `ranges` ranges of equally many rows: two numbers for each range."""
    parts = keys.repartitionByRange(ranges, "id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "h")).alias("at"))
    return sorted((r["at"]["id"], r["at"]["h"]) for r in parts.collect() if r["at"] is not None)


def parts_of(ids: np.ndarray, hashes: np.ndarray, bound_ids: np.ndarray, bound_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range that holds each (id, h), and whether it is the start of that range."""
    low, high = np.searchsorted(bound_ids, ids, "left"), np.searchsorted(bound_ids, ids, "right")
    part = low.copy()                                   # starts before (id, h), itself included
    one = np.flatnonzero(high - low == 1)
    part[one] += bound_hashes[low[one]] <= hashes[one]
    many = np.flatnonzero(high - low > 1)               # ids that several ranges share
    for at in np.unique(low[many]):
        own = many[low[many] == at]
        part[own] += np.searchsorted(bound_hashes[at:high[own[0]]], hashes[own], "right")
    part = np.maximum(part - 1, 0)
    return part, (bound_ids[part] == ids) & (bound_hashes[part] == hashes)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, guest, id, h, copies, text) with a part per partition, in order; the first row after a part follows as a guest.

    Equal rows of a batch travel as one row with the number of its copies, and an id may lie in several parts.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text")
    starts = range_starts(rows.select("id", "h"), min(_MOST_RANGES, max(1, -(-docs.count() // _DOCS_PER_RANGE))))
    bound_ids, bound_hashes = (np.array(x, np.int64) for x in (zip(*starts) if starts else ([0], [0])))
    names = ["part", "guest", "id", "h", "copies", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            key = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            if (key[1:] == key[:-1]).any():
                rows = rows.group_by(["id", "h", "text"]).aggregate([([], "count_all")]).select(["id", "h", "text", "count_all"])
            else:
                rows = rows.append_column("count_all", pa.array(np.ones(len(rows), np.int64)))
            part, first = parts_of(rows["id"].to_numpy(), rows["h"].to_numpy(), bound_ids, bound_hashes)

            def sent(chosen: pa.Table, to: np.ndarray, guest: bool) -> list[pa.RecordBatch]:
                return pa.table([pa.array(to), pa.array(np.full(len(to), guest)), chosen["id"], chosen["h"], chosen["count_all"],
                                 chosen["text"]], names).to_batches()

            yield from sent(rows, part, False)
            at = np.flatnonzero(first)
            if len(at):
                yield from sent(rows.take(pa.array(at)), (part[at] - 1) % len(bound_ids), True)

    dealt = rows.mapInArrow(deal, "part bigint, guest boolean, id bigint, h bigint, copies bigint, text string")
    return (dealt.repartitionById(len(bound_ids), F.col("part").cast("int"))
            .sortWithinPartitions("part", "guest", "id", "h", "text"))


def with_next(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        waiting: list[tuple[int, str, int]] = []  # texts of one part and their copies, in order; the last has no successor yet
        held = 0
        part = None
        done = False                              # the guest of this part has come

        def emit(following: list[str]) -> pa.RecordBatch:
            """Rows of all waiting texts that have a successor; the texts in `following` are only looked at."""
            texts = [t for _, t, _ in waiting] + following[:1]
            last = len(texts) - 1
            # a text follows itself, all its copies but one, and then the next text follows
            pairs = [(j, k, c) for j in range(last) for k, c in ((j, waiting[j][2] - 1), (j + 1, 1)) if c]
            edits = [edited(texts[j], texts[k]) for j, k, _ in pairs]
            words = Words()
            numbers = [words.numbers(t) for t in texts]
            changes = [words.after_edit(texts[j], numbers[j], texts[k]) for j, k, _ in pairs]
            signs = sampler.sampled(words, numbers + changes)
            plain, changed = signs[:len(texts)], signs[len(texts):]
            signed = [as_string(s) for s in plain[:last]]
            return pa.RecordBatch.from_arrays([
                pa.array([waiting[j][0] for j, _, _ in pairs], pa.int64()), pa.array([len(texts[j]) for j, _, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits], pa.string()),
                pa.array([signed[j] for j, _, _ in pairs], pa.string()), pa.array([as_string(s) for s in changed], pa.string()),
                pa.array([likeness(plain[j], x) for (j, _, _), x in zip(pairs, changed)], pa.float64()),
                pa.array([likeness(plain[j], plain[k]) for j, k, _ in pairs], pa.float64()),
                pa.array([c for _, _, c in pairs], pa.int64())],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"])

        for batch in batches:
            for p, guest, i, _, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, done, waiting, held = p, False, [], 0
                if guest:
                    if not done:
                        yield emit([text])
                        done, waiting, held = True, [], 0
                    continue
                if waiting and waiting[-1][:2] == (i, text):
                    waiting[-1] = (i, text, waiting[-1][2] + copies)
                    continue
                waiting.append((i, text, copies))
                held += len(text)
                if len(waiting) > _BATCH_TEXTS or len(waiting) > 1 and held > _BATCH_CHARS:
                    yield emit([])
                    waiting, held = waiting[-1:], len(text)

    out = in_order(docs, id_col, text_col).mapInArrow(
        run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, copies bigint")
    # copies are written out in two steps, so that no list is longer than the root of their number
    root = F.ceil(F.sqrt("copies")).cast("long")
    out = out.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / root))))
    out = out.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(root, F.col("copies") - F.col("_run") * root))))
    null_id = F.when(F.col("id") != -(1 << 63), F.col("id"))
    return out.drop("copies", "_run", "_one").withColumn("id", null_id).withColumnRenamed("id", id_col)


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
