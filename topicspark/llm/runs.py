"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words whose smallest period q (words q apart are identical) repeats at least `MIN_EXPONENT`
times over at least `MIN_WORDS` words, and that no neighbouring word extends with period q.

The dictionary names the factors of 1, 2, 4, ... words of a text: the name of a factor is made of the names of its halves.
On a level of factors of f words the successor of a place is the next place of the same name.  In a run of period q <= f the
successor of its first factor lies exactly q on: a nearer one would give the run a smaller period.  So each level from
`FIRST_LEVEL` on proposes the distances up to 2 f that lower levels have not covered; neighbouring places of one distance form
an arithmetic progression, which is extended word by word to both sides, once.  A run has at least 24 words, room for a factor
of 16 and a period of up to 8, and three periods, room for the least power of two that is not below its period.  The first
level with successors is therefore 16; below it names are only put together.  A place without a successor on a level, that is
nobody's successor either, has none on higher levels.  Names are 64-bit mixes; extension compares the words themselves, so no
run is made up, and one is missed only if two of a text's names collide.

Texts are independent: every task takes the rows of its split, some millions of words of several texts at a time, and nothing
is shuffled.  A very long text is held with some 200 bytes per word.

Cases: null and empty texts have no words, no runs, and the digest of the empty string.  Repeated rows give equal rows.  Ties
between runs go to the smallest start, then the smallest period.  A null id is carried through (`op13_runs` leaves the words of
such a text as they are, since it has no decimal id).  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from topicspark.llm.registry import query, table, text_of

MIN_WORDS, MIN_EXPONENT = 24, 3
FIRST_LEVEL = 4                # factors of 16 words
_BATCH_WORDS = 1_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))   # fixed values: the finaliser of splitmix64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of factors from the names of their halves."""
    return _mixed(left * _STEP + right)


def _same_until(words: np.ndarray, at: int, period: int, end: int) -> int:
    """First place from `at` on whose word differs from the one `period` later; `end` - `period` if there is none."""
    stop, step = end - period, 64
    while at < stop:
        to = min(stop, at + step)
        differs = words[at:to] != words[at + period:to + period]
        if differs.any():
            return at + int(differs.argmax())
        at, step = to, step * 2
    return stop


def _same_from(words: np.ndarray, at: int, period: int, begin: int) -> int:
    """Smallest place down from `at` so that all words from it to `at` equal those `period` later."""
    step = 64
    while at > begin:
        to = max(begin, at - step)
        differs = words[to:at] != words[to + period:at + period]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, step = to, step * 2
    return begin


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sorted (start, length, period) of each text; text t holds words[bounds[t]:bounds[t + 1]], as numbers."""
    out: list[set[tuple[int, int, int]]] = [set() for _ in range(len(bounds) - 1)]
    longest = int(np.diff(bounds).max()) if len(bounds) > 1 else 0
    if longest < MIN_WORDS:
        return [[] for _ in out]
    names = _mixed(words.astype(np.uint64) + _STEP)
    for level in range(FIRST_LEVEL):
        half = 1 << level
        names = _paired(names[:-half], names[half:]) if len(names) > half else names[:0]
    factor = 1 << FIRST_LEVEL
    text = np.repeat(np.arange(len(out)), np.diff(bounds))
    ends = bounds[1:]
    place = np.arange(len(names))
    place = place[place + factor <= ends[text[place]]]
    names = _mixed(names[place] + text[place].astype(np.uint64) * _STEP)
    covered = 0                                           # distances up to here were proposed on lower levels
    while len(place):
        order = np.argsort(names, kind="stable")          # places rise within a name
        same = names[order[1:]] == names[order[:-1]]
        here, there = order[:-1][same], order[1:][same]
        distance = place[there] - place[here]
        near = (distance > covered) & (distance <= 2 * factor)
        at, period = place[here[near]], distance[near]
        if len(at):
            by_place = np.argsort(at, kind="stable")
            at, period = at[by_place], period[by_place]
            first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(period) != 0)))
            last = np.append(first[1:], len(at)) - 1
            for a, b, q in zip(at[first].tolist(), at[last].tolist(), period[first].tolist()):
                t = int(text[a])
                begin, end = int(bounds[t]), int(bounds[t + 1])
                start = _same_from(words, a, q, begin)
                length = _same_until(words, b + factor, q, end) + q - start
                if length >= max(MIN_WORDS, MIN_EXPONENT * q):
                    out[t].add((start - begin, length, q))
        covered = factor
        if 3 * factor >= longest:
            break
        # factors of twice the length, at the places that have an equal place on this level
        alive = np.zeros(len(place), bool)
        alive[here] = alive[there] = True
        where = np.full(len(words) + 1, -1, np.int64)
        where[place] = np.arange(len(place))
        kept = np.flatnonzero(alive & (place + 2 * factor <= ends[text[place]]))
        right = where[place[kept] + factor]
        both = (right >= 0) & alive[right]                # of two equal factors the second halves are equal too
        kept, right = kept[both], right[both]
        names = _paired(names[kept], names[right])
        place, factor = place[kept], 2 * factor
    return [sorted(runs) for runs in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Marks of the words that a run holds behind its first period."""
    out = np.zeros(n, bool)
    for start, length, period in runs:
        out[start + period:start + length] = True
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    ids = dict(zip(dict.fromkeys(words), range(len(words))))
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def made_periodic(words: list[bytes], h: int) -> list[bytes]:
    """The words with the planted repetition of the contract of `op13_runs`."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * -(-(n - a) // len(cycle)))[:n - a]


FIELDS = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
          ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
          ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())]
_SQL = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _row(words: list[bytes], runs: list[tuple[int, int, int]], whole: bool) -> tuple:
    best = strongest(runs)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    if runs:
        gone = dropped(runs, len(words))
        kept = b" ".join(w for w, d in zip(words, gone.tolist()) if not d)
    else:
        kept = b" ".join(words)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(words), len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
            [{"start": s, "length": n, "period": q} for s, n, q in runs] if whole else None,
            kept.decode("utf-8", "replace") if whole else None)


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True, planted: bool = False) -> DataFrame:
    """id, n_words, n_runs, start, length, period, exponent_milli (of the strongest run), runs_sha256, collapsed_sha256, and with
    `whole` all runs and the text without the repetitions.  With `planted` texts are first made periodic by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            parts = [numbered(words) for words in texts]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            found = find_runs(np.concatenate(parts) if parts else np.zeros(0, np.int64), bounds)
            rows = [_row(words, runs, whole) for words, runs in zip(texts, found)]
            columns = [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), FIELDS)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], ["id", *(name for name, _ in FIELDS)])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row_id, crc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()                      # bytes part at \x20 and \x09-\x0D
                if crc is not None:
                    words = made_periodic(words, crc)
                ids.append(row_id)
                texts.append(words)
                held += len(words) + 100
                if held >= _BATCH_WORDS:
                    yield emit()
                    ids, texts, held = [], [], 0
        if ids:
            yield emit()

    kind = docs.schema[id_col].dataType.simpleString()
    crc = F.crc32(F.col(id_col).cast("string").cast("binary")) if planted else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), crc.alias("crc"), text_of(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, {_SQL}").withColumnRenamed("id", id_col)
    return out if whole else out.drop("runs", "collapsed")


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs(table(spark, sf_dir, "documents"), whole=False, planted=True)
