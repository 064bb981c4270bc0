"""Hierarchical packing of documents into sequences of several lengths.

Within a task documents are tokenized and collected into pools of bounded size.  A document longer than the longest window
fills whole windows; what is left of it is routed to the smallest tier that holds it.  From the longest tier down, each rest
opens a window of its tier, and the gap is filled with rests of this and shorter tiers: the largest that fits, else a piece
cut from the smallest that does not.  What cannot fill a window of the shortest tier waits for the next pool; at the end of
a task it is cut into powers of two, so that no sequence needs padding.  The sequences of a pool are then dealt into step
groups of about equal tokens and attention cost.

Nothing is shuffled, and no state but the pool is held.  Sequence numbers are made of the task's partition and a counter: a
task that is run again on the same partition gives the same rows.

Cases: a null or empty text is one piece with the closing id alone; texts of any length are packed whole.  Equal texts and
repeated rows are packed row by row (rows with one id cannot be told apart by it).  An empty table gives no rows.  Other
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from topicspark.llm.registry import query, table
from topicspark.llm.words import WordIds, byte_alphabet, texts_of

TIERS = (2048, 1024, 512, 256)
POOL_TOKENS = 2_000_000
STEP_TOKENS = 65_536
_PIECES = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
           "sequence_tokens bigint, step_group bigint")

_stores: dict[str, WordIds] = {}   # one per worker process and vocabulary file


def word_store(path: str) -> WordIds:
    if path not in _stores:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        shown = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

        def pack(words: list[str]) -> list[bytes]:
            model = tokenizer.model
            return [array("I", [t.id for t in model.tokenize(w.encode("utf-8").decode("latin-1").translate(shown))]).tobytes()
                    for w in words]

        _stores[path] = WordIds(tokenizer, pack, spaced=False, lower=True)
    return _stores[path]


Piece = tuple[int, int, int]   # document of the pool, first id, number of ids


class Rests:
    """Pieces in order of length."""

    def __init__(self) -> None:
        self.sorted: list[tuple[int, int, int]] = []   # length, document, first id

    def add(self, piece: Piece) -> None:
        insort(self.sorted, (piece[2], piece[0], piece[1]))

    def largest(self, most: int) -> Piece | None:
        """Takes the largest piece of at most `most` ids."""
        at = bisect_right(self.sorted, (most, 1 << 62, 1 << 62))
        if not at:
            return None
        n, doc, start = self.sorted.pop(at - 1)
        return doc, start, n

    def cut(self, n: int) -> Piece | None:
        """Takes the first `n` ids of the shortest piece that is longer."""
        at = bisect_right(self.sorted, (n, 1 << 62, 1 << 62))
        if at == len(self.sorted):
            return None
        have, doc, start = self.sorted.pop(at)
        self.add((doc, start + n, have - n))
        return doc, start, n


def pack(lengths: list[int], tiers: tuple[int, ...], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences for documents of these lengths, and the pieces that wait (none if this pool is the last)."""
    top, sequences, rests, total = tiers[0], [], Rests(), 0
    order = []
    for doc, n in enumerate(lengths):
        whole = n - n % top
        sequences.extend([(doc, at, top)] for at in range(0, whole, top))
        if n > whole:
            order.append((n - whole, doc, whole))
            total += n - whole
    rests.sorted = sorted(order)
    def window(size: int) -> None:
        nonlocal total
        sequence, room = [], size
        while room:
            piece = rests.largest(room) or rests.cut(room)
            sequence.append(piece)
            room -= piece[2]
        sequences.append(sequence)
        total -= size

    for tier in tiers:
        least = tier // 2 if tier != tiers[-1] else 0      # shorter rests belong to the next tier
        while total >= tier and rests.sorted[-1][0] > least:
            window(tier)
    if last:
        size = tiers[-1]
        while total:
            while size > total:
                size //= 2
            window(size)
    return sequences, [(doc, start, n) for n, doc, start in rests.sorted]


def step_groups(sequences: list[list[Piece]], step_tokens: int) -> list[int]:
    """A group for each sequence: by tier and falling attention cost, dealt back and forth over the groups."""
    sizes = [sum(p[2] for p in s) for s in sequences]
    groups = max(1, round(sum(sizes) / step_tokens))
    order = sorted(range(len(sequences)), key=lambda i: (-sizes[i], -sum(p[2] ** 2 for p in sequences[i]), i))
    out = [0] * len(sequences)
    for k, i in enumerate(order):
        turn, place = divmod(k, groups)
        out[i] = place if turn % 2 == 0 else groups - 1 - place
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id",
                   text_col: str = "text", pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: document, place in it, crc of its ids, sequence, place there, size of the sequence, step group."""
    assert all(t > 0 and t & (t - 1) == 0 for t in tiers) and list(tiers) == sorted(tiers, reverse=True)
    closing = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_store(vocabulary)
        base = TaskContext.get().partitionId() << 33
        next_sequence = next_group = 0
        ids: list = []            # document id, packed ids still to place, first of them, length of the document
        held = 0

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal next_sequence, next_group, ids, held
            sequences, wait = pack([len(p) // 4 for _, p, _, _ in ids], tiers, last)
            groups = step_groups(sequences, step_tokens)
            rows = []
            for s, group in zip(sequences, groups):
                size, offset = sum(p[2] for p in s), 0
                for doc, start, n in s:
                    key, packed, first, total = ids[doc]
                    rows.append((key, first + start, n, zlib.crc32(packed[4 * start:4 * (start + n)]), total,
                                 base + next_sequence, offset, size, base + next_group + group))
                    offset += n
                next_sequence += 1
            next_group += max(groups, default=-1) + 1
            ids = [(ids[doc][0], ids[doc][1][4 * start:4 * (start + n)], ids[doc][2] + start, ids[doc][3]) for doc, start, n in wait]
            held = sum(n for _, _, n in wait)
            if not rows:
                return None
            keys, *numbers = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *[pa.array(c, pa.int64()) for c in numbers]],
                                              ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                                               "sequence_tokens", "step_group"])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                packed = store.packed(text) + closing
                ids.append((key, packed, 0, len(packed) // 4))
                held += len(packed) // 4
                if held >= pool_tokens and (out := emit(False)):
                    yield out
        if ids and (out := emit(True)):
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {_PIECES}").withColumnRenamed("id", id_col)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
