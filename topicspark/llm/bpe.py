"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its encoding.  It is found from the tokens that are
suffixes of the prefix (listed by a suffix-matching automaton): the right one is the token that covers the whole prefix, or
that may stand after the last token of the prefix before it.  Two tokens may be neighbours if no merge across their border
comes before the merges that use up the parts at the border.  Following the last tokens back from the end gives the ids,
in time linear in the word.

Cases: a null text is an empty one and has no ids; words of any length are encoded without a table of the whole text; equal
texts and repeated rows are encoded row by row; an empty table gives no rows.  The strings of the vocabulary's added tokens
become their ids, as the library does by default.  Other columns of the input are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from topicspark.llm.registry import query, table
from topicspark.llm.words import WordIds, byte_alphabet, texts_of

_FOREVER = 1 << 40
_MOST_PAIRS = 1_500_000


class PrefixEncoder:
    """Last tokens of all prefixes of a word, for a byte-level vocabulary with ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        ids = model["vocab"]
        self.token = {i: bytes(to_byte[c] for c in t) for t, i in ids.items()}
        self.rank: dict[int, dict[int, int]] = {}    # left part: right part: rank of their merge
        made: dict[int, tuple[int, int, int]] = {}   # token: its parts and the rank that joins them
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank.setdefault(left, {}).setdefault(right, r)
            made.setdefault(whole, (left, right, r))
        self.right = {t: self._border(t, made, 1) for t in self.token}
        self.left = {t: self._border(t, made, 0) for t in self.token}
        self.suffixes = ahocorasick.Automaton()
        for t, text in self.token.items():
            if len(text) == 1 or t in made:
                self.suffixes.add_word(text.decode("latin-1"), (len(text), t))
        self.suffixes.make_automaton()
        self._fits: dict[int, bool] = {}

    @staticmethod
    def _border(t: int, made: dict, side: int) -> list[tuple[int, int]]:
        """The parts of a token that touch its border over time, each with the rank of the merge that uses it up."""
        out, until = [(t, _FOREVER)], _FOREVER
        while t in made:
            t, until = made[t][side], made[t][2]
            out.append((t, until))
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes keeps the border between them."""
        for x, x_until in self.right[a]:
            ranks = self.rank.get(x)
            if ranks:
                for y, y_until in self.left[b]:
                    r = ranks.get(y)
                    # equal ranks: the leftmost of equal pairs is merged first
                    if r is not None and r < x_until and r <= y_until:
                        return False
        return True

    def ids(self, word: bytes) -> list[int]:
        n = len(word)
        last, size = [0] * (n + 1), [0] * (n + 1)
        known, solved = self._fits, 0
        for end, (length, t) in self.suffixes.iter(word.decode("latin-1")):
            end += 1
            if end == solved:
                continue
            if length != end:
                before = last[end - length]
                key = before << 20 | t
                fit = known.get(key)
                if fit is None:
                    fit = known[key] = self.fits(before, t)
                if not fit:
                    continue
            last[end], size[end], solved = t, length, end
        if len(known) > _MOST_PAIRS:
            known.clear()
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]


_encoders: dict[str, tuple[PrefixEncoder, WordIds, Decoder]] = {}   # one per worker process and vocabulary file


def encoder(path: str) -> tuple[PrefixEncoder, WordIds, Decoder]:
    if path not in _encoders:
        prefix = PrefixEncoder(path)
        pack = lambda words: [array("I", prefix.ids(w.encode("utf-8"))).tobytes() for w in words]
        words = WordIds(Tokenizer.from_file(path), pack, spaced=True, lower=False)
        marks = {int.from_bytes(i, "little"): t.encode() for t, i in words.special.items()}
        _encoders[path] = prefix, words, Decoder(prefix.token | marks)
    return _encoders[path]


class Decoder:
    """Texts of packed ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""

    def __init__(self, token: dict[int, bytes]):
        known = [token.get(i, b"") for i in range(max(token) + 2)]      # the last one stands for unknown ids
        self.length = np.array([len(t) for t in known], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(known), np.uint8)

    def texts(self, packed: list[bytes]) -> list[str]:
        ids = np.minimum(np.frombuffer(b"".join(packed), "<u4"), len(self.length) - 1)
        size = self.length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.bytes[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0] + [len(p) // 4 for p in packed])].tolist()
        return [out[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id, ids (packed little-endian unsigned 32-bit integers), and with `decode` the text those ids give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, decoder = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [words.packed(t) for t in texts_of(part.column(1))]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(decoder.texts(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids binary" + (", decoded string" if decode else ""))
    return out.withColumnRenamed("id", id_col)


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
