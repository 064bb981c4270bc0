"""Quality classifier: a small byte-level convolutional network in numpy.

The UTF-8 bytes of a text are cut into overlapping chunks that cover all of it.  Each byte has a learned embedding and one
mark that says whether the bytes up to it have stood in the text before; learned filters run over a chunk, each filter's
largest response is kept (max-pooling), and a linear layer makes one number per chunk.  The mean over all chunks, through a
sigmoid, is the probability of label 1.

Bound: the network is fitted on the driver on at most `MAX_TRAIN` labelled rows, those whose hashed ids come first, and of
these on those that fit into `MAX_TRAIN_BYTES` of text in all, in that order; it learns from every chunk of their texts.
Scoring reads every byte of every text, in tasks, a bounded number of chunks at a time; bytes are marked as seen before
if their string stood within the last `WINDOW` bytes, so a text of any length needs a table of at most 64 MB.

Cases: a null or empty text is one chunk of padding and gets a score like any other.  Equal texts have equal scores; repeated
rows give a row each.  Without labels, or with labels of one value, the score is the share of label 1 (0.5 without labels).
An empty table gives no rows.  Only the text is an input of the score; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicspark.llm.registry import query, table, text_of

MAX_TRAIN = 3_000
MAX_TRAIN_BYTES = 8_000_000
CHUNK, STEP = 256, 224
WIDTH, STRIDE = 8, 4
FILTERS, EMBEDDING = 24, 7
SEEN = 12                # length of the byte strings that are marked as seen before
WINDOW = 1 << 22         # how far back they are looked for
EPOCHS, BATCH_TEXTS, RATE, SEED = 24, 128, 0.01, 11
_PLACES = (CHUNK - WIDTH) // STRIDE + 1
_BLOCK, _TRAIN_BLOCK = 512, 2_048


class Seen:
    """Marks of the bytes at which a string of `SEEN` bytes ends that also stood earlier, within the last `WINDOW` bytes.

    Strings are hashed into a table of their latest places, whose size has a bound, and are read from left to right.
    """

    def __init__(self, data: np.ndarray):
        self.data, self.at = data, 0
        self.bits = max(16, (4 * min(len(data), WINDOW)).bit_length())
        self.latest = np.zeros(1 << self.bits, np.uint32)             # place + WINDOW; 0: none

    def until(self, end: int) -> np.ndarray:
        """Marks of the bytes from where the last call ended."""
        marks = np.zeros(end - self.at, np.uint8)
        low, high = max(self.at - SEEN + 1, 0), end - SEEN + 1       # first bytes of the strings that end here
        if high > low:
            raw = self.data[low:end]
            key = raw[:high - low].astype(np.uint64)
            for k in range(1, SEEN):
                key = key * np.uint64(0x100000001B3) + raw[k:high - low + k]
            key = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.intp)
            place = np.arange(low, high, dtype=np.uint32)
            before = self.latest[key] > place
            self.latest[key[::-1]] = place[::-1]                      # the first place of this call is written last
            before |= self.latest[key] < place
            self.latest[key] = place + np.uint32(WINDOW)
            marks[low + SEEN - 1 - self.at:] = before
        self.at = end
        return marks


def chunk_count(n_bytes: int) -> int:
    return 1 + -(-max(n_bytes - CHUNK, 0) // STEP)


def chunk_blocks(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and seen-before marks of the chunks of a text, at most `_BLOCK` rows at a time; a short text is padded with zeros."""
    data = np.frombuffer(text, np.uint8)
    marker, n = Seen(data), len(data)
    if n < CHUNK:
        marks = np.concatenate([marker.until(n), np.zeros(CHUNK - n, np.uint8)])
        yield np.concatenate([data, np.zeros(CHUNK - n, np.uint8)])[None, :], marks[None, :]
        return
    tail = np.zeros(0, np.uint8)                                      # marks of the last bytes before marker.at
    for i in range(0, chunk_count(n), _BLOCK):
        starts = np.minimum(np.arange(i, min(i + _BLOCK, chunk_count(n))) * STEP, n - CHUNK)
        low, high = int(starts[0]), int(starts[-1]) + CHUNK
        kept = marker.at - low
        marks = np.concatenate([tail[len(tail) - kept:] if kept > 0 else tail[:0], marker.until(high)])
        tail = marks[-CHUNK:]
        place = starts[:, None] - low + np.arange(CHUNK)
        yield data[low:high][place], marks[place]


def chunks_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of a text, one row each."""
    data, seen = zip(*chunk_blocks(text))
    return np.concatenate(data), np.concatenate(seen)


class Net:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        wide = EMBEDDING + 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * wide) ** -0.5, (WIDTH * wide, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, FILTERS ** -0.5, FILTERS).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def windows(self, data: np.ndarray, seen: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.p["embed"][data], seen[:, :, None].astype(np.float32)], axis=2)
        c, _, wide = x.shape
        s0, s1, s2 = x.strides
        return np.lib.stride_tricks.as_strided(x, (c, _PLACES, WIDTH, wide), (s0, s1 * STRIDE, s1, s2)).reshape(c, _PLACES, -1)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where."""
        y = (windows.reshape(-1, windows.shape[2]) @ self.p["filters"]).reshape(len(windows), _PLACES, FILTERS)
        at = y.argmax(axis=1)
        return np.take_along_axis(y, at[:, None, :], axis=1)[:, 0] + self.p["bias"], at

    def logits(self, data: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(self.windows(data, seen))[0], 0) @ self.p["out"] + self.p["base"]

    def score(self, text: bytes) -> float:
        """Chunks are taken a bounded number at a time."""
        total = sum(float(self.logits(data, seen).sum(dtype=np.float64)) for data, seen in chunk_blocks(text))
        return float(1 / (1 + np.exp(-total / chunk_count(len(text)))))

    def gradients(self, data: np.ndarray, seen: np.ndarray, text: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; `text` numbers the text of each chunk, `y` has a label per text.

        Windows are made for a bounded number of chunks at a time, once to find the responses and once for their gradients.
        """
        p, n = self.p, len(y)
        blocks = [slice(i, i + _TRAIN_BLOCK) for i in range(0, len(data), _TRAIN_BLOCK)]
        x = None
        found = []
        for b in blocks:
            x = self.windows(data[b], seen[b])
            found.append(self.pooled(x))
        top, at = (np.concatenate(f) for f in zip(*found))
        act = np.maximum(top, 0)
        chunks = np.bincount(text, minlength=n)
        z = np.bincount(text, act @ p["out"] + p["base"], minlength=n) / chunks
        d_text = (1 / (1 + np.exp(-z)) - y) / n
        d_chunk = (d_text / chunks)[text].astype(np.float32)
        d_top = d_chunk[:, None] * p["out"] * (top > 0)
        embed, d_filters = 0.0, 0.0
        for b in blocks:
            x = x if len(blocks) == 1 else self.windows(data[b], seen[b])
            rows = np.arange(len(x))[:, None]
            best = x[rows, at[b]]                                           # chunk, filter, window
            d_filters = d_filters + np.einsum("cfw,cf->wf", best, d_top[b], optimize=True)
            d_window = d_top[b][:, :, None] * p["filters"].T                # chunk, filter, window
            d_embed = d_window.reshape(len(x), FILTERS, WIDTH, EMBEDDING + 1)[..., :EMBEDDING].reshape(-1, EMBEDDING)
            byte = data[b][rows[:, :, None], at[b][:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
            embed = embed + np.stack([np.bincount(byte, d_embed[:, k], minlength=256) for k in range(EMBEDDING)], axis=1)
        return {"embed": embed, "filters": d_filters, "bias": d_top.sum(0), "out": act.T @ d_chunk, "base": d_chunk.sum(keepdims=True)}

    def fit(self, data: np.ndarray, seen: np.ndarray, text: np.ndarray, y: np.ndarray) -> Net:
        """Adam over shuffled batches of texts; `text` is ascending."""
        share = y.mean() if len(y) else 0.5
        if not len(y) or not 0 < share < 1:
            self.p["out"][:] = 0
            edge = min(max(share, 1e-6), 1 - 1e-6)
            self.p["base"][:] = np.log(edge / (1 - edge)) if len(y) else 0
            return self
        self.p["base"][:] = np.log(share / (1 - share))
        rng = np.random.default_rng(SEED)
        first = np.searchsorted(text, np.arange(len(y) + 1))
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        # small tables see more rounds, so that every fit takes about as many steps
        epochs = int(min(200, max(EPOCHS, EPOCHS * 1_000 // len(y))))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH_TEXTS):
                own = order[i:i + BATCH_TEXTS]
                place = np.concatenate([np.arange(first[t], first[t + 1]) for t in own])
                number = np.repeat(np.arange(len(own)), first[own + 1] - first[own])
                step += 1
                for k, g in self.gradients(data[place], seen[place], number, y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    change = rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                    self.p[k] = (self.p[k] - change).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, id_col: str, text_col: str) -> list[tuple]:
    """(id, y) of the labelled documents to learn from: at most `max_rows` whose hashed ids come first, and of these, in that
    order, every one whose whole text still fits into `max_bytes`."""
    picked = (labels.where(F.col("quality").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id"))
              .agg(F.min("quality").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows))
    sizes = (docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n"))
             .join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.sum("n").alias("n")))
    chosen, used = [], 0
    for r in sizes.orderBy(F.xxhash64("id"), "id").collect():              # at most max_rows rows of numbers
        if used + r["n"] <= max_bytes:
            chosen.append((r["id"], r["y"]))
            used += r["n"]
    return chosen


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text",
          max_bytes: int = MAX_TRAIN_BYTES) -> Net:
    """Fits on all chunks of the chosen texts, which come to the driver: at most `max_bytes` of them."""
    chosen = training_rows(docs, labels, max_rows, max_bytes, id_col, text_col)
    listed = docs.sparkSession.createDataFrame(chosen, "id long, y int")
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(listed), "id")
            .select("id", "y", "text").collect())
    rows.sort(key=lambda r: (r["id"], r["text"]))
    parts = [chunks_of(r["text"].encode("utf-8", "surrogatepass")) for r in rows]
    ids, number = np.unique(np.array([r["id"] for r in rows], np.int64), return_inverse=True)
    y = np.zeros(len(ids))
    y[number] = [r["y"] for r in rows]
    text = np.repeat(number, [len(d) for d, _ in parts])
    none = np.zeros((0, CHUNK), np.uint8)
    return Net().fit(np.concatenate([none, *(d for d, _ in parts)]), np.concatenate([none, *(s for _, s in parts)]), text, y)


def scored(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.score((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
