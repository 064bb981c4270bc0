"""Arrow kernels: the per-document inner loops that are sequential by definition.

Each kernel sees one block of documents and the parameter rows of that block's words, both bounded by the block size, and
returns rows that Spark aggregates.  Nothing here reads the whole model or the whole corpus.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from topicspark.functions.special import np_digamma, np_lgamma

TINY = 1e-100
# What a kernel may return: word statistics plus one summary row per block, or one row per document.
WORD_SCHEMA = "word_id int, ss array<double>, score double, n_tokens long"
DOC_SCHEMA = "doc_id long, vec array<double>, score double, n_tokens long"
SUMMARY = -1  # word number of the summary row


def _ints(table, name):
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _matrix(table, name, width):
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(-1, width)


def _lists(values, width):
    """A 2-d array as an Arrow list column."""
    offsets = np.arange(0, values.size + 1, width, dtype=np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel())).cast(
        pa.list_(pa.float64()))


def _ragged(values, offsets):
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _word_table(words, stats, score, n_tokens):
    """Statistics of the block's words, and its score and size in the summary row."""
    width = stats.shape[1]
    scores, tokens = np.zeros(len(words) + 1), np.zeros(len(words) + 1, np.int64)
    scores[-1], tokens[-1] = score, n_tokens
    return pa.table({
        "word_id": pa.array(np.append(words, SUMMARY).astype(np.int32)),
        "ss": _lists(np.concatenate([stats, np.zeros((1, width))]), width),
        "score": pa.array(scores), "n_tokens": pa.array(tokens)})


def _doc_table(docs, vecs, scores, tokens):
    return pa.table({"doc_id": pa.array(docs.astype(np.int64)), "vec": _lists(vecs, vecs.shape[1]),
                     "score": pa.array(scores), "n_tokens": pa.array(tokens.astype(np.int64))})


_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)   # fixed values: the finaliser of splitmix64
_STEP = 0x9E3779B97F4A7C15


def _mixed(z):
    for shift, factor in zip((30, 27), _MIX):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def keyed_stream(*keys):
    """One number for a few keys, as seed, sweep and local sweep."""
    out = np.zeros(1, np.uint64)
    for key in keys:
        out = _mixed(out + np.uint64(_STEP) + np.asarray([int(key) & (2**64 - 1)], np.uint64))
    return out


def keyed_uniform(stream, docs, place):
    """Draws from [0, 1) that depend on the stream, the document and the place of its token alone, not on the block."""
    z = _mixed(stream + np.asarray(docs).astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    z = _mixed(z + np.asarray(place).astype(np.uint64) * np.uint64(_STEP))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def keyed_gamma(seed, keys, width, shape=100.0, scale=0.01):
    """Gamma draws, `width` for each key, that depend on seed, key and column alone.

    Marsaglia and Tsang's squeeze, for all cells at once: try t of a cell uses its own three uniforms, and the few cells whose
    try is rejected go on with the next.
    """
    d = shape - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    row = np.repeat(np.asarray(keys).astype(np.int64), width)
    column = np.tile(np.arange(width), len(keys))
    out = np.empty(len(row))
    left, attempt = np.arange(len(row)), 0
    while len(left):
        u1, u2, u3 = (keyed_uniform(keyed_stream(seed, 3 * attempt + i), row[left], column[left]) for i in range(3))
        x = np.sqrt(-2.0 * np.log1p(-u1)) * np.cos(2.0 * math.pi * u2)
        v = (1.0 + c * x) ** 3
        inside = v > 0
        log_v = np.log(np.where(inside, v, 1.0))
        taken = inside & (np.log1p(-u3) < 0.5 * x * x + d * (1.0 - v + log_v))
        out[left[taken]] = d * scale * v[taken]
        left, attempt = left[~taken], attempt + 1
    return out.reshape(len(keys), width)


def start_vectors(mode, seed, keys, width):
    """Starting values, one row per document or word: Gamma(100, 0.01) draws, or md5 values of equal mean and spread that any
    engine can reproduce.  A row's values do not depend on the task that makes them."""
    if mode != "hash":
        return keyed_gamma(seed, keys, width)
    half = 0.1 * math.sqrt(3.0)
    digests = (hashlib.md5(f"{seed}:{key}:{k}".encode()).digest()[:4] for key in keys for k in range(width))
    u = np.frombuffer(b"".join(digests), ">u4").astype(np.float64).reshape(len(keys), width) / 4294967296.0
    return 1.0 + half * (2.0 * u - 1.0)


def _documents(left):
    """The block's rows sorted by document and word, with the start of each document."""
    doc, word, freq = _ints(left, "doc_id"), _ints(left, "word_id"), _ints(left, "freq").astype(np.float64)
    order = np.lexsort((word, doc))
    doc, word, freq = doc[order], word[order], freq[order]
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[:len(doc)])
    return doc[starts], word, freq, np.append(starts, len(doc))


def _model_rows(right, column, width):
    words = _ints(right, "word_id")
    order = np.argsort(words)
    return words[order], _matrix(right, column, width)[order]


_CELLS_OF_A_PART = 200_000   # (word, topic) cells of the documents that a kernel takes at once: they fit in a cache


def _parts(bounds, n_topics, cells=None):
    """Consecutive documents with a bounded number of cells together, at least one."""
    d, n_docs = 0, len(bounds) - 1
    while d < n_docs:
        most = bounds[d] + max(1, (cells or _CELLS_OF_A_PART) // n_topics)
        to = max(d + 1, int(np.searchsorted(bounds, most, "right")) - 1)
        yield d, to
        d = to


def vb_kernel(n_topics, alpha, topic_totals, seed, init, max_iter, tol, per_document=False):
    """Variational E-step of every document of a block to convergence, with the model fixed.

    The words of some documents lie in one flat matrix, a row per (document, word); a step is a few operations on it and sums
    over its runs.  Documents that have converged keep their values and leave the matrix when a quarter of its rows is theirs.
    """
    alpha = np.asarray(alpha, dtype=np.float64)
    total_digamma = np_digamma(np.asarray(topic_totals, dtype=np.float64))

    def mean_of(gamma):
        return np_digamma(gamma) - np_digamma(gamma.sum(axis=1))[:, None]

    def run(left, right):
        docs, word, freq, bounds = _documents(left)
        words, lam = _model_rows(right, "params", n_topics)
        elog = np_digamma(lam) - total_digamma
        top = elog.max(axis=1)
        weight = np.exp(elog - top[:, None])
        at = np.searchsorted(words, word)
        gamma = start_vectors(init, seed, docs, n_topics)
        stats = np.zeros_like(weight)
        scores, tokens = np.empty(len(docs)), np.add.reduceat(freq, bounds[:-1]) if len(docs) else np.zeros(0)
        for d0, d1 in _parts(bounds, n_topics):
            rows = slice(bounds[d0], bounds[d1])
            own = at[rows]
            every = weight[own]                            # a row per (document, word)
            f_all, starts_all = freq[rows], bounds[d0:d1] - bounds[d0]
            owner_all = np.repeat(np.arange(d1 - d0), np.diff(bounds[d0:d1 + 1]))
            now = gamma[d0:d1]
            last_theta, last_ratio = np.empty_like(now), np.empty(len(own))
            active = np.arange(d1 - d0)                    # documents of the matrix, in order; some of them may be done
            done = np.zeros(d1 - d0, bool)
            b, f, starts, owner, places = every, f_all, starts_all, owner_all, np.arange(len(own))
            for step in range(max_iter):
                theta = np.exp(mean_of(now[active]))
                ratio = f / (np.einsum("ij,ij->i", b, theta[owner]) + TINY)
                new = alpha + theta * np.add.reduceat(b * ratio[:, None], starts, axis=0)
                going = ~done[active]
                moved = np.abs(new - now[active]).sum(axis=1) / n_topics
                now[active[going]] = new[going]
                ends = going & ((moved < tol) | (step == max_iter - 1))
                if ends.any():
                    last_theta[active[ends]] = theta[ends]
                    of_ended = ends[owner]
                    last_ratio[places[of_ended]] = ratio[of_ended]
                    done[active[ends]] = True
                    stays = ~done[active]
                    if not stays.any():
                        break
                    if (kept := stays[owner]).mean() < 0.75:
                        b, f, places = b[kept], f[kept], places[kept]
                        sizes = np.bincount(owner[kept], minlength=len(active))[stays]
                        active = active[stays]
                        owner, starts = np.repeat(np.arange(len(active)), sizes), np.cumsum(sizes) - sizes
            theta = np.exp(mean_of(now))
            value = f_all * (np.log(np.einsum("ij,ij->i", every, theta[owner_all]) + TINY) + top[own])
            scores[d0:d1] = np.add.reduceat(value, starts_all)
            if not per_document:
                by_word = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(own[by_word]) != 0))
                cells = every * last_ratio[:, None] * last_theta[owner_all]
                stats[own[by_word[first]]] += np.add.reduceat(cells[by_word], first, axis=0)
        mean = mean_of(gamma)
        scores += (((alpha - gamma) * mean).sum(axis=1) + (np_lgamma(gamma) - np_lgamma(alpha)).sum(axis=1)
                   + np_lgamma(alpha.sum()) - np_lgamma(gamma.sum(axis=1)))
        if per_document:
            return _doc_table(docs, gamma, scores, tokens)
        return _word_table(words, stats, scores.sum(), tokens.sum())

    return run


def _by_length(lengths):
    """Documents from long to short, and for each token place the number of documents that reach it."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    reach = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return order, reach


def _held_in_loglik(share, word_prob, row_word, freq, bounds):
    """Per document, sum over its words of frequency x log(topic shares . word probabilities), in runs of rows."""
    doc = np.repeat(np.arange(len(share)), np.diff(bounds))
    prob = np.empty(len(doc))
    step = max(1, 4_000_000 // share.shape[1])
    for i in range(0, len(doc), step):
        prob[i:i + step] = np.einsum("ij,ij->i", share[doc[i:i + step]], word_prob[row_word[i:i + step]])
    return np.bincount(doc, freq * np.log(prob + TINY), minlength=len(share))


def scvb0_kernel(n_topics, alpha, beta, n_words, topic_totals, seed, init, max_iter, rate,
                 per_document=False):
    """Stochastic collapsed pass over the tokens of each document, with the global statistics fixed.

    Documents do not influence each other here, so the j-th tokens of all documents are updated together; every document
    still sees its own tokens strictly in order.  The score is the log-likelihood of a document's tokens under its final
    N_theta and the model that the pass started from.
    """
    alpha = np.asarray(alpha, dtype=np.float64)
    denom = n_words * beta + np.asarray(topic_totals, dtype=np.float64)
    scale, tau0, kappa = rate

    def run(left, right):
        docs, word, freq, bounds = _documents(left)
        words, counts = _model_rows(right, "params", n_topics)
        weight = (beta + counts) / denom
        row_word = np.searchsorted(words, word)
        row_end = np.concatenate([[0], np.cumsum(freq)]).astype(np.int64)
        first = row_end[bounds[:-1]]
        lengths = row_end[bounds[1:]] - first
        order, reach = _by_length(lengths)
        first, size = first[order], lengths[order].astype(np.float64)
        theta = start_vectors(init, seed, docs[order], n_topics)
        stats = np.zeros_like(weight)
        n_steps = (max_iter + 1) * (int(lengths.max()) if len(lengths) else 0)
        rates = np.maximum(0.0, scale * (tau0 + np.arange(n_steps)) ** -kappa)
        whole = lengths[order].astype(np.int64)
        first_row = bounds[:-1][order]
        for sweep in range(max_iter + 1):
            step = sweep * whole                                # each document counts its own steps
            row = first_row.copy()                              # the row that the token at this place belongs to
            for place, n in enumerate(reach):
                row[:n] += row_end[row[:n] + 1] <= first[:n] + place
                at = row_word[row[:n]]
                now = theta[:n]
                phi = (now + alpha) * weight[at]
                phi /= phi.sum(axis=1, keepdims=True) + TINY
                if sweep == max_iter:
                    np.add.at(stats, at, phi)
                rho = rates[step[:n] + place][:, None]
                phi *= rho * size[:n, None]
                now *= 1.0 - rho
                now += phi
        share = np.empty_like(theta)
        share[order] = (theta + alpha) / (theta + alpha).sum(axis=1, keepdims=True)
        score = _held_in_loglik(share, weight, row_word, freq, bounds)
        if per_document:
            return _doc_table(docs[order], theta, score[order], size)
        return _word_table(words, stats, score.sum(), size.sum())

    return run


def _dense_counts(right, n_topics):
    """Word rows with sparse `(topics, ns)` lists as a dense block matrix."""
    words = _ints(right, "word_id")
    order = np.argsort(words)
    topics, ns = right.column("topics").combine_chunks(), right.column("ns").combine_chunks()
    lengths = np.diff(topics.offsets.to_numpy())
    dense = np.zeros((len(words), n_topics))
    row = np.repeat(np.arange(len(words)), lengths)
    dense[row, topics.flatten().to_numpy()] = ns.flatten().to_numpy()
    return words[order], dense[order]


def _draw(prob, u):
    """Topic drawn from unnormalised weights by inverse cumulative sum, kept inside the range under rounding."""
    cum = np.cumsum(prob, axis=-1)
    target = u * cum[..., -1]
    return np.minimum((cum < target[..., None]).sum(axis=-1), prob.shape[-1] - 1)


_MD5_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_MD5_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_MD5_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
_MD5_ROOM = 55            # bytes of a message that fits in one step of md5 with its padding
_MD5_AT_ONCE = 16_384     # messages whose sixteen words fit in a cache


def _md5_heads(messages, sizes):
    """The first 32 bits of the md5 of many messages of at most `_MD5_ROOM` bytes, the rows of an (n, 64) matrix."""
    n = len(messages)
    messages[np.arange(n), sizes] = 0x80
    words = messages.view("<u4")
    words[:, 14] = sizes * 8
    words = np.ascontiguousarray(words.T)
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            mix, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mix, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mix, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mix, at = c ^ (b | ~d), 7 * i % 16
        mix += a
        mix += words[at]
        mix += np.uint32(_MD5_SINES[i])
        turn = _MD5_SHIFTS[i // 16][i % 4]
        turned = mix << np.uint32(turn)
        mix >>= np.uint32(32 - turn)
        turned |= mix
        turned += b
        a, b, c, d = d, turned, b, c
    return (a + np.uint32(_MD5_START[0])).byteswap()


def _write_number(messages, sizes, numbers):
    """Appends the decimal digits of numbers from 0 on to the messages; `sizes` grows with them."""
    digits, power = np.ones(len(numbers), np.int64), 10
    most = int(numbers.max())
    while power <= most:
        digits += numbers >= power
        power *= 10
    flat, last = messages.reshape(-1), np.arange(len(messages)) * messages.shape[1] + sizes + digits - 1
    rest = numbers.astype(np.int64)
    for j in range(int(digits.max())):
        left = np.flatnonzero(digits > j)
        rest, digit = np.divmod(rest, 10)
        flat[last[left] - j] = 48 + digit[left]
    sizes += digits


def md5_draws(prefixes, which, *numbers):
    """Draws from [0, 1) from the md5 of `prefix:number:number...`, the same as any engine with md5 makes; `which` is the number of
    the prefix of each draw."""
    longest = max((len(p) for p in prefixes), default=0) + sum(1 + len(str(int(n.max()))) for n in numbers if len(n))
    out = np.empty(len(which))
    if longest > _MD5_ROOM:
        for i, key in enumerate(zip(which.tolist(), *[n.tolist() for n in numbers])):
            text = ":".join([prefixes[key[0]], *map(str, key[1:])])
            out[i] = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big")
        return out / 4294967296.0
    starts = np.frombuffer(b"".join(p.encode().ljust(64, b"\0") for p in prefixes), np.uint8).reshape(-1, 64)
    lengths = np.array([len(p) for p in prefixes], np.int64)
    for i in range(0, len(which), _MD5_AT_ONCE):
        part = which[i:i + _MD5_AT_ONCE]
        messages, sizes = starts[part], lengths[part]
        for n in numbers:
            messages[np.arange(len(part)), sizes] = 58
            sizes += 1
            _write_number(messages, sizes, n[i:i + _MD5_AT_ONCE])
        out[i:i + _MD5_AT_ONCE] = _md5_heads(messages, sizes)
    return out / 4294967296.0


def md5_uniform(seed, sweep, docs, places, which=None):
    """The portable draws of a sweep: one per document and place.  `which` gives the row in `docs` of each draw, one each if left out."""
    which = np.arange(len(docs)) if which is None else which
    return md5_draws([f"{seed}:{sweep}:{d}" for d in docs.tolist()], which, np.broadcast_to(places, which.shape))


_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(z, by):
    return (z << np.uint64(by)) | (z >> np.uint64(64 - by))


def _xx_step(state, values, is_long=False):
    """xxhash64 of integers on top of the hashes of the values before them, as Spark's `xxhash64` takes int (or long) columns."""
    values = np.asarray(values)
    if is_long:
        z = (state + _XX[4] + np.uint64(8)) ^ (_turned(values.astype(np.int64).view(np.uint64) * _XX[1], 31) * _XX[0])
        z = _turned(z, 27) * _XX[0] + _XX[3]
    else:
        z = (state + _XX[4] + np.uint64(4)) ^ (values.astype(np.int32).view(np.uint32).astype(np.uint64) * _XX[0])
        z = _turned(z, 23) * _XX[1] + _XX[2]
    z = (z ^ (z >> np.uint64(33))) * _XX[1]
    z = (z ^ (z >> np.uint64(29))) * _XX[2]
    return z ^ (z >> np.uint64(32))


def fast_draws(seed, docs, missing, which, word, last):
    """The draws `fast_u01(seed, doc_id, word_id, last)` of Spark; `which` is the number of each draw's document, of which `missing` ones
    have no id."""
    start = _xx_step(np.array([42], np.uint64), [seed], not -2**31 <= seed < 2**31)       # 42: the seed of Spark's function
    of_docs = np.where(missing, start, _xx_step(start, docs, True))
    return (_xx_step(_xx_step(of_docs[which], word), last) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


class TopicLists:
    """The topics that each row (a document, a word) has held in this sweep; a topic that it has lost weighs nothing."""

    def __init__(self, rows, topics, n_rows, n_topics, may_come):
        """Distinct pairs to begin with, and the number of topics that may come to each row."""
        self.n_topics, self.held = n_topics, np.zeros((n_rows, n_topics), bool)
        self.held[rows, topics] = True
        self.size = np.bincount(rows, minlength=n_rows)
        room = np.minimum(n_topics, self.size + may_come)
        self.start = np.cumsum(room) - room
        self.items = np.zeros(int(room.sum()), np.int64)
        order = np.argsort(rows, kind="stable")
        self.items[_run_places(self.start, self.size)] = topics[order]

    def add(self, rows, topics):
        new = np.unique((rows * self.n_topics + topics)[~self.held[rows, topics]])
        rows, topics = np.divmod(new, self.n_topics)
        if len(rows):
            first = np.searchsorted(rows, rows)               # the place of a row's first new topic among them
            self.items[self.start[rows] + self.size[rows] + np.arange(len(rows)) - first] = topics
            self.held[rows, topics] = True
            np.add.at(self.size, rows, 1)

    def of(self, rows):
        """(number of the row, topic) for each topic of each row, and where each row's topics begin."""
        sizes = self.size[rows]
        return np.repeat(np.arange(len(rows)), sizes), self.items[_run_places(self.start[rows], sizes)], np.cumsum(sizes) - sizes


def _run_places(starts, sizes):
    """starts[i], starts[i] + 1, ... for each i, sizes[i] of them."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _chosen(cumulated, begin, sizes, target):
    """In each run of a cumulated array, the place that `target`, counted from the run's begin, falls on."""
    below = np.where(begin > 0, cumulated[np.maximum(begin, 1) - 1], 0.0)
    return np.clip(np.searchsorted(cumulated, below + target, side="right"), begin, begin + sizes - 1)


def sparse_draw(n_dk, n_kw, n_k, alpha, beta, vb, docs, words, doc_topics, word_topics, u):
    """One topic for each (document, word) from (n_dk + alpha) (n_kw + beta) / (n_k + vb), in three parts.

    n_dk (n_kw + beta) over the topics of the document, alpha n_kw over those of the word, alpha beta over all, each divided by
    n_k + vb: a token costs its topics in use, and the sum over all topics is made once for all tokens of the call.
    """
    share = 1.0 / (n_k + vb)
    of_d, topic_d, begin_d = doc_topics.of(docs)
    in_doc = np.cumsum(n_dk[docs[of_d], topic_d] * (n_kw[words[of_d], topic_d] + beta) * share[topic_d])
    of_w, topic_w, begin_w = word_topics.of(words)
    in_word = np.cumsum(n_kw[words[of_w], topic_w] * alpha[topic_w] * share[topic_w])
    smooth = np.cumsum(alpha * beta * share)

    def sums(cumulated, begin, sizes):
        padded = np.append(0.0, cumulated)
        return padded[begin + sizes] - padded[begin]

    size_d, size_w = doc_topics.size[docs], word_topics.size[words]
    doc_sum, word_sum = sums(in_doc, begin_d, size_d), sums(in_word, begin_w, size_w)
    at = u * (doc_sum + word_sum + smooth[-1])
    out = np.minimum(np.searchsorted(smooth, at - doc_sum - word_sum, side="right"), len(smooth) - 1)
    by_doc = np.flatnonzero(at < doc_sum)
    out[by_doc] = topic_d[_chosen(in_doc, begin_d[by_doc], size_d[by_doc], at[by_doc])]
    by_word = np.flatnonzero((at >= doc_sum) & (at < doc_sum + word_sum))
    out[by_word] = topic_w[_chosen(in_word, begin_w[by_word], size_w[by_word], (at - doc_sum)[by_word])]
    return out


SPARSE_FROM = 64   # topics from which sparse draws pay; both draw from the same distribution


def _lockstep_tokens(z, token, at, reach, docs, n_kw, n_k, alpha, beta, vb, draws):
    """The steps of `lockstep` over the tokens `at`, of `reach` documents each, as a loop; all arrays are brought up to date."""
    n_dk, totals, alpha = docs.tolist(), n_k.tolist(), alpha.tolist()
    words, topics, draws, i = token[at].tolist(), z[at].tolist(), draws.tolist(), 0
    for m in reach.tolist():
        step = range(i, i + m)
        for row, j in enumerate(step):
            k = topics[j]
            n_dk[row][k] -= 1.0
            n_kw[words[j], k] -= 1.0
            totals[k] -= 1.0
        new = []
        for row, j in enumerate(step):
            total, cum = 0.0, []
            for w, n, a, below in zip(n_kw[words[j]].tolist(), n_dk[row], alpha, totals):
                total += (w + beta) * (n + a) / (below + vb)
                cum.append(total)
            target = draws[j] * total
            new.append(min(sum([c < target for c in cum]), len(cum) - 1))
        for row, j in enumerate(step):
            k = topics[j] = new[row]
            n_dk[row][k] += 1.0
            n_kw[words[j], k] += 1.0
            totals[k] += 1.0
        i += m
    z[at], docs[:], n_k[:] = topics, n_dk, totals


def _frozen_sweep(token, z, first, reach, docs, word_weights, topic_weights, alpha, draws):
    """New topics of all tokens with the weights of words and topics as they are, less the token's own.

    Draws and word weights of many places are made at once, place by place, so a step works on neighbouring rows; only the counts of the
    documents, `docs` from long to short, move from step to step.
    """
    n_topics = docs.shape[1]
    z = z.copy()
    begin = np.append(0, np.cumsum(reach))
    rows, flat = np.arange(len(docs)) * n_topics, docs.reshape(-1)
    p = 0
    while p < len(reach):
        to = max(p + 1, int(np.searchsorted(begin, begin[p] + _CELLS_OF_A_PART // n_topics, "right")) - 1)
        n = reach[p:to]
        place = np.repeat(np.arange(p, to), n)
        rank = np.arange(begin[p], begin[to]) - np.repeat(begin[p:to], n)
        at = first[rank] + place
        k, mine = z[at], np.arange(len(at))
        prob, total = word_weights[token[at]], np.tile(topic_weights, (len(at), 1))
        prob[mine, k] -= 1.0
        total[mine, k] -= 1.0
        prob /= total
        u, own, new = draws(rank, place), rank * n_topics + k, np.empty(len(at), np.int64)
        starts = begin[p:to] - begin[p]
        wide = int(np.searchsorted(-n, -(_CELLS_OF_A_STEP // n_topics), "left"))
        for i, m in zip(starts[:wide].tolist(), n[:wide].tolist()):
            step = slice(i, i + m)
            flat[own[step]] -= 1.0
            drawn = _draw(prob[step] * (docs[:m] + alpha), u[step])
            flat[rows[:m] + drawn] += 1.0
            new[step] = drawn
        for row in range(n[wide] if wide < len(n) else 0):      # few documents are this long: token by token
            mine = starts[wide:][n[wide:] > row] + row
            new[mine], docs[row] = _frozen_tokens(docs[row].tolist(), k[mine].tolist(), prob[mine].tolist(), u[mine].tolist(), alpha.tolist())
        z[at] = new
        p = to
    return z


_CELLS_OF_A_STEP = 48   # (document, topic) cells below which a step costs more as array functions than as a loop


def _frozen_tokens(n_dk, topics, probs, draws, alpha):
    """New topics of a document's tokens one by one, and its counts after them."""
    out = []
    for k, prob, u in zip(topics, probs, draws):
        n_dk[k] -= 1.0
        total, cum = 0.0, []
        for w, n, a in zip(prob, n_dk, alpha):
            total += w * (n + a)
            cum.append(total)
        target = u * total
        k = min(sum([c < target for c in cum]), len(cum) - 1)
        n_dk[k] += 1.0
        out.append(k)
    return out, n_dk


def hash_topics(n_topics, seed, portable=True):
    """An Arrow function from documents `(doc_id, words, freqs)` to `(doc_id, words, topics)`: a token per occurrence with a uniform
    topic, by md5 if portable, else by Spark's hash, in order of word and occurrence."""

    def run(batches):
        for batch in batches:
            whole = batch.column("words").offsets.to_numpy()
            for d, to in _parts(whole, 1):
                part = batch.slice(d, to - d)
                word, freq = part.column("words").flatten().to_numpy(), part.column("freqs").flatten().to_numpy().astype(np.int64)
                bounds = np.append(0, np.cumsum(np.diff(whole[d:to + 1])))
                owner, words = np.repeat(np.repeat(np.arange(to - d), np.diff(bounds)), freq), np.repeat(word, freq)
                occ = np.arange(freq.sum()) - np.repeat(np.cumsum(freq) - freq, freq)
                if np.any((word[1:] == word[:-1]) & (np.diff(np.repeat(np.arange(to - d), np.diff(bounds))) == 0)):
                    order = np.lexsort((occ, words, owner))
                    owner, words, occ = owner[order], words[order], occ[order]
                ids = part.column("doc_id")
                if portable:
                    u = md5_draws([f"{seed}" if x is None else f"{seed}:{x}" for x in ids.to_pylist()], owner, words, occ)
                else:
                    u = fast_draws(seed, pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False), owner, words, occ)
                topics = np.floor(u * n_topics).astype(np.int32)
                cuts = np.append(0, np.cumsum(np.bincount(owner, minlength=to - d)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _ragged(words, cuts), _ragged(topics, cuts)],
                                                 ["doc_id", "words", "topics"])

    return run


def gibbs_kernel(n_topics, alpha, beta, n_words, topic_totals, seed, sweep, schedule, n_local=1, portable=False,
                 sparse_from=SPARSE_FROM):
    """Collapsed Gibbs sweeps over a block, on the block's own copy of the counts.

    `serial` visits the tokens one by one, which for a single block is the exact chain.  `lockstep` draws the j-th tokens
    of all documents of the block together: documents are distinct, so only word and topic totals can be out of date, and
    only by the tokens of one such step.  `frozen` keeps the word counts and topic totals of the sweep's beginning, less the
    token's own, and moves the document's counts token by token, so its result does not depend on the blocks at all.
    """
    alpha = np.asarray(alpha, dtype=np.float64)
    totals0 = np.asarray(topic_totals, dtype=np.float64)

    def run(left, right):
        words, n_kw = _dense_counts(right, n_topics)
        n_k = totals0.copy()
        left = left.take(pa.array(np.argsort(_ints(left, "doc_id"))))
        doc = _ints(left, "doc_id")
        word_col, topic_col = left.column("words").combine_chunks(), left.column("topics").combine_chunks()
        offsets = word_col.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        token = np.searchsorted(words, word_col.flatten().to_numpy(zero_copy_only=False))
        z = topic_col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).copy()
        lengths = np.diff(offsets)
        n_docs = len(lengths)
        n_dk = np.zeros((n_docs, n_topics))
        np.add.at(n_dk, (np.repeat(np.arange(n_docs), lengths), z), 1.0)
        vb = n_words * beta
        for local in range(n_local):
            def uniforms(docs, places, stream=keyed_stream(seed, sweep, local)):
                return md5_uniform(seed, sweep, docs, places) if portable else keyed_uniform(stream, docs, places)

            if schedule == "serial":
                for i in range(n_docs):
                    for j in range(offsets[i], offsets[i + 1]):
                        w, k = token[j], z[j]
                        n_kw[w, k] -= 1
                        n_k[k] -= 1
                        n_dk[i, k] -= 1
                        k = int(_draw((n_kw[w] + beta) / (n_k + vb) * (n_dk[i] + alpha), uniforms(doc[i:i + 1], j - offsets[i])[0]))
                        n_kw[w, k] += 1
                        n_k[k] += 1
                        n_dk[i, k] += 1
                        z[j] = k
            else:
                long_first, reach = _by_length(lengths)
                first = offsets[:-1][long_first]
                docs = n_dk[long_first]                         # longest first: a step works on the leading rows
                rows, flat_docs, flat_words = np.arange(n_docs) * n_topics, docs.reshape(-1), n_kw.reshape(-1)
                sparse = schedule == "lockstep" and n_topics >= sparse_from
                if sparse:
                    doc_topics = TopicLists(*np.nonzero(docs), n_docs, n_topics, lengths[long_first])
                    word_topics = TopicLists(*np.nonzero(n_kw), len(n_kw), n_topics, np.bincount(token, minlength=len(n_kw)))
                if schedule == "frozen":
                    def draws(ranks, places, docs=doc[long_first], stream=keyed_stream(seed, sweep, local)):
                        return md5_uniform(seed, sweep, docs, places, ranks) if portable else keyed_uniform(stream, docs[ranks], places)

                    z = _frozen_sweep(token, z, first, reach, docs, n_kw + beta, n_k + vb, alpha, draws)
                    n_dk[long_first] = docs
                    continue
                wide = len(reach) if sparse else int(np.searchsorted(-reach, -(_CELLS_OF_A_STEP // n_topics), "left"))
                for place, n in enumerate(reach[:wide]):
                    at = first[:n] + place
                    w, k = token[at], z[at]
                    u = uniforms(doc[long_first[:n]], place)
                    flat_docs[rows[:n] + k] -= 1.0
                    np.subtract.at(flat_words, w * n_topics + k, 1.0)
                    n_k -= np.bincount(k, minlength=n_topics)
                    if sparse:
                        k = sparse_draw(docs, n_kw, n_k, alpha, beta, vb, np.arange(n), w, doc_topics, word_topics, u)
                        doc_topics.add(np.arange(n), k)
                        word_topics.add(w, k)
                    else:
                        prob = n_kw[w]
                        prob += beta
                        prob *= docs[:n] + alpha
                        prob /= n_k + vb
                        k = _draw(prob, u)
                    np.add.at(flat_words, w * n_topics + k, 1.0)
                    n_k += np.bincount(k, minlength=n_topics)
                    flat_docs[rows[:n] + k] += 1.0
                    z[at] = k
                if wide < len(reach):                              # few documents are this long: token by token
                    n = reach[wide:]
                    place = np.repeat(np.arange(wide, len(reach)), n)
                    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    _lockstep_tokens(z, token, first[rank] + place, n, docs, n_kw, n_k, alpha, beta, vb,
                                     uniforms(doc[long_first][rank], place))
                n_dk[long_first] = docs
        return pa.table({
            "block": left.column("block"), "doc_id": left.column("doc_id"),
            "words": left.column("words").combine_chunks(),
            "topics": _ragged(z.astype(np.int32), offsets)})

    return run


PIECE = 4096   # words of a document in one row of a packed table
# A row per document, or per PIECE words of it; n_dk stands in a document's first row, the word sums in a block's first row.
# `part` tells which documents of a block share a copy of the sums in sweeps in place.
# phi and sums are the bytes of doubles, a vector per word: Spark copies such a value whole, and an array element by element.
PHI_ROWS = ("block int, part int, doc_id long, piece int, words array<int>, weights array<double>, phi binary, n_dk array<double>, "
            "sum_words array<int>, sums binary")
_CELLS_AT_ONCE = 1_000_000


def _cut_lists(values, offsets):
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _on_first(values, first, n_rows):
    """A list column that holds row i of `values` in row first[i], and nothing elsewhere."""
    sizes = np.zeros(n_rows, np.int64)
    sizes[first] = values.shape[1]
    return _cut_lists(np.ascontiguousarray(values).ravel(), np.concatenate([[0], np.cumsum(sizes)]))


def _bytes(values, offsets):
    """A binary column: value i holds the doubles offsets[i] to offsets[i + 1]."""
    data = np.ascontiguousarray(values, np.float64).ravel()
    at = pa.py_buffer((np.asarray(offsets) * 8).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, at, pa.py_buffer(data)]).cast(pa.binary())


def _doubles(column, width):
    """All doubles of a binary column, `width` to a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width))
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.float64).reshape(-1, width)


def _row_sums(groups, n_groups, values, weight):
    """Weighted sums of the rows of each group."""
    out = np.empty((n_groups, values.shape[1]))
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(groups, weights=values[:, k] * weight, minlength=n_groups)
    return out


def _phi_rows(block, doc, word, weight, phi):
    """Packed rows of one block with its sums; the input is sorted by document and word."""
    docs, bounds = _document_runs(doc)
    words, at = np.unique(word, return_inverse=True)
    n_dk = _row_sums(np.repeat(np.arange(len(docs)), np.diff(bounds)), len(docs), phi, weight)
    return _packed(block, docs, bounds, word, weight, n_dk, words, _row_sums(at, len(words), phi, weight), phi)


def _document_runs(doc):
    """The document of each run of pairs, and where the runs begin and the last one ends."""
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[:len(doc)])
    return doc[starts], np.append(starts, len(doc))


def _packed(block, docs, bounds, word, weight, n_dk, words, sums, phi=None, part=None):
    """PHI_ROWS of a block; without `phi` the responsibilities are left out.  `part` gives the part of each document, 0 if left out."""
    pieces = -(-np.diff(bounds) // PIECE)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.append(np.repeat(bounds[:-1], pieces) + number * PIECE, len(word))
    n_rows = len(number)
    return pa.table({
        "block": pa.array(np.full(n_rows, block, np.int32)), "part": pa.array(np.zeros(n_rows, np.int32) if part is None else np.repeat(part, pieces)),
        "doc_id": pa.array(np.repeat(docs, pieces)), "piece": pa.array(number.astype(np.int32)),
        "words": _cut_lists(word.astype(np.int32, copy=False), cuts), "weights": _cut_lists(weight, cuts),
        "phi": _bytes(np.zeros(0) if phi is None else phi, cuts * (0 if phi is None else phi.shape[1])),
        "n_dk": _on_first(n_dk, np.flatnonzero(number == 0), n_rows),
        "sum_words": _on_first(words.astype(np.int32)[None, :], [0], n_rows), "sums": _bytes(sums, np.append(0, np.full(n_rows, sums.size)))})


def _sums_alone(block, docs, n_dk, words, sums):
    """PHI_ROWS with the sums of a block and no word of its documents."""
    n = len(docs)
    none = np.zeros(n + 1, np.int64)
    return pa.table({
        "block": pa.array(np.full(n, block, np.int32)), "part": pa.array(np.zeros(n, np.int32)), "doc_id": pa.array(docs),
        "piece": pa.array(np.zeros(n, np.int32)),
        "words": _cut_lists(np.zeros(0, np.int32), none), "weights": _cut_lists(np.zeros(0), none), "phi": _bytes(np.zeros(0), none),
        "n_dk": _on_first(n_dk, np.arange(n), n), "sum_words": _on_first(words.astype(np.int32)[None, :], [0], n),
        "sums": _bytes(sums, np.append(0, np.full(n, sums.size)))})


def _drawn_phi(seed, docs, which, word, n_topics, portable=True):
    """Starting responsibilities, by md5 if portable, else by Spark's hash; `which` is the number of each pair's document in `docs`."""
    if portable:
        prefixes = [f"{seed}" if x != x else f"{seed}:{int(x)}" for x in docs.tolist()]
        u = md5_draws(prefixes, np.repeat(which, n_topics), np.repeat(word, n_topics), np.tile(np.arange(n_topics), len(word)))
        u = u.reshape(-1, n_topics)
    else:
        missing = docs != docs
        u = fast_draws(seed, np.where(missing, 0, docs).astype(np.int64), missing, which[:, None], word[:, None], np.arange(n_topics))
    return u / u.sum(axis=1, keepdims=True)


def _swept(seed, n_topics, docs, bounds, word, weight, phi, words, alpha, steps, portable=True):
    """`(first document, next document, their pairs, number of each pair's document, place of its word in `words`, responsibilities)` for
    a bounded number of cells at a time: drawn if `phi` is none, and taken through sweeps from given (word sums, topic sums).

    What is worked out for a pair is made here, for the pairs of a part; a block is held as little more than its words and weights.
    """
    for d, to in _parts(bounds, n_topics, _CELLS_AT_ONCE):
        pairs = slice(bounds[d], bounds[to])
        which, at = np.repeat(np.arange(to - d), np.diff(bounds[d:to + 1])), np.searchsorted(words, word[pairs])
        now = _drawn_phi(seed, docs[d:to], which, word[pairs], n_topics, portable) if phi is None else phi[pairs]
        for n_wk, n_k in steps:
            new = (_row_sums(which, to - d, now, weight[pairs]) + alpha)[which] - now
            new *= n_wk[at] - now
            new /= n_k - now
            new /= new.sum(axis=1, keepdims=True)
            now = new
        yield d, to, pairs, which, at, now


def _summed(parts, n_docs, n_words, n_topics, weight, phi=None):
    """Document and word sums of what `_swept` gives; the responsibilities themselves go to `phi` if given."""
    n_dk, sums = np.empty((n_docs, n_topics)), np.zeros((n_words, n_topics))
    for d, to, pairs, which, at, now in parts:
        n_dk[d:to] = _row_sums(which, to - d, now, weight[pairs])
        sums += _row_sums(at, n_words, now, weight[pairs])
        if phi is not None:
            phi[pairs] = now
    return n_dk, sums


def pack_phi(n_topics):
    """Kernel: rows `(block, doc_id, word_id, weight, phi)` of a block as PHI_ROWS."""

    def run(rows):
        doc, word = _ints(rows, "doc_id"), _ints(rows, "word_id")
        order = np.lexsort((word, doc))
        weight = _ints(rows, "weight").astype(np.float64)[order]
        return _phi_rows(_ints(rows, "block")[0], doc[order], word[order], weight, _matrix(rows, "phi", n_topics)[order])

    return run


def _sorted_pairs(rows):
    """Documents, where their pairs begin, words and weights, and the part of each document if it is given, in order of part, document
    and word; nothing else outlives the call."""
    doc, word = _ints(rows, "doc_id"), _ints(rows, "word_id")
    part = _ints(rows, "part") if "part" in rows.column_names else None
    order = np.lexsort((word, doc) if part is None else (word, doc, part))
    word, doc = word[order], doc[order]
    docs, bounds = _document_runs(doc)
    del doc
    if part is not None:
        part = part[order[bounds[:-1]]]
    return docs, bounds, word, _ints(rows, "weight")[order].astype(np.float64, copy=False), part


def pack_drawn(n_topics, seed, portable=True):
    """Kernel: rows `(block, doc_id, word_id, weight)`, with `part` if there is one, of a block as PHI_ROWS with the sums of drawn
    responsibilities, which are left out."""

    def run(rows):
        docs, bounds, word, weight, part = _sorted_pairs(rows)
        words = np.unique(word)
        parts = _swept(seed, n_topics, docs, bounds, word, weight, None, words, 0.0, [], portable)
        n_dk, sums = _summed(parts, len(docs), len(words), n_topics, weight)
        return _packed(rows.column("block")[0].as_py(), docs, bounds, word, weight, n_dk, words, sums, part=part)

    return run


def _packed_block(rows, n_topics):
    """Documents, where their pairs begin, words, weights, the responsibilities if any are stored, and the part of each document, from
    PHI_ROWS of a block in any order."""
    order = np.lexsort((_ints(rows, "piece"), _ints(rows, "doc_id"), _ints(rows, "part")))
    if (np.diff(order) != 1).any():
        rows = rows.take(pa.array(order))
    word_col = rows.column("words").combine_chunks()
    word, sizes = word_col.flatten().to_numpy(zero_copy_only=False), np.diff(word_col.offsets.to_numpy())
    docs, bounds = _document_runs(np.repeat(_ints(rows, "doc_id"), sizes))
    part = _ints(rows, "part")[(_ints(rows, "piece") == 0) & (sizes > 0)]
    weight = rows.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    stored = _doubles(rows.column("phi"), n_topics)
    return docs, bounds, word, weight, stored if len(stored) else None, part


def _given(give, swept, block, docs, bounds, word, weight, words, n_topics, part):
    """What a kernel of CVB0 returns of the parts that it has swept: "sums" for PHI_ROWS with the sums alone, "phi" for PHI_ROWS with the
    responsibilities, "pairs" for rows `(doc_id, word_id, weight, phi)`."""
    if give == "pairs":
        return pa.concat_tables([pa.table({
            "doc_id": pa.array(docs[d:to][which]), "word_id": pa.array(word[pairs], pa.int32()), "weight": pa.array(weight[pairs]),
            "phi": _lists(now, n_topics)}) for d, to, pairs, which, _, now in swept])
    phi = np.empty((len(word), n_topics)) if give == "phi" else None
    n_dk, sums = _summed(swept, len(docs), len(words), n_topics, weight, phi)
    return (_sums_alone(block, docs, n_dk, words, sums) if phi is None
            else _packed(block, docs, bounds, word, weight, n_dk, words, sums, phi, part))


def cvb0_sync_kernel(n_topics, alpha, beta, n_words, totals, seed, give, portable=True):
    """Kernel: a block of PHI_ROWS taken through one or more sweeps from the sums before each of them.

    A word's `params` hold its sums before the first sweep, then before the second, and so on; `totals` are the topic sums in the same
    order.  It begins from the block's responsibilities, or draws them where the block has none.  `give` is that of `_given`.
    """
    alpha = np.asarray(alpha, dtype=np.float64)

    def run(left, right):
        words, params = _model_rows(right, "params", n_topics * len(totals))
        steps = [(params[:, j * n_topics:(j + 1) * n_topics] + beta, n_words * beta + np.asarray(t, np.float64)) for j, t in enumerate(totals)]
        docs, bounds, word, weight, stored, part = _packed_block(left, n_topics)
        swept = _swept(seed, n_topics, docs, bounds, word, weight, stored, words, alpha, steps, portable)
        return _given(give, swept, left.column("block")[0].as_py(), docs, bounds, word, weight, words, n_topics, part)

    return run


def word_rows(n_topics):
    """`mapInArrow` function: `(word_id, params)` rows from the word sums of blocks."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).flatten()
            if len(words):
                yield pa.RecordBatch.from_arrays([words, _lists(_doubles(batch.column(1), n_topics), n_topics)], names=["word_id", "params"])

    return run


def unpack_phi(n_topics):
    """`mapInArrow` function: `(doc_id, word_id, weight, phi)` rows from rows `(doc_id, words, weights, phi)`."""

    def run(batches):
        for batch in batches:
            words = batch.column(1)
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), words.flatten(), batch.column(2).flatten(), _lists(_doubles(batch.column(3), n_topics), n_topics)],
                names=["doc_id", "word_id", "weight", "phi"])

    return run


def _sweep_in_place(order, phi, n_dk, n_wk, n_k, bounds, at, weight):
    """One sweep over the documents of a part, which brings responsibilities and sums up to date as it goes."""
    lengths = np.diff(bounds)
    if order == "serial":
        steps = ((slice(d, d + 1), np.array([bounds[d] + j])) for d in range(len(lengths)) for j in range(lengths[d]))
    else:
        longest, reach = _by_length(lengths)
        starts, n_dk = bounds[:-1][longest], n_dk[longest]
        steps = ((slice(0, n), starts[:n] + place) for place, n in enumerate(reach))
    for docs, rows in steps:
        old, w = phi[rows], at[rows]
        new = (n_dk[docs] - old) * (n_wk[w] - old) / (n_k - old)
        new /= new.sum(axis=1, keepdims=True)
        change = weight[rows, None] * (new - old)
        n_dk[docs] += change
        np.add.at(n_wk, w, change)
        n_k += change.sum(axis=0)
        phi[rows] = new


def cvb0_kernel(n_topics, alpha, beta, n_words, topic_totals, order="lockstep", seed=0, give="phi", portable=True):
    """Kernel: a block of PHI_ROWS taken through one or more sweeps in place, each part of the block on its own copy of the sums: `serial`
    goes (document, word) by (document, word), `lockstep` updates the j-th words of all documents of a part together; as the documents
    differ, only word and topic sums can be out of date, and only by the rows of one such step.

    `topic_totals` are the topic sums before each sweep, or those of the only one, and a word's `params` its sums in the same order.  It
    begins from the block's responsibilities, or draws them where the block has none.  `give` is that of `_given`.
    """
    alpha = np.asarray(alpha, dtype=np.float64)
    totals = np.asarray(topic_totals, dtype=np.float64).reshape(-1, n_topics)

    def run(left, right):
        words, params = _model_rows(right, "params", n_topics * len(totals))
        docs, bounds, word, weight, stored, part = _packed_block(left, n_topics)

        def swept():
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(docs))
            for d, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                pairs, own = slice(bounds[d], bounds[to]), bounds[d:to + 1] - bounds[d]
                which, at = np.repeat(np.arange(to - d), np.diff(own)), np.searchsorted(words, word[pairs])
                now = _drawn_phi(seed, docs[d:to], which, word[pairs], n_topics, portable) if stored is None else stored[pairs].copy()
                for j, n_k in enumerate(totals):
                    n_dk = _row_sums(which, to - d, now, weight[pairs]) + alpha
                    _sweep_in_place(order, now, n_dk, params[:, j * n_topics:(j + 1) * n_topics] + beta, n_words * beta + n_k, own, at, weight[pairs])
                yield d, to, pairs, which, at, now

        return _given(give, swept(), left.column("block")[0].as_py(), docs, bounds, word, weight, words, n_topics, part)

    return run


def expectation_rows(totals):
    """`mapInArrow` function: psi(parameters) - psi(topic totals), the same speed per cell for any number of topics."""
    base = np_digamma(np.asarray(totals, dtype=np.float64))

    def run(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(base))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np_digamma(values) - base, len(base))],
                                             names=["word_id", "elog"])

    return run


def gamma_rows(n_topics, seed):
    """`mapInArrow` function: a Gamma(100, 0.01) vector for each word or document, the same however rows are split."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = start_vectors("gamma", seed, ids, n_topics)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(values, n_topics)],
                                             names=[batch.schema.names[0], "params"])

    return run
