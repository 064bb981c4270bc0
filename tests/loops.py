"""Plain numpy loops written from the equations; the jobs are compared against them on small corpora."""

import hashlib
import math

import numpy as np

from topicspark.functions.special import np_digamma, np_lgamma


def uniform(seed, *keys):
    text = ":".join(str(k) for k in (seed, *keys))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2.0 ** 32


def near_one(seed, *keys):
    return 1.0 + 0.1 * math.sqrt(3.0) * (2.0 * uniform(seed, *keys) - 1.0)


def tiny_corpus():
    """doc -> {word: freq}; V = 6."""
    return {0: {0: 2, 1: 1, 3: 4}, 1: {1: 3, 2: 2}, 2: {3: 1, 4: 5, 5: 1}, 3: {0: 1, 2: 1, 5: 6}}


def bow_rows(docs):
    return [(d, w, f) for d, words in docs.items() for w, f in sorted(words.items())]


def start_lambda(n_words, k, seed):
    return np.array([[near_one(seed, w, t) for t in range(k)] for w in range(n_words)])


def e_step(words, lam, alpha, seed, doc, max_iter, tol):
    """gamma, {word: n * phi}, score for one document; lam is V x K."""
    k = lam.shape[1]
    elog = np_digamma(lam) - np_digamma(lam.sum(axis=0))
    gamma = np.array([near_one(seed, doc, t) for t in range(k)])
    stats = {}
    for _ in range(max_iter):
        mean = np_digamma(gamma) - np_digamma(gamma.sum())
        new = np.full(k, alpha)
        for w, n in words.items():
            phi = np.exp(elog[w] + mean)
            phi = phi / (phi.sum() + 1e-100)
            stats[w] = n * phi
            new = new + n * phi
        change = np.abs(new - gamma).sum() / k
        gamma = new
        if change < tol:
            break
    mean = np_digamma(gamma) - np_digamma(gamma.sum())
    score = sum(n * math.log(np.exp(elog[w] + mean).sum()) for w, n in words.items())
    score += ((alpha - gamma) * mean).sum() + (np_lgamma(gamma) - math.lgamma(alpha)).sum()
    score += math.lgamma(alpha * k) - math.lgamma(gamma.sum())
    return gamma, stats, score


def perplexity(lam, eta, score, n_tokens, n_batch, n_docs):
    v, k = lam.shape
    elog = np_digamma(lam) - np_digamma(lam.sum(axis=0))
    bound = score * n_docs / n_batch + ((eta - lam) * elog).sum() + (np_lgamma(lam) - math.lgamma(eta)).sum()
    bound += sum(math.lgamma(eta * v) - math.lgamma(t) for t in lam.sum(axis=0))
    return math.exp(-bound * n_batch / (n_docs * n_tokens))


def online_vb(docs, n_words, k, batch, alpha, eta, tau0, kappa, max_iter, tol, seed):
    lam = start_lambda(n_words, k, seed)
    order, history = sorted(docs), []
    for t in range(0, math.ceil(len(order) / batch)):
        part = order[t * batch:(t + 1) * batch]
        ss, score, n_tokens = np.zeros_like(lam), 0.0, 0
        for d in part:
            _, stats, s = e_step(docs[d], lam, alpha, seed, d, max_iter, tol)
            score += s
            for w, x in stats.items():
                ss[w] += x
                n_tokens += docs[d][w]
        history.append(perplexity(lam, eta, score, n_tokens, len(part), len(order)))
        rho = (tau0 + t) ** -kappa
        lam = (1 - rho) * lam + rho * (eta + len(order) / len(part) * ss)
    return lam, history


def scvb0_document(words, n_phi, n_z, alpha, beta, n_words, seed, doc, max_iter, rate):
    k = n_phi.shape[1]
    theta = np.array([near_one(seed, doc, t) for t in range(k)])
    total, step, stats = sum(words.values()), 0, {w: np.zeros(k) for w in words}
    for sweep in range(max_iter + 1):
        for w in sorted(words):
            for _ in range(words[w]):
                phi = (alpha + theta) * (beta + n_phi[w]) / (n_words * beta + n_z)
                phi = phi / (phi.sum() + 1e-100)
                if sweep == max_iter:
                    stats[w] = stats[w] + phi
                rho = max(0.0, rate[0] * (rate[1] + step) ** -rate[2])
                theta = (1 - rho) * theta + rho * total * phi
                step += 1
    return theta, stats


def cvb0_sweep_in_place(phi, docs, n_words, k, alpha, beta, weight):
    """phi: {(doc, word): K vector}; visits documents and words in ascending order."""
    n_w, n_k = np.zeros((n_words, k)), np.zeros(k)
    n_d = {d: np.zeros(k) for d in docs}
    for (d, w), p in phi.items():
        n_w[w] += weight(d, w) * p
        n_d[d] += weight(d, w) * p
    n_k = n_w.sum(axis=0)
    out = {}
    for d, w in sorted(phi):
        old = phi[d, w]
        new = (alpha + n_d[d] - old) * (beta + n_w[w] - old) / (n_words * beta + n_k - old)
        new = new / new.sum()
        change = weight(d, w) * (new - old)
        n_d[d] += change
        n_w[w] += change
        n_k += change
        out[d, w] = new
    return out


def cvb0_sweep_sync(phi, docs, n_words, k, alpha, beta):
    n_w, n_d = np.zeros((n_words, k)), {d: np.zeros(k) for d in docs}
    for (d, w), p in phi.items():
        n_w[w] += p
        n_d[d] += p
    n_k = n_w.sum(axis=0)
    out = {}
    for (d, w), old in phi.items():
        new = (alpha + n_d[d] - old) * (beta + n_w[w] - old) / (n_words * beta + n_k - old)
        out[d, w] = new / new.sum()
    return out


def gibbs_serial(docs, z, n_words, k, alpha, beta, draw, n_sweeps):
    """docs: {doc: [word, ...]}, z: {doc: [topic, ...]}; one chain over all documents in order, with `draw(doc, place)`."""
    n_kw, n_k, n_d = np.zeros((n_words, k)), np.zeros(k), {d: np.zeros(k) for d in docs}
    for d in docs:
        for w, t in zip(docs[d], z[d]):
            n_kw[w, t] += 1
            n_k[t] += 1
            n_d[d][t] += 1
    for _ in range(n_sweeps):
        for d in sorted(docs):
            for i, w in enumerate(docs[d]):
                t = z[d][i]
                n_kw[w, t] -= 1
                n_k[t] -= 1
                n_d[d][t] -= 1
                p = (n_kw[w] + beta) / (n_k + n_words * beta) * (n_d[d] + alpha)
                c = np.cumsum(p)
                t = min(int(np.searchsorted(c, draw(d, i) * c[-1], side="left")), k - 1)
                n_kw[w, t] += 1
                n_k[t] += 1
                n_d[d][t] += 1
                z[d][i] = t
    return z


def loglik(n_kw, n_dk, alpha, beta):
    """n_kw: K x V dense, n_dk: D x K dense."""
    k, v = n_kw.shape
    out = 0.0
    for t in range(k):
        out += -math.lgamma(n_kw[t].sum() + v * beta) - v * math.lgamma(beta) + math.lgamma(v * beta)
        out += sum(math.lgamma(x + beta) for x in n_kw[t])
    for row in n_dk:
        out += -math.lgamma(row.sum() + sum(alpha)) + math.lgamma(sum(alpha))
        out += sum(math.lgamma(x + a) - math.lgamma(a) for x, a in zip(row, alpha))
    return out


def planted(n_docs=200, n_topics=5, words_per_topic=20, length=40, seed=7):
    """Documents that use the words of one or two disjoint topics."""
    rng = np.random.default_rng(seed)
    docs = {}
    for d in range(n_docs):
        mix = rng.dirichlet([0.1] * n_topics)
        words = {}
        for t in rng.choice(n_topics, size=length, p=mix):
            w = int(t * words_per_topic + rng.integers(words_per_topic))
            words[w] = words.get(w, 0) + 1
        docs[d] = words
    return docs
