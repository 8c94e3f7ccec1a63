"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as the concatenation of its word vector (words of the training sample; unknown words share
the zero vector) and the scaled mean of its hashed character n-gram vectors. Forward and backward gated recurrent
layers read a window of words, attention pools their states, a logistic unit scores the window. All
overlapping windows of WINDOW words are scored, one from every word on; a document's score is its largest.

Training is numpy on the driver, from a bounded balanced sample of labelled rows. Only documents are
labelled, so each epoch takes the highest-scoring windows of a document as its examples, out of one at every
STRIDE; the cut is then set on the scores over all windows.
"""

from __future__ import annotations

import functools
import hashlib
import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.batches import map_texts
from tapeloom.llm.draws import drawn_labels
from tapeloom.sources import read_table

#: Bounds of the training sample: rows of each label and bytes of a row (longer rows are not used).
SAMPLE_ROWS = 700
SAMPLE_ROW_BYTES = 12_288
WINDOW, STRIDE = 20, 12
HIDDEN, WORD_DIM, CHAR_DIM = 6, 6, 6
#: Lengths of the character n-grams, their hash buckets, and the scale of their mean.
GRAMS, GRAM_BUCKETS, GRAM_SCALE = (4, 5, 6), 32_768, 3.0
LEAST_ROWS_WITH_WORD = 4
#: Standard errors by which a word must lean to either label before its vector starts with that leaning.
LEAST_LEANING = 4.0
EPOCHS, STEP, BATCH, DECAY = 12, 0.015, 256, 0.001
#: Starts that are tried, texts in all that they may take, and the loss up to which the first is kept (a coin has 0.69).
FITS, FIT_TEXTS, STUCK = 6, 1400, 0.2
#: Share of the rows labelled toxic that training may set aside.
MISLABELLED = 0.05
#: Words whose projections a worker remembers, and windows handled at a time in training and in scoring.
MEMO_WORDS = 300_000
CHUNK = 2048
STARTS = 1024


def words_of(text: str | None) -> list[str]:
    """Lower-case words, with the marks around them."""
    return text.lower().split() if text else []


def core(word: str) -> str:
    """The word without surrounding punctuation."""
    return word.strip(".,;:!?\"'()[]{}*#$%&|<>-_~`") or word


def character_grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of ``<word>``, and for each the word it belongs to, in order."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64) + 2
    owner, room = np.repeat(np.arange(len(words)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    found, owners, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(min(max(GRAMS), len(codes))):
        h[: len(codes) - n] = (h[: len(codes) - n] ^ codes[n:]) * np.uint64(0x9E3779B97F4A7C15)
        if n + 1 in GRAMS:
            at = np.flatnonzero(room > n)
            found.append((h[at] >> np.uint64(40)) % np.uint64(buckets))
            owners.append(owner[at])
    bucket, owner = np.concatenate([*found, []]).astype(np.int64), np.concatenate([*owners, []]).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def gram_means(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled mean gram vector of each word; also buckets, owners and the share of a gram in its word."""
    bucket, owner = character_grams(words, table.shape[0])
    share = GRAM_SCALE / np.maximum(np.bincount(owner, minlength=len(words)), 1).astype(np.float32)
    sums = np.zeros((len(words), table.shape[1]), np.float32)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.array([], int)
    if len(starts):
        sums[owner[starts]] = np.add.reduceat(table[bucket], starts, axis=0)
    return sums * share[:, None], bucket, owner, share


def leaning(count: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Start values from how often rows of label 0 and 1 hold something: standard errors beyond LEAST_LEANING."""
    share = count / rows
    both = count.sum(1) / rows.sum()
    z = (share[:, 1] - share[:, 0]) / np.sqrt(np.maximum(both * (1 - both), 1e-6) * (1 / rows).sum())
    return (np.sign(z) * np.clip(np.abs(z) - LEAST_LEANING, 0, 6) / 3).astype(np.float32)


def windows(ids: list[int]) -> np.ndarray:
    """Matrix of word ids for training, a row a window: one at every STRIDE and one that ends with the last word.

    Fewer than WINDOW words give one row, in which -1 stands past the end.
    """
    if len(ids) < WINDOW:
        return np.array([ids + [-1] * (WINDOW - len(ids))], np.int64)
    starts = np.append(np.arange(0, len(ids) - WINDOW, STRIDE), len(ids) - WINDOW)
    return np.array(ids, np.int64)[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def recur(x: np.ndarray, u: np.ndarray, backward: bool, keep: bool = False):
    """States [T, B, H] of one direction over projected inputs [T, B, 3H]; with ``keep`` also its inner values."""
    steps, h_dim = x.shape[0], u.shape[0]
    h = np.zeros((x.shape[1], h_dim), np.float32)
    out, kept = np.empty((steps, x.shape[1], h_dim), np.float32), [None] * steps
    for t in reversed(range(steps)) if backward else range(steps):
        hu = h @ u
        gates = _sigmoid(x[t, :, : 2 * h_dim] + hu[:, : 2 * h_dim])
        z, r = gates[:, :h_dim], gates[:, h_dim:]
        n = np.tanh(x[t, :, 2 * h_dim :] + r * hu[:, 2 * h_dim :])
        if keep:
            kept[t] = (h, z, r, n, hu[:, 2 * h_dim :])
        h = n + z * (h - n)
        out[t] = h
    return (out, kept) if keep else out


def recur_back(d_out: np.ndarray, kept: list, u: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    steps, b, h_dim = d_out.shape
    d_x, d_u, d_h = np.empty((steps, b, 3 * h_dim), np.float32), np.zeros_like(u), np.zeros((b, h_dim), np.float32)
    for t in range(steps) if backward else reversed(range(steps)):
        h, z, r, n, hu_n = kept[t]
        d = d_h + d_out[t]
        d_an = d * (1 - z) * (1 - n * n)
        d_az = d * (h - n) * z * (1 - z)
        d_ar = d_an * hu_n * r * (1 - r)
        d_hu = np.concatenate([d_az, d_ar, d_an * r], axis=1)
        d_u += h.T @ d_hu
        d_h = d * z + d_hu @ u.T
        d_x[t] = np.concatenate([d_az, d_ar, d_an], axis=1)
    return d_x, d_u


class Network:
    """Parameters, scoring and training."""

    def __init__(self, vocabulary: list[str], prior: np.ndarray, gram_prior: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        words = (0.05 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32)
        words[1:, 0] += prior
        words[0] = 0
        chars = (0.05 * rng.standard_normal((GRAM_BUCKETS, CHAR_DIM))).astype(np.float32)
        chars[:, 0] += 0 if gram_prior is None else gram_prior
        dim = WORD_DIM + CHAR_DIM
        self.p = {"words": words, "chars": chars, "att": init(2 * HIDDEN), "out": init(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": init(dim, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32), f"u{side}": init(HIDDEN, 3 * HIDDEN)}

    def inputs(self, words: list[str]) -> tuple:
        """Input vectors of distinct words, their word rows, gram buckets, owners and shares."""
        cores = [core(w) for w in words]
        rows = np.array([self.vocabulary.get(w, 0) for w in cores], np.int64)
        means, bucket, owner, share = gram_means(cores, self.p["chars"])
        return np.concatenate([self.p["words"][rows], means], axis=1), rows, bucket, owner, share

    def project(self, words: list[str]) -> np.ndarray:
        """Forward and backward gate inputs of distinct words, [n, 6H]."""
        x = self.inputs(words)[0]
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], axis=1)

    def logits(self, projected: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A logit per window. ``projected`` ends with a zero row for places past the end (-1)."""
        out = np.empty(len(rows), np.float32)
        for at in range(0, len(rows), CHUNK):
            ids = rows[at : at + CHUNK].T
            x = projected[ids]
            states = np.concatenate([recur(x[:, :, : 3 * HIDDEN], self.p["uf"], False), recur(x[:, :, 3 * HIDDEN :], self.p["ub"], True)], axis=2)
            weight = self._attention(states, ids)[0]
            out[at : at + CHUNK] = np.einsum("tb,tb->b", weight, states @ self.p["out"]) + self.p["bias"]
        return out

    def best_logits(self, projected: np.ndarray, docs: list[list[int]]) -> np.ndarray:
        """The largest logit of each text of word ids over the windows from every word on; ``projected`` as in :meth:`logits`.

        Texts lie one behind another, those of fewer than WINDOW words filled up with -1; windows over a border do not count.
        """
        lengths = np.array([max(len(d), WINDOW) for d in docs], np.int64)
        ends = np.cumsum(lengths)
        ids = np.full(ends[-1] + WINDOW - 1, -1, np.int64)
        for d, at in zip(docs, ends - lengths, strict=True):
            ids[at : at + len(d)] = d
        out = np.empty(ends[-1], np.float32)
        for at in range(0, len(out), STARTS):
            out[at : at + STARTS] = self._starts(projected, ids[at : at + STARTS + WINDOW - 1])
        out[np.arange(len(out)) > np.repeat(ends - WINDOW, lengths)] = -np.inf
        return np.maximum.reduceat(out, ends - lengths)

    def _starts(self, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A logit for each window of ``ids``; the windows at one step are a slice of the words, so nothing is copied."""
        n, h_dim = len(ids) - WINDOW + 1, HIDDEN
        x = np.ascontiguousarray(projected[ids].T)
        raw, value = np.zeros((WINDOW, n), np.float32), np.zeros((WINDOW, n), np.float32)
        # sigmoid(a) is 1 / (1 + exp(-a)) and tanh(a) is 1 - 2 / (1 + exp(2 a)); the factors go into the inputs
        factor = np.repeat(np.array([-1, 2], np.float32), [2 * h_dim, h_dim])[:, None]
        one, two = np.float32(1), np.float32(2)
        made = np.empty((3 * h_dim + 2, n), np.float32)
        gates, new = made[: 2 * h_dim], made[2 * h_dim : 3 * h_dim]
        with np.errstate(over="ignore"):
            for side, k in (("f", 0), ("b", 1)):
                part = x[k * 3 * h_dim : (k + 1) * 3 * h_dim]
                part *= factor
                heads = [self.p[name][k * h_dim : (k + 1) * h_dim] for name in ("att", "out")]
                u = np.concatenate([self.p[f"u{side}"].T * factor, heads])
                h, before = np.zeros((h_dim, n), np.float32), None
                for t in [*(reversed(range(WINDOW)) if side == "b" else range(WINDOW)), None]:
                    np.matmul(u, h, out=made)
                    if before is not None:  # what the state of the step before gives to the attention
                        raw[before] += made[-2]
                        value[before] += made[-1]
                    before = t
                    if t is None:
                        break
                    gates += part[: 2 * h_dim, t : t + n]
                    np.exp(gates, out=gates)
                    gates += one
                    np.divide(one, gates, out=gates)
                    new *= gates[h_dim:]
                    new += part[2 * h_dim :, t : t + n]
                    np.exp(new, out=new)
                    new += one
                    np.divide(two, new, out=new)
                    np.subtract(one, new, out=new)
                    h -= new
                    h *= gates[:h_dim]
                    h += new
        e = np.exp(4 * np.tanh(raw))
        if (ids < 0).any():
            e *= np.lib.stride_tricks.sliding_window_view(ids >= 0, WINDOW).T
        return (e * value).sum(0) / np.maximum(e.sum(0), 1e-9) + self.p["bias"]

    def _attention(self, states: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.tanh(states @ self.p["att"])
        e = np.where(ids >= 0, np.exp(4 * raw), 0)
        return e / np.maximum(e.sum(0), 1e-9), raw

    def gradients(self, words: list[str], rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over windows ``rows`` of ids into ``words``."""
        p, ids = self.p, rows.T
        x, word_rows, bucket, owner, share = self.inputs(words)
        proj = np.concatenate([np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], axis=1), np.zeros((1, 6 * HIDDEN), np.float32)])
        got = proj[ids]
        fwd, kept_f = recur(got[:, :, : 3 * HIDDEN], p["uf"], False, True)
        bwd, kept_b = recur(got[:, :, 3 * HIDDEN :], p["ub"], True, True)
        states = np.concatenate([fwd, bwd], axis=2)
        a, raw = self._attention(states, ids)
        value = states @ p["out"]
        d_logit = ((_sigmoid((a * value).sum(0) + p["bias"]) - target) * weight / weight.sum()).astype(np.float32)
        d_value = a * d_logit
        d_raw = 4 * a * (value - (a * value).sum(0)) * d_logit * (1 - raw * raw)
        d_states = d_value[:, :, None] * p["out"] + d_raw[:, :, None] * p["att"]
        g = {"out": np.einsum("tb,tbh->h", d_value, states), "att": np.einsum("tb,tbh->h", d_raw, states), "bias": d_logit.sum(keepdims=True)}
        d_xf, g["uf"] = recur_back(d_states[:, :, :HIDDEN], kept_f, p["uf"], False)
        d_xb, g["ub"] = recur_back(d_states[:, :, HIDDEN:], kept_b, p["ub"], True)
        d_proj = np.zeros_like(proj)
        np.add.at(d_proj, ids.ravel(), np.concatenate([d_xf, d_xb], axis=2).reshape(-1, 6 * HIDDEN))
        d_f, d_b = d_proj[:-1, : 3 * HIDDEN], d_proj[:-1, 3 * HIDDEN :]
        g |= {"wf": x.T @ d_f, "wb": x.T @ d_b, "bf": d_f.sum(0), "bb": d_b.sum(0)}
        d_in = d_f @ p["wf"].T + d_b @ p["wb"].T
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], word_rows, d_in[:, :WORD_DIM])
        g["words"][0] = 0
        np.add.at(g["chars"], bucket, (d_in[:, WORD_DIM:] * share[:, None])[owner])
        return g


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Fit a network to labelled texts. Without both labels it scores every text alike.

    From few texts a small network can get stuck, or learn texts by heart, from a bad start; then it starts again, FITS times at most and over FIT_TEXTS texts
    in all, and the one with the least loss on the training texts is taken.
    """
    best, least = None, np.inf
    for k in range(min(FITS, max(1, FIT_TEXTS // max(1, len(texts))))):
        net, loss = _fit(texts, labels, seed + k)
        if loss < least:
            best, least = net, loss
        if least <= STUCK:
            break
    return best


def _fit(texts: list[str], labels: list[int], seed: int) -> tuple[Network, float]:
    """A network from one start, and its mean logistic loss over both labels alike (each text by its highest window, before the cut is set)."""
    docs = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    seen: dict[str, np.ndarray] = {}
    for d, label in zip(docs, labels, strict=True):
        for w in {core(w) for w in d}:
            seen.setdefault(w, np.zeros(2, np.int64))[label] += 1
    kept = sorted(w for w, n in seen.items() if n.sum() >= LEAST_ROWS_WITH_WORD)
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    grams = np.zeros((GRAM_BUCKETS, 2))
    for d, label in zip(docs, labels, strict=True):
        grams[np.unique(character_grams(sorted({core(w) for w in d}), GRAM_BUCKETS)[0]), label] += 1
    net = Network(kept, leaning(np.array([seen[w] for w in kept], float).reshape(-1, 2), n), leaning(grams, n), seed)
    docs_at = [i for i, d in enumerate(docs) if d]
    if len(set(y[docs_at].tolist())) < 2:
        return net, 0.0
    index: dict[str, int] = {}
    ids = [[index.setdefault(w, len(index)) for w in docs[i]] for i in docs_at]
    rows = [windows(d) for d in ids]
    words, doc_of = list(index), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    rows, y = np.concatenate(rows), y[docs_at]
    rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
    for epoch in range(EPOCHS):
        logit = net.logits(np.concatenate([net.project(words), np.zeros((1, 6 * HIDDEN), np.float32)]), rows)
        order = np.lexsort((-logit, doc_of))
        first = np.flatnonzero(np.r_[True, doc_of[order][1:] != doc_of[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        if epoch == 0:  # no opinion yet: the windows whose words stand out most in toxic rows
            x = net.inputs(words)[0]
            lift = np.concatenate([x[:, 0] + x[:, WORD_DIM], [0]])[rows].clip(0).sum(1)
            order = np.lexsort((-lift, doc_of))
        picked = order[(rank < 1) | ((y[doc_of[order]] == 0) & ((rank < 4) | (rng.random(len(order)) < 0.15)))]
        target = y[doc_of[picked]]
        if epoch:  # the toxic rows that look least toxic may be mislabelled; they don't teach in this epoch
            keep = (target == 0) | (logit[picked] >= np.quantile(logit[picked][target == 1], MISLABELLED))
            picked, target = picked[keep], target[keep]
        weight = np.where(target == 1, (target == 0).sum() / max(1, (target == 1).sum()), 1.0).astype(np.float32)
        shuffled = rng.permutation(len(picked))
        for at in range(0, len(picked), BATCH):
            batch = shuffled[at : at + BATCH]
            local, inverse = np.unique(rows[picked[batch]], return_inverse=True)
            inverse = inverse.reshape(-1, WINDOW) - (local[0] < 0)
            g = net.gradients([words[i] for i in local[local >= 0]], inverse, target[batch], weight[batch])
            step += 1
            g["words"] += DECAY * net.p["words"] * (np.abs(g["words"]).sum(1, keepdims=True) > 0) * (np.arange(WORD_DIM) > 0)
            g["chars"] += DECAY * net.p["chars"]
            for k, d in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.98 * v.get(k, 0) + 0.02 * d * d
                net.p[k] -= (STEP * (0.97**epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    best = net.best_logits(np.concatenate([net.project(words), np.zeros((1, 6 * HIDDEN), np.float32)]), ids)
    loss = np.logaddexp(0, np.where(y == 1, -best, best))
    net.p["bias"] = net.p["bias"] - np.float32(_cut(best, y))
    return net, float((loss[y == 1].mean() + loss[y == 0].mean()) / 2)


def _cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest F1 of ``score >= cut``; within the gap that gives it, the one nearest to 0."""
    order = np.argsort(-score)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    high, low = float(score[order[k]]), float(score[order[k + 1]]) if k + 1 < len(y) else -np.inf
    return min(max(0.0, low + 0.1 * min(1.0, high - low)), high)


class Scorer:
    """Scores texts with a trained network, remembering the projections of words."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((MEMO_WORDS + 1, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list) -> np.ndarray:
        """A score from 0 to 1 per text; a text without words scores 0."""
        docs = [words_of(t) for t in texts]
        fresh = list({w for d in docs for w in d} - self.index.keys())
        if len(self.index) + len(fresh) > MEMO_WORDS:
            self.forget()
            fresh = list({w for d in docs for w in d})
        if len(fresh) > MEMO_WORDS:  # one slice of extraordinary variety: its own table, not remembered
            own = Scorer(self.net)
            own.table = np.zeros((len(fresh) + 1, 6 * HIDDEN), np.float32)
            own._learn(fresh)
            return own._score(docs)
        self._learn(fresh)
        return self._score(docs)

    def _learn(self, fresh: list[str]) -> None:
        if fresh:
            at = len(self.index)
            self.table[at : at + len(fresh)] = self.net.project(fresh)
            self.index.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def _score(self, docs: list[list[str]]) -> np.ndarray:
        find, out = self.index.__getitem__, np.zeros(len(docs))
        held = [i for i, d in enumerate(docs) if d]
        if held:
            out[held] = _sigmoid(self.net.best_logits(self.table, [list(map(find, docs[i])) for i in held]).astype(float))
        return out


@functools.lru_cache(maxsize=1)
def _scorer(blob: bytes, digest: str) -> Scorer:
    return Scorer(pickle.loads(blob))


def forget_scorer() -> None:
    """Let go of the scorer and its words (about 100 MB), which a worker would hold through all later stages."""
    _scorer.cache_clear()


def train_on(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fit on at most SAMPLE_ROWS rows of each label, those with the smallest text hashes.

    Rows with a null text or label, and texts beyond SAMPLE_ROW_BYTES, are not used for fitting.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("y"))
    rows = rows.where(F.octet_length("text").between(1, SAMPLE_ROW_BYTES)).withColumn("h", F.xxhash64("text"))
    taken = [r for label in (0, 1) for r in rows.where(F.col("y") == label).orderBy("h", "text").limit(SAMPLE_ROWS).collect()]
    return train([r["text"] for r in taken], [r["y"] for r in taken])


def score_texts(df: DataFrame, net: Network, key_cols: list | None = None, text_col: str = "text", keep: bool = False) -> DataFrame:
    """Key columns, then ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Null and empty texts, and texts of white space only, score 0. Repeated rows are kept, further columns
    are left out, an empty table gives an empty result. With ``keep`` a worker keeps the scorer and its words from task to
    task, for jobs that have no later stages.
    """
    blob = pickle.dumps(net)
    digest = hashlib.sha256(blob).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(blob)

    def fn(texts: list) -> dict:
        score = _scorer(shared.value, digest)(texts)
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return map_texts(df, key_cols or ["doc_id"], text_col, fn, "score double, predicted int", done=None if keep else forget_scorer)


def held_out_rows(key: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def trained_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Network:
    """The network learned from labelled rows of ``docs`` that are not held out, on a bounded draw of labels."""
    labels = drawn_labels(read_table(spark, sf_dir, "labels").where(~held_out_rows()), 2 * SAMPLE_ROWS, "toxic")
    return train_on(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of ``documents``, learned from rows that are not held out; see :func:`score_texts` for nulls."""
    docs = read_table(spark, sf_dir, "documents")
    return score_texts(docs, trained_on_labels(spark, docs, sf_dir), ["doc_id", held_out_rows().alias("held_out")], keep=True)
