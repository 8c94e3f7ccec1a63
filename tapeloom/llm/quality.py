"""Quality rules: line sequence labelling by a linear-chain conditional random field.

Every line of a text with a word is content or boilerplate. A conditional random field over line features
(length, shares of capitals, digits, symbols and repeated words, sentence ends, repeated lines) gives the
likeliest labels of the whole sequence (Viterbi); the share of characters in content lines decides whether
a text is kept. Beside it stand fixed base rules on word counts and repeated passages.

Only whole texts carry quality labels. Training therefore starts with every line labelled as its text and
then alternates: texts of low quality get the likeliest labels under the model so far, the model is fitted
again.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.batches import map_texts
from tapeloom.llm.draws import drawn_labels
from tapeloom.sources import read_table

#: Bounds of the training sample: texts of each quality label, bytes and lines of a text (longer ones are not used).
SAMPLE_ROWS = 500
SAMPLE_ROW_BYTES, SAMPLE_ROW_LINES = 16_384, 1_000
#: Lines that are padded to one length and handled together in fitting.
FIT_LINES = 20_000
ROUNDS, ITERATIONS, STEP, DECAY = 3, 80, 0.1, 0.001
WINDOW = 8
LEAST_WORDS = 20
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[ \t-\r]")
_UPPER, _DIGITS, _MARKS, _PIPES = (bytes(x) for x in (range(65, 91), range(48, 58), b"#*$%&<>!=~^{}[]\\/@_", b"|"))
FEATURES = 13


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each text the words that lie in a WINDOW-word window found twice or more in it, first included.

    Windows get exact ranks by doubling: equal pairs of words, pairs of pairs, and so on.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(docs), np.int64)
    known: dict[bytes, int] = {}
    rank = np.array([known.setdefault(w, len(known)) for d in docs for w in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)
    width = 1
    while width < WINDOW:
        rank[:-width] = rank[:-width] * (total + 1) + rank[width:]
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        width *= 2
    at = np.flatnonzero(left >= WINDOW)
    _, group, count = np.unique(doc[at] * (total + 1) + rank[at], return_inverse=True, return_counts=True)
    found = at[count[group] > 1]
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + WINDOW, -1)
    return np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=len(docs))


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of features for each line; every line has a word."""
    seen: set[bytes] = set()
    out = np.empty((len(lines), FEATURES), np.float64)
    for i, raw in enumerate(lines):
        n, words = len(raw), raw.split()
        count = lambda chars: n - len(raw.translate(None, chars))  # noqa: E731, B023
        upper, marks, pipes = count(_UPPER) / n, count(_MARKS) / n, count(_PIPES) / n
        mean = n / len(words)
        out[i] = (
            1, min(1, len(words) / 40), len(words) < 4, upper, upper > 0.3, marks, marks > 0.02, min(1, 20 * pipes), count(_DIGITS) / n,
            words[-1][-1:] in (b".", b"?", b"!", b":"), 1 - len(set(words)) / len(words), raw in seen, min(2, mean / 10),
        )
        seen.add(raw)
    return out


class LineModel:
    """Weights of a two-label chain: emissions from features, transitions between neighbours."""

    def __init__(self):
        self.w, self.t, self.least_share = np.zeros((FEATURES, 2)), np.zeros((2, 2)), 0.5

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """Likeliest labels (1 content, 0 boilerplate); ties go to content."""
        e = (x @ self.w).tolist()
        (a, b), (c, d) = self.t.tolist()
        s0, s1, back = e[0][0], e[0][1], []
        for e0, e1 in e[1:]:
            from0, from1 = s1 + c >= s0 + a, s1 + d >= s0 + b
            back.append((from0, from1))
            s0, s1 = (s1 + c if from0 else s0 + a) + e0, (s1 + d if from1 else s0 + b) + e1
        at = int(s1 >= s0)
        labels = [at]
        for step in reversed(back):
            at = int(step[at])
            labels.append(at)
        return np.array(labels[::-1])

    def content_share(self, lines: list[bytes]) -> float:
        """Share of the bytes of ``lines`` that lie in content lines; 0 without lines."""
        if not lines:
            return 0.0
        sizes = np.array([len(x) for x in lines], float)
        return float((sizes * self.viterbi(line_features(lines))).sum() / sizes.sum())

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], weight: np.ndarray, iterations: int) -> None:
        """Raise the weighted conditional log likelihood of the label sequences, texts of like length at a time."""
        order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
        parts: list[list[int]] = [[]]
        for i in order:
            if parts[-1] and (len(parts[-1]) + 1) * len(xs[i]) > FIT_LINES:
                parts.append([])
            parts[-1].append(i)
        total, step, state = float(weight @ [len(x) for x in xs]), 0, [np.zeros_like(v) for v in (self.w, self.w, self.t, self.t)]
        for _ in range(iterations):
            found = [self.gradients([xs[i] for i in part], [ys[i] for i in part], weight[part]) for part in parts]
            g_w, g_t = (sum(g[k] for g in found) / total for k in range(2))
            step += 1
            for k, (v, g) in enumerate(((self.w, g_w - DECAY * self.w), (self.t, g_t - DECAY * self.t))):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
                v += STEP * state[2 * k] / (1 - 0.9**step) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)

    def gradients(self, xs: list[np.ndarray], ys: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weighted log likelihood by emissions and transitions."""
        m = max(len(x) for x in xs)
        x, y, on = np.zeros((len(xs), m, FEATURES)), np.zeros((len(xs), m), int), np.zeros((len(xs), m), bool)
        for i, (a, b) in enumerate(zip(xs, ys, strict=True)):
            x[i, : len(a)], y[i, : len(a)], on[i, : len(a)] = a, b, True
        truth = np.eye(2)[y] * on[:, :, None]
        pair = on[:, 1:] & on[:, :-1]
        e = x @ self.w
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for k in range(1, m):
            fwd[:, k] = np.where(on[:, k, None], np.logaddexp.reduce(fwd[:, k - 1, :, None] + self.t, axis=1) + e[:, k], fwd[:, k - 1])
        for k in range(m - 2, -1, -1):
            bwd[:, k] = np.where(on[:, k + 1, None], np.logaddexp.reduce(self.t + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
        p2 = np.exp(fwd[:, :-1, :, None] + self.t + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        seen = np.einsum("nta,ntb,nt->ab", truth[:, :-1], truth[:, 1:], pair * weight[:, None])
        return np.einsum("ntf,nta->fa", x, (truth - p) * weight[:, None, None]), seen - np.einsum("ntab,n->ab", p2, weight)


def lines_of(text: str | None) -> list[bytes]:
    """The lines that have a word."""
    return [x for x in (text or "").encode().split(b"\n") if x.split()]


def train(texts: list[str], good: list[int]) -> LineModel:
    """Fit to texts of low (0) and high (1) quality. Without both kinds everything is content."""
    model = LineModel()
    pairs = [(x, g) for x, g in ((lines_of(t), g) for t, g in zip(texts, good, strict=True)) if x]
    if len({g for _, g in pairs}) < 2:
        model.w[0] = (0, 1)
        return model
    lines, good = [p[0] for p in pairs], np.array([p[1] for p in pairs])
    xs = [line_features(x) for x in lines]
    weight = np.where(good == 1, 1.0, max(1.0, (good == 1).sum() / (good == 0).sum()))
    ys = [np.full(len(x), g) for x, g in zip(xs, good, strict=True)]
    for _ in range(ROUNDS):
        model.fit(xs, ys, weight, ITERATIONS)
        for i in np.flatnonzero(good == 0):
            likely = model.viterbi(xs[i])
            ys[i] = likely if (likely == 0).any() else np.zeros(len(likely), int)
    share = np.array([model.content_share(x) for x in lines])
    cuts = np.linspace(0.05, 0.95, 19)
    right = [((share >= c) == (good == 1)) @ np.where(good == 1, 1.0, (good == 1).sum() / (good == 0).sum()) for c in cuts]
    best = np.flatnonzero(np.isclose(right, max(right)))
    model.least_share = float(cuts[best[len(best) // 2]])
    return model


@functools.lru_cache(maxsize=2)
def _model(blob: bytes, digest: str) -> LineModel:
    return pickle.loads(blob)


def train_on(labelled: DataFrame, text_col: str = "text", label_col: str = "quality") -> LineModel:
    """Fit on at most SAMPLE_ROWS texts of each label, those with the smallest hashes; nulls and longer texts are not used."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("y"))
    lines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = rows.where(F.octet_length("text").between(1, SAMPLE_ROW_BYTES) & (lines < SAMPLE_ROW_LINES)).withColumn("h", F.xxhash64("text"))
    taken = [r for label in (0, 1) for r in rows.where(F.col("y") == label).orderBy("h", "text").limit(SAMPLE_ROWS).collect()]
    return train([r["text"] for r in taken], [r["y"] for r in taken])


def judge_texts(df: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, ``content_share`` and ``kept`` of every row.

    Null and empty texts have no words and fail. Repeated and null ids are kept row by row, further columns
    are left out, an empty table gives an empty result.
    """
    blob = pickle.dumps(model)
    digest = hashlib.sha256(blob).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(blob)

    def fn(texts: list) -> dict:
        own = _model(shared.value, digest)
        texts = [t or "" for t in texts]
        words = [t.encode().split() for t in texts]
        lines = [lines_of(t) for t in texts]
        n, repeated = np.array([len(w) for w in words], np.int64), repeat_words(words)
        failed = (n < LEAST_WORDS) | (100 * repeated > 30 * n)
        share = np.array([own.content_share(x) for x in lines])
        return {
            "n_words": n, "word_chars": [len(_SPACE.sub("", t)) for t in texts], "n_symbols": [len(_SYMBOLS.findall(t)) for t in texts],
            "n_dup_lines": [len(x) - len(set(x)) for x in lines], "n_repeat_words": repeated, "base_failed": failed,
            "kept": ~failed & (share >= own.least_share), "content_share": share,
        }

    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return map_texts(df, [id_col], text_col, fn, out)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row of ``documents``; see :func:`judge_texts` for nulls, repeats and empty tables."""
    docs = read_table(spark, sf_dir, "documents")
    labels = drawn_labels(read_table(spark, sf_dir, "labels"), 2 * SAMPLE_ROWS, "quality")
    return judge_texts(docs, train_on(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")))
