"""Toxicity by a bidirectional GRU with attention pooling, in numpy.

A text's words (as in decontamination) are read in overlapping windows of
`WINDOW` words, `STEP` apart; every window of every whole text is scored, and a
logistic regression on a text's best windows, of ranks `RANKS`, and its length
makes its score: a word that clean texts hold once stands in two windows only. A word's input has a word part
(a hashed embedding and the word's log-odds in toxic documents) and a character
part (the mean embedding of its hashed character 3- to 5-grams, and the mean
and greatest of their log-odds). Two GRUs read the window from both ends;
attention weighs their states; a logistic unit reads the weighted sum.

Training is multiple-instance: a document is as toxic as its most toxic window,
so windows are chosen by the current model, first by log-odds, then trained on
by Adam with hand-written back-propagation through time. Log-odds that a
document is trained on come from the other half of the sample, so they don't
hold its own label; a quarter of the sample is set aside for the regression.
Each class is dealt over the halves and the quarter by itself. The sample is
bounded by two documented parameters: up to `rows` labelled documents of each
class in the order of a hash, and of these, in that order, those that start
within the first `most_bytes` of text; none is left out for its length. One
executor task fits the model, and a few MB, however large the corpus, come to
the driver and are broadcast. Seeds are fixed, so reruns agree.

Only the text is an input of a score. Rows whose crc32(id as text) mod 3 is 1
are held out: their labels are never read.

Defined results: a text without words has nothing toxic and scores 0; a label row
that repeats an id counts once, toxic if any is, and of documents that share an
id the least text is learned from; null labels are no labels; a null id is not
held out; without labels of both classes every score is below 1e-9, and a class
of under three rows is fitted and set aside with all its rows. Further columns
of documents are kept, save those named like a result, which the result
replaces; in the stage every column is kept.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintet.llm import common, shingles

WINDOW, STEP = 32, 16
HIDDEN, EMBED, BUCKETS, TRAINED = 8, 4, 1 << 19, 1 << 14
INPUT = 2 * EMBED + 3
GRAMS = (3, 4, 5)
ROWS, BYTES = 2500, 32 << 20
THRESHOLD = 0.7
#: Text that is scored at once; a word's inputs take some hundred times its bytes.
SLICE = 1 << 20
RANKS = (1, 3, 5, 7)
U, F32 = np.uint64, np.float32


class Words:
    """The words of a slice of texts: distinct ones with their hashed parts, and each text's sequence."""

    def __init__(self, texts: list[bytes | None]):
        whole = b" ".join([t or b"" for t in texts] + [b""])
        raw = np.frombuffer(whole.translate(common.LOWER_WORDS), np.uint8)
        inside = np.concatenate([[False], raw != 0x20, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        hashes = shingles.hashes_of(raw, starts, ends)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        distinct, at, sequence, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words side by side in memory
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        distinct, at, self.sequence = distinct[order], at[order], place[sequence].astype(np.int32)
        self.word = (distinct & U(BUCKETS - 1)).astype(np.int64)
        self.grams, self.gram_first = self.grams_of(raw, starts[at], ends[at])

    @staticmethod
    def grams_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed grams of each distinct word, with its edges marked, one word after another."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        size = ends - starts + 2
        first = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(first, size)
        place = np.repeat(starts, size) + inner - 1
        marked = raw[np.clip(place, 0, len(raw) - 1)].astype(np.int64)
        marked[first], marked[first + size - 1] = 0, 1
        left = np.repeat(size, size) - inner
        code, found, of = np.zeros(len(marked), U), [], []
        owner = np.repeat(np.arange(len(size)), size)
        padded = np.concatenate([marked, np.zeros(max(GRAMS), np.int64)])
        for k in range(max(GRAMS)):
            code = code * U(0x9E3779B97F4A7C15) + padded[k : k + len(marked)].astype(U) + U(k + 1)
            if k + 1 in GRAMS:
                some = np.flatnonzero((left > k) | ((inner == 0) & (left <= k)))
                found.append((shingles.mix(code[some]) & U(BUCKETS - 1)).astype(np.int32))
                of.append(owner[some])
        of, found = np.concatenate(of), np.concatenate(found)
        order = np.argsort(of, kind="stable")
        return found[order], np.searchsorted(of[order], np.arange(len(size) + 1))


def log_odds(parts: list[Words], labels: np.ndarray, prior: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Of each word bucket and gram bucket, by the documents that hold it; shrunk to 0 by `prior` documents."""
    share = labels.mean()
    tables = []
    for kind in ("word", "gram"):
        counts = np.zeros((2, BUCKETS), F32)
        at = 0
        for p in parts:
            for a, b in zip(p.first[:-1], p.first[1:], strict=True):
                types = np.unique(p.sequence[a:b])
                if kind == "word":
                    own = np.unique(p.word[types])
                else:
                    n = p.gram_first[types + 1] - p.gram_first[types]
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    own = np.unique(p.grams[np.repeat(p.gram_first[types], n) + inner])
                counts[int(labels[at]), own] += 1
                at += 1
        tables.append((np.log((counts[1] + prior * share) / (counts[0] + prior * (1 - share))) - np.log(share / (1 - share))).astype(F32))
    return tables[0], tables[1]


def inputs(words: Words, odds, tables: dict[str, np.ndarray], at_once: int = 1 << 15) -> np.ndarray:
    """The input of each distinct word; so many at a time, since a word has some thirty grams."""
    out = np.empty((len(words.word), INPUT), F32)
    for a in range(0, len(words.word), at_once):
        word, first = words.word[a : a + at_once], words.gram_first[a : a + at_once + 1]
        grams, cut = words.grams[first[0] : first[-1]], first[:-1] - first[0]
        n = np.maximum(1, np.diff(first)).astype(F32)[:, None]
        own = odds[1][grams]
        out[a : a + at_once] = np.concatenate([
            tables["words"][word & TRAINED - 1], np.add.reduceat(tables["grams"][grams & TRAINED - 1], cut, axis=0) / n,
            odds[0][word][:, None], np.add.reduceat(own, cut)[:, None] / n, np.maximum.reduceat(own, cut)[:, None],
        ], axis=1)
    return out


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows of word numbers, one past the last for none; each row's text)."""
    n = np.diff(words.first)
    count = np.maximum(1, -(-(n - STEP) // STEP))
    text = np.repeat(np.arange(len(n)), count)
    start = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STEP
    place = (words.first[:-1][text] + start).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    rows = np.append(words.sequence, np.int32(0))[np.minimum(place, len(words.sequence))]
    rows[place >= words.first[1:][text][:, None]] = len(words.word)
    return rows, text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters, forward and backward passes."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: r.normal(0, scale, shape).astype(F32)
        h = HIDDEN
        self.p = {
            "words": normal(TRAINED, EMBED, scale=0.1), "grams": normal(TRAINED, EMBED, scale=0.1),
            "in": normal(2, INPUT, 3 * h, scale=0.3), "in_bias": np.zeros((2, 3 * h), F32),
            "own": normal(2, h, 3 * h, scale=0.3), "own_bias": np.zeros((2, h), F32),
            "look": normal(2 * h, h, scale=0.3), "look_bias": np.zeros(h, F32), "weigh": normal(h, scale=0.3),
            "out": normal(2 * h, scale=0.3), "out_bias": np.zeros(1, F32),
        }
        self.odds = (np.zeros(BUCKETS, F32), np.zeros(BUCKETS, F32))
        self.scale = np.zeros(len(RANKS) + 2)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both GRUs; the last row is no word, which keeps the state."""
        out = np.einsum("ni,dij->dnj", x, self.p["in"], optimize=True) + self.p["in_bias"][:, None]
        none = np.zeros((2, 1, 3 * HIDDEN), F32)
        none[:, :, :HIDDEN] = 30
        return np.ascontiguousarray(np.concatenate([out, none], axis=1))  # take() would copy it whole each time

    def states(self, gates: np.ndarray, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both GRUs at each word: (rows, WINDOW, 2 * HIDDEN)."""
        h, out = HIDDEN, np.empty((*rows.shape, 2 * HIDDEN), F32)
        for d in (0, 1):
            own, bias, state = self.p["own"][d], self.p["own_bias"][d], np.zeros((len(rows), h), F32)
            for t in range(rows.shape[1]) if d == 0 else range(rows.shape[1] - 1, -1, -1):
                g, s = gates[d].take(rows[:, t], axis=0), state @ own
                zr = 1 / (1 + np.exp(-(g[:, : 2 * h] + s[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                q = s[:, 2 * h :] + bias
                n = np.tanh(g[:, 2 * h :] + r * q)
                if keep is not None:
                    keep.append((d, t, state, z, r, q, n))
                state = n + z * (state - n)
                out[:, t, d * h : d * h + h] = state
        return out

    def pooled(self, states: np.ndarray, inside: np.ndarray):
        look = np.tanh(states @ self.p["look"] + self.p["look_bias"])
        weight = np.where(inside, look @ self.p["weigh"], -30)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)) * inside
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        mean = (weight[:, :, None] * states).sum(axis=1)
        return look, weight, mean, mean @ self.p["out"] + self.p["out_bias"][0]

    def logits(self, words: Words, rows: np.ndarray, odds=None, at_once: int = 2048) -> np.ndarray:
        gates = self.projected(inputs(words, odds or self.odds, self.p))
        parts = [rows[a : a + at_once] for a in range(0, len(rows), at_once)]
        return np.concatenate([self.pooled(self.states(gates, r), r < len(words.word))[3] for r in parts]) if parts else np.zeros(0, F32)

    def gradients(self, words: Words, x: np.ndarray, rows: np.ndarray, labels: np.ndarray, weight_of: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss over rows; x holds the inputs of all distinct words."""
        p, h, grad = self.p, HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        used, local = np.unique(rows, return_inverse=True)
        real = used < len(words.word)
        own = np.where(real, used, 0)
        gates = self.projected(x[own[real]])
        local = local.reshape(rows.shape)
        inside = rows < len(words.word)
        keep: list = []
        states = self.states(gates, local if real.all() else np.where(inside, local, gates.shape[1] - 1), keep)
        look, weight, mean, logit = self.pooled(states, inside)
        d_logit = (sigmoid(logit) - labels) * weight_of / len(rows)
        grad["out"], grad["out_bias"] = mean.T @ d_logit, np.array([d_logit.sum()], F32)
        d_mean = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_mean[:, None]
        d_weight = (states * d_mean[:, None]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grad["weigh"] = np.einsum("bt,bth->h", d_score, look, optimize=True)
        d_look = d_score[:, :, None] * p["weigh"] * (1 - look * look)
        grad["look"] = np.einsum("bts,bth->sh", states, d_look, optimize=True)
        grad["look_bias"] = d_look.sum(axis=(0, 1))
        d_states = d_states + d_look @ p["look"].T
        d_words = np.zeros((2, *rows.shape, 3 * h), F32)
        back = [np.zeros((len(rows), h), F32), np.zeros((len(rows), h), F32)]
        for d, t, state, z, r, q, n in reversed(keep):
            dh = back[d] + d_states[:, t, d * h : d * h + h]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (state - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            dq = dn * r
            into = np.concatenate([dz, dr, dq], axis=1)
            grad["own"][d] += state.T @ into
            grad["own_bias"][d] += dq.sum(axis=0)
            back[d] = dh * z + into @ p["own"][d].T
            d_words[d, :, t] = np.concatenate([dz, dr, dn], axis=1)
        d_gates = np.stack([summed(local[inside], d_words[d][inside], int(real.sum())) for d in (0, 1)])
        seen = x[own[real]]
        grad["in"], grad["in_bias"] = np.einsum("ni,dnj->dij", seen, d_gates, optimize=True), d_gates.sum(axis=1)
        d_x = np.einsum("dnj,dij->ni", d_gates, p["in"], optimize=True)
        types = own[real]
        grad["words"] = summed(words.word[types] & TRAINED - 1, d_x[:, :EMBED], TRAINED)
        n = words.gram_first[types + 1] - words.gram_first[types]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        grams = words.grams[np.repeat(words.gram_first[types], n) + inner] & TRAINED - 1
        grad["grams"] = summed(grams, np.repeat(d_x[:, EMBED : 2 * EMBED] / np.maximum(1, n)[:, None], n, axis=0), TRAINED)
        return grad


def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by index, into n rows."""
    out = np.zeros((n, values.shape[1]), F32)
    if len(index):
        order = np.argsort(index, kind="stable")
        ranked = index[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        out[ranked[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def chosen(score: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Each text's n best windows."""
    order = np.lexsort((-score, text))
    rank = np.arange(len(text)) - np.searchsorted(text[order], text[order])
    return np.sort(order[rank < n])


def dealt(labels: np.ndarray) -> list[np.ndarray]:
    """Rows of two halves to fit on and of a quarter set aside; a class of under three rows is in each with all of them."""
    part = np.zeros(len(labels), np.int64)
    for own in (np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)):
        part[own] = np.resize((0, 1, 2, 0, 1, 0, 2, 1), len(own)) if len(own) > 2 else -1
    return [np.flatnonzero((part == k) | (part < 0)) for k in range(3)]


def train(texts: list[bytes], labels: np.ndarray, *, rounds: int = 2, epochs: int = 4, batch: int = 192, steps: int = 150, rate: float = 0.015, seed: int = 11) -> Model:
    """Fit the model; texts come in a fixed order."""
    r, model = np.random.default_rng(seed), Model()
    labels = labels.astype(F32)
    if len(set(labels.tolist())) < 2:
        model.scale[-1] = -30
        return model
    *halves, rest = dealt(labels)
    parts = [Words([texts[i] for i in h]) for h in halves]
    odds = [log_odds([p], labels[h]) for p, h in zip(parts, halves, strict=True)]
    odds.reverse()  # each half is seen with the other's log-odds
    seen = [windows(p) for p in parts]
    clean = 1 / max(1e-6, 1 - float(labels.mean()))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for turn in range(rounds):
        picked = []
        for k in (0, 1):
            rows, text = seen[k]
            if turn:
                score = model.logits(parts[k], rows, odds[k])
            else:
                x = inputs(parts[k], odds[k], model.p)
                strength = np.append(x[:, -3] + x[:, -2], -9)
                score = np.sort(strength[rows], axis=1)[:, -4:].sum(axis=1)
            own = labels[halves[k]][text]
            best, few = chosen(score, text, 1), chosen(score, text, 2)
            chance = np.flatnonzero((r.random(len(text)) < len(halves[k]) / len(text)) & (own == 0))
            picked.append(np.unique(np.concatenate([best[own[best] == 1], few[own[few] == 0], chance])))
        size = min(batch, max(32, sum(map(len, picked)) // 8))  # small samples take small steps, and enough of them
        own_epochs = max(epochs, -(-steps * size // max(1, sum(map(len, picked)))))
        for epoch in range(own_epochs):
            lot = [(k, b) for k in (0, 1) for b in np.array_split(r.permutation(picked[k]), max(1, len(picked[k]) // size))]
            for i in r.permutation(len(lot)):
                k, b = lot[i]
                x = inputs_of(parts[k], odds[k], model.p, seen[k][0][b])
                y = labels[halves[k]][seen[k][1][b]]
                grad = model.gradients(parts[k], x, seen[k][0][b], y, np.where(y == 1, 2.0, 1.0).astype(F32))
                step += 1
                speed = rate * (1 - (turn + epoch / own_epochs) / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, g in grad.items():
                    m, v = moment[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    model.p[name] -= (speed * m / (np.sqrt(v) + 1e-7)).astype(F32)
    known = labels[np.concatenate(halves)]
    model.odds = tuple(log_odds(parts, known))
    own = Words([texts[i] for i in rest])
    rows, text = windows(own)
    model.scale = calibrated(ranked(model.logits(own, rows), text, np.diff(own.first)), labels[rest])
    return model


class inputs_of:  # noqa: N801
    """inputs() of the distinct words of some rows only, by the numbers of all."""

    def __init__(self, words: Words, odds, tables, rows: np.ndarray):
        self.words, self.odds, self.tables = words, odds, tables

    def __getitem__(self, types: np.ndarray) -> np.ndarray:
        w = self.words
        part = object.__new__(Words)
        n = w.gram_first[types + 1] - w.gram_first[types]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        part.word, part.grams = w.word[types], w.grams[np.repeat(w.gram_first[types], n) + inner]
        part.gram_first = np.concatenate([[0], np.cumsum(n)])
        return inputs(part, self.odds, self.tables)


def ranked(logit: np.ndarray, text: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text the logits of its windows of RANKS, those it lacks as clean ones, its length, and 1."""
    order = np.lexsort((-logit, text))
    first = np.searchsorted(text[order], np.arange(len(n) + 1))
    own = np.append(np.clip(logit[order], -8, 8), -8)
    places = first[:-1, None] + np.array(RANKS) - 1
    best = own[np.where(places < first[1:, None], places, len(own) - 1)]
    return np.column_stack([best, np.log1p(n), np.ones(len(n))])


def calibrated(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps on the log loss with a little ridge."""
    w, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - labels) + ridge @ w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_texts(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """The calibrated score of each whole text, over all its windows."""
    words = Words(texts)
    rows, text = windows(words)
    n = np.diff(words.first)
    return np.where(n > 0, sigmoid(ranked(model.logits(words, rows), text, n) @ model.scale), 0.0)


def held_out(column):
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(h, doc_id, text, toxic): up to `rows` labelled documents of each class that aren't held out."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(rows).union(known.filter("toxic = 0").orderBy(*order).limit(rows))
    # at most 2 * rows ids, a bound that doesn't depend on the input
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most_bytes: int = BYTES) -> bytes:
    """A pickled model, fitted by one executor task to the sample."""

    def fit(batches):
        texts, toxic, size = [], [], 0
        for b in batches:
            for text, y in zip(common.utf8(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                if size < most_bytes:
                    texts.append(text)
                    toxic.append(y)
                    size += len(text)
        model = pickle.dumps(train(texts, np.array(toxic, F32)))
        texts.clear()
        common.trimmed()
        yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    one = sample(docs, labels, rows).repartition(1).sortWithinPartitions("h", "doc_id")
    found = one.mapInArrow(fit, "model binary").first()  # an empty sample may have no task at all
    return found["model"] if found else pickle.dumps(train([], np.zeros(0, F32)))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """docs with held_out, score and predicted, by a model fitted to their labelled rows."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, rows, most_bytes))
    docs = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def rate(batches):
        model = pickle.loads(sent.value)
        for b in common.by_bytes(batches, text_col, SLICE):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(model, common.utf8(b.column(text_col))), pa.float64())], names=[*b.schema.names, "score"])
        common.trimmed()

    found = docs.mapInArrow(rate, schema)
    return found.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of `documents`."""
    found = score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't rejected as toxic, in their own columns."""
    own, name, back = common.masked(docs)
    scored = score(own, common.table(spark, sf_dir, "labels"), id_col=name["doc_id"], text_col=name["text"])
    return back(scored.filter("predicted = 0"))
