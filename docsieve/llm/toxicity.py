"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.shared import arrow_map, slices, text_of

# Longer runs of letters are read as several words, so that no word is cut.
WORD = re.compile(r"\w{1,32}")
# Each passage of up to WINDOW - STRIDE + 1 words lies whole in some window.
WINDOW, STRIDE = 48, 16
# Between the windows that are learned from.
LEARN_STRIDE = 32
WORD_BUCKETS, CHAR_BUCKETS = 1 << 16, 1 << 17
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 16, 10, 8
# Distinct words whose inputs are remembered by a task.
MEMO_WORDS = 400_000


@dataclass(frozen=True)
class Training:
    """At most ``rows`` labelled rows of each label are learned from, of at most ``chars`` characters each.

    There are more epochs, 40 at most, where fewer rows would make less than ``steps`` steps.
    """

    rows: int = 2500
    chars: int = 20_000
    epochs: int = 3
    steps: int = 100
    windows: int = 30_000
    batch: int = 96
    rate: float = 0.01
    floor: float = 1e-5
    seed: int = 7


def features(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its bucket; the buckets of the sequences of 3 to 5 bytes of all words, borders marked; how many each has."""
    if len(words) > at_once:
        parts = [features(words[i : i + at_once]) for i in range(0, len(words), at_once)]
        return tuple(np.concatenate(column) for column in zip(*parts))
    buckets = np.fromiter((zlib.crc32(w.encode()) % WORD_BUCKETS for w in words), np.int64, len(words))
    edged = [f"^{w}$".encode() for w in words]
    size = np.fromiter(map(len, edged), np.int64, len(words))
    data = np.frombuffer(b"".join(edged), np.uint8).astype(np.uint32)
    begin = np.append(0, np.cumsum(size)[:-1])
    rest = np.repeat(begin + size, size) - np.arange(len(data))
    grams, whose = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(rest >= n)
        mixed = np.full(len(at), n, np.uint32)
        for i in range(n):
            mixed = (mixed ^ data[at + i]) * np.uint32(0x01000193)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        grams.append((mixed >> np.uint32(15)).astype(np.int64) % CHAR_BUCKETS)
        whose.append(np.repeat(np.arange(len(words)), np.maximum(size - n + 1, 0)))
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return buckets, np.concatenate(grams).astype(np.int32)[order], np.bincount(whose, minlength=len(words))


def windows_of(words: int, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Overlapping windows over so many words, one every ``stride`` words; the last ends at the last word."""
    if words <= WINDOW:
        return [(0, words)] if words else []
    starts = list(range(0, words - WINDOW, stride)) + [words - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def new_model(seed: int) -> dict[str, np.ndarray]:
    dice = np.random.default_rng(seed)
    size = WORD_SIZE + CHAR_SIZE

    def normal(*shape, scale):
        return (dice.standard_normal(shape) * scale).astype(np.float32)

    model = {
        "word": np.zeros((WORD_BUCKETS, WORD_SIZE), np.float32),
        "char": np.zeros((CHAR_BUCKETS, CHAR_SIZE), np.float32),
        "attend": normal(2 * HIDDEN, ATTENTION, scale=0.4),
        "attend_bias": np.zeros(ATTENTION, np.float32),
        "query": normal(ATTENTION, scale=0.4),
        "out": normal(2 * HIDDEN, scale=0.4),
        "out_bias": np.full(1, -1, np.float32),
    }
    for side in ("left", "right"):
        model[f"{side}_in"] = normal(size, 3 * HIDDEN, scale=0.5)
        model[f"{side}_bias"] = np.zeros(3 * HIDDEN, np.float32)
        model[f"{side}_state"] = normal(HIDDEN, 3 * HIDDEN, scale=0.25)
    return model


def _run_side(inputs, mask, state_weights, keep_steps: bool):
    """One direction over (steps, windows, 3 * HIDDEN) inputs; states of all steps, and what the gradient needs."""
    steps, count = mask.shape
    state = np.zeros((count, HIDDEN), np.float32)
    states = np.empty((steps, count, HIDDEN), np.float32)
    saved = []
    for t in range(steps):
        from_state = state @ state_weights
        gates = _sigmoid(inputs[t, :, : 2 * HIDDEN] + from_state[:, : 2 * HIDDEN])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        fresh = np.tanh(inputs[t, :, 2 * HIDDEN :] + reset * from_state[:, 2 * HIDDEN :])
        new = fresh + update * (state - fresh)
        if keep_steps:
            saved.append((state, update, reset, fresh, from_state[:, 2 * HIDDEN :]))
        live = mask[t][:, None]
        state = np.where(live, new, state)
        states[t] = state
    return states, saved


def _back_side(grad_states, mask, state_weights, saved):
    """Gradients of one direction's inputs and state weights."""
    steps, count = mask.shape
    grad_inputs = np.zeros((steps, count, 3 * HIDDEN), np.float32)
    grad_weights = np.zeros_like(state_weights)
    carried = np.zeros((count, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        state, update, reset, fresh, inner = saved[t]
        carried = carried + grad_states[t]
        live = mask[t][:, None]
        grad = np.where(live, carried, 0)
        passed = np.where(live, 0, carried)
        of_fresh = grad * (1 - update) * (1 - fresh * fresh)
        of_update = grad * (state - fresh) * update * (1 - update)
        of_reset = of_fresh * inner * reset * (1 - reset)
        grad_inputs[t] = np.concatenate([of_update, of_reset, of_fresh], axis=1)
        of_product = np.concatenate([of_update, of_reset, of_fresh * reset], axis=1)
        grad_weights += state.T @ of_product
        carried = passed + grad * update + of_product @ state_weights.T
    return grad_inputs, grad_weights


def forward(model: dict, left: np.ndarray, right: np.ndarray, mask: np.ndarray, keep_steps: bool = False):
    """Logits of windows, from the two directions' inputs (steps, windows, 3 * HIDDEN) and the mask (steps, windows)."""
    ahead, saved_ahead = _run_side(left, mask, model["left_state"], keep_steps)
    back, saved_back = _run_side(right[::-1], mask[::-1], model["right_state"], keep_steps)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    hidden = np.tanh(states @ model["attend"] + model["attend_bias"])
    scores = np.where(mask, hidden @ model["query"], np.float32(-1e9))
    weights = np.exp(scores - scores.max(axis=0))
    weights /= weights.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weights, states)
    logits = pooled @ model["out"] + model["out_bias"][0]
    return logits, (saved_ahead, saved_back, states, hidden, weights, pooled)


class Words:
    """Ids of distinct words, from 1 on, and the words whose features nobody has asked for yet."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.new: list[str] = [""]

    def look_up(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        for word in words:
            if word not in ids:
                ids[word] = len(ids) + 1
                self.new.append(word)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def take(self) -> list[str]:
        new, self.new = self.new, []
        return new


def _vectors(model: dict, buckets: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Input vectors of words: the word's, and the mean of its character sequences'."""
    chars = np.zeros((len(sizes), CHAR_SIZE), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.append(0, np.cumsum(sizes[some])[:-1])
        chars[some] = np.add.reduceat(model["char"][grams], starts, axis=0) / sizes[some, None]
    return np.concatenate([model["word"][buckets], chars], axis=1)


def _padded(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (steps, windows) ids, zero where there is no word, and the mask of words."""
    steps = max(map(len, ids))
    out = np.zeros((steps, len(ids)), np.int64)
    for i, one in enumerate(ids):
        out[: len(one), i] = one
    return out, out > 0


def train(texts: list[str], labels: list[int], how: Training = Training()) -> dict[str, np.ndarray]:
    """Learn from texts of which only the whole is labelled: each counts by its most toxic window.

    The first epoch takes windows of all texts, at most ``how.windows`` of them at random; later ones take of each text
    the window that scores highest so far, and of texts without the label a second, random one. Adam, on the touched rows only for the two tables.
    """
    model = new_model(how.seed)
    dice = np.random.default_rng(how.seed)
    known = Words()
    documents = [known.look_up(WORD.findall(t.lower())) for t in texts]
    windows = [[d[a:b] for a, b in windows_of(len(d), LEARN_STRIDE)] for d in documents]
    usable = [i for i, w in enumerate(windows) if w]
    if not usable:
        return model
    buckets, grams, sizes = features(known.take())
    begin = np.append(0, np.cumsum(sizes)[:-1])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0

    def adjust(name: str, grad: np.ndarray, rows=None) -> None:
        first, second = moments[name]
        at = slice(None) if rows is None else rows
        first[at] = 0.9 * first[at] + 0.1 * grad
        second[at] = 0.99 * second[at] + 0.01 * grad * grad
        size = how.rate / (1 - 0.9 ** min(step, 1000))
        model[name][at] -= size * first[at] / (np.sqrt(second[at] / (1 - 0.99 ** min(step, 1000))) + (1e-6 if rows is None else how.floor))

    epochs = max(how.epochs, min(40, -(-how.steps * how.batch // (2 * len(usable)))))
    for epoch in range(epochs):
        if epoch:
            table = _Table(model)
            table.add(buckets, grams, sizes)
            flat = [w for i in usable for w in windows[i]]
            scored = table.logits(model, flat)
            at, best = 0, {}
            for i in usable:
                best[i] = int(np.argmax(scored[at : at + len(windows[i])]))
                at += len(windows[i])
        chosen = []
        if not epoch:
            every = [(w, labels[i]) for i in usable for w in windows[i]]
            passes = [every[i] for _ in range(-(-how.windows // len(every))) for i in dice.permutation(len(every))]
            chosen = passes[: how.windows]
        else:
            for i in usable:
                chosen.append((windows[i][best[i]], labels[i]))
                if not labels[i] and len(windows[i]) > 1:
                    chosen.append((windows[i][int(dice.integers(len(windows[i])))], 0))
        dice.shuffle(order := np.arange(len(chosen)))
        for start in range(0, len(order), how.batch):
            step += 1
            part = [chosen[i] for i in order[start : start + how.batch]]
            ids, mask = _padded([p[0] for p in part])
            target = np.array([p[1] for p in part], np.float32)
            used, place = np.unique(ids, return_inverse=True)
            place = place.reshape(ids.shape)
            count = sizes[used]
            own = grams[np.repeat(begin[used] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())]
            vectors = _vectors(model, buckets[used], own, count)
            inputs = vectors[place]
            left = inputs @ model["left_in"] + model["left_bias"]
            right = inputs @ model["right_in"] + model["right_bias"]
            logits, (saved_a, saved_b, states, hidden, weights, pooled) = forward(model, left, right, mask, True)
            share = 1 / (1 + np.exp(-logits))
            grad = ((share - target) / len(part)).astype(np.float32)
            grads = {"out": pooled.T @ grad, "out_bias": grad.sum(keepdims=True)}
            of_pooled = grad[:, None] * model["out"]
            of_states = weights[:, :, None] * of_pooled[None]
            of_weights = np.einsum("tbh,bh->tb", states, of_pooled)
            of_scores = weights * (of_weights - (weights * of_weights).sum(axis=0))
            grads["query"] = np.einsum("tb,tba->a", of_scores, hidden)
            of_hidden = of_scores[:, :, None] * model["query"] * (1 - hidden * hidden)
            grads["attend"] = np.einsum("tbh,tba->ha", states, of_hidden)
            grads["attend_bias"] = of_hidden.sum(axis=(0, 1))
            of_states = of_states + of_hidden @ model["attend"].T
            of_inputs = 0
            for side, reverse, saved in (("left", 1, saved_a), ("right", -1, saved_b)):
                half = of_states[:, :, :HIDDEN] if side == "left" else of_states[:, :, HIDDEN:]
                of_side, grads[f"{side}_state"] = _back_side(half[::reverse], mask[::reverse], model[f"{side}_state"], saved)
                of_side = of_side[::reverse] * mask[:, :, None]
                flat = of_side.reshape(-1, 3 * HIDDEN)
                grads[f"{side}_in"] = inputs.reshape(-1, inputs.shape[2]).T @ flat
                grads[f"{side}_bias"] = flat.sum(axis=0)
                of_inputs = of_inputs + of_side @ model[f"{side}_in"].T
            of_words = np.zeros_like(vectors)
            np.add.at(of_words, place.ravel(), of_inputs.reshape(-1, vectors.shape[1]))
            for name, value in grads.items():
                adjust(name, value)
            of_words[used == 0] = 0
            rows, where = np.unique(buckets[used], return_inverse=True)
            sums = np.zeros((len(rows), WORD_SIZE), np.float32)
            np.add.at(sums, where, of_words[:, :WORD_SIZE])
            adjust("word", sums, rows)
            rows, where = np.unique(own, return_inverse=True)
            sums = np.zeros((len(rows), CHAR_SIZE), np.float32)
            of_chars = of_words[:, WORD_SIZE:] / np.maximum(count, 1)[:, None]
            np.add.at(sums, where, np.repeat(of_chars, count, axis=0))
            adjust("char", sums, rows)
    return model


class _Table:
    """The two directions' inputs of known words, one row a word."""

    def __init__(self, model: dict) -> None:
        self.weights = np.concatenate([model["left_in"], model["right_in"]], axis=1)
        self.bias = np.concatenate([model["left_bias"], model["right_bias"]])
        self.model = model
        self.rows = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.size = 0

    def add(self, buckets: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> None:
        """Rows for words with the next ids."""
        end = self.size + len(buckets)
        while len(self.rows) < end:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.size : end] = _vectors(self.model, buckets, grams, sizes) @ self.weights + self.bias
        self.size = end

    def logits(self, model: dict, windows: list[np.ndarray], at_once: int = 1024) -> np.ndarray:
        """Logits of windows of word ids; windows of one length are run together."""
        out = np.empty(len(windows), np.float32)
        order = np.argsort([len(w) for w in windows], kind="stable")
        for start in range(0, len(order), at_once):
            part = order[start : start + at_once]
            ids, mask = _padded([windows[i] for i in part])
            inputs = self.rows[ids]
            out[part] = forward(model, inputs[:, :, : 3 * HIDDEN], inputs[:, :, 3 * HIDDEN :], mask)[0]
        return out


class Scorer:
    """Scores texts by their most toxic window."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.known, self.table = Words(), _Table(model)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.known.ids) > MEMO_WORDS:
            self.known, self.table = Words(), _Table(self.model)
        windows, whose = [], []
        for i, text in enumerate(texts):
            ids = self.known.look_up(WORD.findall(text.lower()))
            for a, b in windows_of(len(ids)):
                windows.append(ids[a:b])
                whose.append(i)
        best = np.full(len(texts), -np.inf)
        new = self.known.take()
        if new:
            self.table.add(*features(new))
        if windows:
            np.maximum.at(best, whose, self.table.logits(self.model, windows).astype(np.float64))
        return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(best, -500, 500))))


def held_out(doc_id: str | Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows that are never learned from: those whose crc32 of the id as text leaves this remainder."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, how: Training = Training()) -> dict:
    """Train on a bounded sample of labelled rows, chosen by a hash of the id; the sample is collected to the driver."""
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).where(F.col(label).isin(0, 1))
    marks = marks.groupBy("_id").agg(F.max("_label").alias("_label")).where(~held_out("_id"))
    picked = [
        marks.where(F.col("_label") == value).orderBy(F.xxhash64("_id", F.lit(how.seed)), "_id").limit(how.rows)
        for value in (0, 1)
    ]
    picked = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_text")).where(F.length("_text") <= how.chars)
    found = rows.join(picked, "_id").orderBy(F.xxhash64("_id", F.lit(how.seed)), "_id", "_text").limit(2 * how.rows)
    found = found.select("_text", "_label").collect()
    return train([r["_text"] for r in found], [r["_label"] for r in found], how)


def score_toxicity(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    threshold: float = 0.7,
    how: Training = Training(),
) -> DataFrame:
    """Score every whole text for toxicity with a network trained on a bounded sample of labelled rows.

    A text's words are run through the network in windows of WINDOW words, one every STRIDE words; its score is that of
    its most toxic window, and any passage of up to WINDOW - STRIDE + 1 words lies whole in one. Only the text is an input. Rows whose crc32(doc_id) mod 3 is 1 are held out from training. Result, one
    row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on).

    Null texts and texts without a word score 0. Labels other than 0 and 1 count as none, of several for one id the
    largest counts, null ids have none and are not held out. Without any label the untrained network scores. Repeated
    rows are scored alike; other columns are not read.
    """
    model = df.sparkSession.sparkContext.broadcast(learn(df, labels, doc_id, text, label, how))
    kind = df.schema[doc_id].dataType.simpleString()

    def each():
        scorer = Scorer(model.value)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, 2):
                scores = scorer.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

        return work

    rows = df.select(df[doc_id].alias("doc_id"), held_out(df[doc_id]).alias("held_out"), text_of(df[text]).alias("text"))
    return arrow_map(rows, f"doc_id {kind}, held_out boolean, score double, predicted int", each)
