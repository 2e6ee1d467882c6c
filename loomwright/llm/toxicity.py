"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding beside the mean embedding of its
character 4-grams and longer beginnings. A text is cut into overlapping
windows of words; both directions of the network read each window,
attention pools their states, and the text's score is that of its most
toxic window. Training sees labels of whole texts only: the windows of a
text share its gradient by their softmax weights.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _flat
from .common import discard, fields, others, slices, stored, text_buffers
from .grams import _BYTE, LETTERS_DIGITS, Words, mix

_U, _F = np.uint64, np.float32
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 16
#: Sizes: word and character embeddings, states of each direction, attention.
WORD, CHAR, HIDDEN, ATTENTION = 8, 16, 8, 8
#: Training reads at most this many labelled rows of each label, of at most LENGTH characters each (a documented bound of the fit, not of scoring).
SAMPLE, LENGTH = (1500, 2500), 2500
#: Words and character grams are known from so many training texts on.
LEAST_TEXTS = 3
EPOCHS, BATCH, RATE = 4, 48, 0.01
#: Steps of training at least, so that a small sample is gone over more often.
STEPS = 150
#: The first component of an embedding starts from log odds in standard errors: how many chance may bring, and how many more count.
CHANCE, PRIOR = 2.0, 3.0


# ---- inputs


def char_grams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character grams of the chosen words, back to back, and how many each has: all 4 bytes in a row of `^word$`, and its first 5 to 8."""
    size = words.ends[chosen] - words.starts[chosen]
    padded = size + 2
    first = np.cumsum(padded) - padded
    text = np.zeros(int(padded.sum()) + 8, np.uint8)
    text[first], text[first + padded - 1] = ord("^"), ord("$")
    text[_flat(first + 1, size)] = words.low[_flat(words.starts[chosen], size)]
    value = _BYTE[text]
    inner = np.maximum(padded - 3, 1)  # a short word is one gram
    at = _flat(first, inner)
    gram = np.zeros(len(at), _U)
    for j in range(4):
        gram = gram * _U(0x100000001B3) + value[at + j]
    head, heads = value[first], []
    for j in range(1, 8):
        head = head * _U(0x9E3779B1) + value[np.minimum(first + j, len(value) - 1)]
        if j >= 4:
            heads.append(np.where(padded > j, mix(head + _U(j)), _U(0)))
    counts = inner + len(heads)
    out = np.empty(int(counts.sum()), _U)
    start = np.cumsum(counts) - counts
    out[_flat(start, inner)] = mix(gram)
    for i, h in enumerate(heads):
        out[start + inner + i] = h
    return out, counts


def _lookup(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of the wanted hashes: 0 is unknown, i + 1 is known[i]."""
    if not len(known):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at + 1, 0)


def windows_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows: every STRIDE words, the last one flush with the end; one for a text of no more than a window."""
    n = np.where(count <= WINDOW, 1, -(-(count - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(count)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, np.maximum(0, np.minimum(nth * STRIDE, count[text] - WINDOW))


def window_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, windows x WINDOW word numbers; -1 is beyond the text's end)."""
    text, first = windows_of(words.count)
    at = first[:, None] + np.arange(WINDOW)
    return text, np.where(at < words.count[text][:, None], at + words.first[:-1][text][:, None], -1)


# ---- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and the two passes; the rows of `inputs` are distinct words, row 0 stands for places beyond a text's end."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 1):
        draw = np.random.default_rng(seed)
        size = lambda *s, by=0.3: draw.normal(0, by, s).astype(_F)
        d, h, a = WORD + CHAR, HIDDEN, ATTENTION
        self.words, self.grams = words, grams
        self.p = {"word": size(len(words) + 1, WORD, by=0.05), "char": size(len(grams) + 1, CHAR, by=0.05), "attend": size(2 * h, a), "attend_b": size(a), "point": size(a), "out": size(2 * h), "out_b": np.full(1, -1, _F)}
        for way in "fb":
            self.p |= {f"in_{way}": size(d, 3 * h), f"bias_{way}": size(3 * h, by=0.1), f"state_{way}": size(h, 3 * h)}

    def features(self, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, counts = char_grams(words, chosen)
        return _lookup(self.words, words.hash[chosen]), _lookup(self.grams, grams), counts

    def embed(self, word: np.ndarray, gram: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Inputs of words by their features, after row 0."""
        out = np.zeros((len(word) + 1, WORD + CHAR), _F)
        if len(word):
            out[1:, :WORD] = self.p["word"][word]
            out[1:, WORD:] = np.add.reduceat(self.p["char"][gram], np.cumsum(counts) - counts) / counts[:, None].astype(_F)
        return out

    def run(self, way: str, inputs: np.ndarray, index: np.ndarray, keep: bool):
        """States (steps x windows x HIDDEN) of one direction over index (windows x steps), and what back() needs."""
        h, state = HIDDEN, np.zeros((len(index), HIDDEN), _F)
        projected, u = inputs @ self.p[f"in_{way}"] + self.p[f"bias_{way}"], self.p[f"state_{way}"]
        steps = index.shape[1]
        states, kept = np.empty((steps, len(index), h), _F), []
        columns = np.ascontiguousarray(index.T)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, s = projected[columns[t]], state @ u
            gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            if keep:
                kept.append((t, state, z, r, new, s[:, 2 * h :]))
            state = new + z * (state - new)
            states[t] = state
        return states, kept

    def forward(self, inputs: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logit of each window."""
        (f, kept_f), (b, kept_b) = (self.run(way, inputs, index, keep) for way in "fb")
        both = np.concatenate((f, b), axis=2)
        hidden = np.tanh(both @ self.p["attend"] + self.p["attend_b"])
        weight = hidden @ self.p["point"]
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        return pooled @ self.p["out"] + self.p["out_b"][0], (kept_f, kept_b, both, hidden, weight, pooled)

    def back(self, d_logit: np.ndarray, inputs: np.ndarray, index: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the inputs."""
        kept_f, kept_b, both, hidden, weight, pooled = kept
        h, g = HIDDEN, {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = (both * d_pooled).sum(axis=2)
        d_point = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["point"] = np.einsum("tb,tba->a", d_point, hidden)
        d_hidden = d_point[:, :, None] * self.p["point"] * (1 - hidden**2)
        g["attend"], g["attend_b"] = np.einsum("tbh,tba->ha", both, d_hidden), d_hidden.sum(axis=(0, 1))
        d_both = weight[:, :, None] * d_pooled + d_hidden @ self.p["attend"].T
        d_inputs = np.zeros_like(inputs)
        order = np.argsort(index.T.ravel(), kind="stable")
        seen = index.T.ravel()[order]
        heads = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1])))
        for way, steps, d_states in (("f", kept_f, d_both[:, :, :h]), ("b", kept_b, d_both[:, :, h:])):
            u, d_u = self.p[f"state_{way}"], np.zeros((h, 3 * h), _F)
            d_x, d_state = np.empty((index.shape[1], len(index), 3 * h), _F), np.zeros((len(index), h), _F)
            for t, before, z, r, new, s in reversed(steps):
                d_state = d_state + d_states[t]
                d_new = d_state * (1 - z) * (1 - new**2)
                d_gates = np.concatenate((d_state * (before - new) * z * (1 - z), d_new * s * r * (1 - r), d_new), axis=1)
                d_x[t] = d_gates
                d_s = np.concatenate((d_gates[:, : 2 * h], d_new * r), axis=1)
                d_u += before.T @ d_s
                d_state = d_state * z + d_s @ u.T
            summed = np.zeros((len(inputs), 3 * h), _F)
            summed[seen[heads]] = np.add.reduceat(d_x.reshape(-1, 3 * h)[order], heads)
            g |= {f"state_{way}": d_u, f"in_{way}": inputs.T @ summed, f"bias_{way}": summed.sum(axis=0)}
            d_inputs += summed @ self.p[f"in_{way}"].T
        d_inputs[0] = 0
        return g, d_inputs


class Adam:
    """Adam; of an embedding, only the rows that a step touches move."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, gradients: dict, rows: dict) -> None:
        self.t += 1
        by = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in gradients.items():
            at = rows.get(k, slice(None))
            self.m[k][at] = m = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = v = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] -= (by * m / (np.sqrt(v) + 1e-7)).astype(_F)


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return sorted_[heads], np.add.reduceat(values[order], heads)


def _known(texts: np.ndarray, values: np.ndarray, labels: np.ndarray, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(sorted values that occur in LEAST_TEXTS texts or more, texts of label 0 and of label 1 with each);
    texts are in order, and counted a part at a time."""
    known, counts, at = np.zeros(0, _U), np.zeros((0, 2)), 0
    while at < len(values):
        stop = int(np.searchsorted(texts, texts[min(at + most, len(texts)) - 1], "right"))
        order = np.lexsort((texts[at:stop], values[at:stop]))
        value, text = values[at:stop][order], texts[at:stop][order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
        wide, place = np.unique(np.concatenate((known, value[new])), return_inverse=True)
        own, label = place[len(known) :], labels[text[new]]
        fresh = np.stack([np.bincount(own, label == y, len(wide)) for y in (0, 1)], axis=1)
        fresh[place[: len(known)]] += counts
        known, counts, at = wide, fresh, stop
    often = counts.sum(axis=1) >= LEAST_TEXTS
    return known[often], counts[often]


def _known_grams(texts: np.ndarray, of: np.ndarray, starts: np.ndarray, counts: np.ndarray, grams: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_known() of character grams; the texts' distinct words are looked at some texts at a time."""
    size = max(len(counts), 1)
    text, word = np.divmod(np.unique(texts.astype(np.int64) * size + of), size)
    wide, ids = np.unique(grams, return_inverse=True)
    seen, at = np.zeros((len(wide), 2)), 0
    while at < len(word):
        stop = int(np.searchsorted(text, text[min(at + 50_000, len(text)) - 1], "right"))
        part = word[at:stop]
        in_text, gram = np.divmod(np.unique(np.repeat(text[at:stop], counts[part]) * len(wide) + ids[_flat(starts[part], counts[part])]), len(wide))
        for y in (0, 1):
            seen[:, y] += np.bincount(gram, labels[in_text] == y, minlength=len(wide))
        at = stop
    often = seen.sum(axis=1) >= LEAST_TEXTS
    return wide[often], seen[often]


def log_odds(seen: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """How much more often texts of label 1 have something than those of label 0, in standard errors beyond CHANCE, from -PRIOR to PRIOR."""
    n = np.array([max(1, (labels == y).sum()) for y in (0, 1)])
    odds = np.log((seen + 0.5) / (n - seen + 0.5))
    z = (odds[:, 1] - odds[:, 0]) / np.sqrt((1 / (seen + 0.5) + 1 / (n - seen + 0.5)).sum(axis=1))
    return (np.sign(z) * np.clip(np.abs(z) - CHANCE, 0, PRIOR)).astype(_F)


def fit(texts: list[str], labels: np.ndarray, seed: int = 1) -> Network:
    """A network trained on whole texts and their labels (0 or 1)."""
    words = Words(*text_buffers(pa.array(texts, pa.large_string())), LETTERS_DIGITS)
    _, distinct, of = np.unique(words.hash, return_index=True, return_inverse=True)
    grams, counts = char_grams(words, distinct) if len(distinct) else (np.zeros(0, _U), np.zeros(0, np.int64))
    starts = np.cumsum(counts) - counts
    (known_words, said), (known_grams, held) = _known(words.text, words.hash, labels), _known_grams(words.text, of, starts, counts, grams, labels)
    net = Network(known_words, known_grams, seed)
    # a small sample teaches little by gradients alone: embeddings start from what the labels say of each word
    net.p["word"][1:, 0] = log_odds(said, labels)
    net.p["char"][1:, 0] = log_odds(held, labels)
    row, gram = _lookup(net.words, words.hash[distinct]), _lookup(net.grams, grams)
    text, places = window_words(words)
    window_ends = np.searchsorted(text, np.arange(len(texts) + 1))
    adam, draw = Adam(net.p, RATE), np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)) ** 0.5
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(len(texts), 1)))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = draw.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = np.sort(order[at : at + BATCH])
            n = window_ends[batch + 1] - window_ends[batch]
            place = places[_flat(window_ends[batch], n)]
            used, index = np.unique(np.where(place < 0, -1, of[place] if len(of) else -1), return_inverse=True)
            index = index.reshape(place.shape)
            if used[0] < 0:
                used = used[1:]
            else:
                index = index + 1
            flat = _flat(starts[used], counts[used])
            inputs = net.embed(row[used], gram[flat], counts[used])
            logit, kept = net.forward(inputs, index, keep=True)
            ends = np.cumsum(n) - n
            most = np.maximum.reduceat(logit, ends)
            share = np.exp(logit - np.repeat(most, n))
            share /= np.repeat(np.add.reduceat(share, ends), n)
            wrong = (_sigmoid(most) - labels[batch]) * weight[batch] / len(batch)
            g, d = net.back((share * np.repeat(wrong, n)).astype(_F), inputs, index, kept)
            rows = {}
            if len(used):
                rows["word"], g["word"] = _by_row(row[used], d[1:, :WORD])
                spread = np.repeat(d[1:, WORD:] / counts[used][:, None].astype(_F), counts[used], axis=0)
                rows["char"], g["char"] = _by_row(gram[flat], spread)
            adam.step(g, rows)
    return net


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Toxicity of texts that lie back to back, over all their windows."""
    words = Words(data, offsets, LETTERS_DIGITS)
    _, distinct, of = np.unique(words.hash, return_index=True, return_inverse=True)
    inputs = net.embed(*net.features(words, distinct)) if len(distinct) else net.embed(*[np.zeros(0, np.int64)] * 3)
    text, places = window_words(words)
    index = np.where(places < 0, 0, of[places] + 1) if len(of) else np.zeros_like(places)
    out = np.full(words.texts, -np.inf)
    for at in range(0, len(index), 4096):
        logit, _ = net.forward(inputs, index[at : at + 4096])
        np.maximum.at(out, text[at : at + 4096], logit.astype(float))
    return _sigmoid(out)


# ---- Spark


def held_out(id_col: F.Column) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network fitted on a bounded sample of labelled rows that are not held out; None if no row is labelled.

    The sample holds at most SAMPLE[1] rows of label 0 and SAMPLE[0] of
    label 1, of at most LENGTH characters, those with the smallest hash of
    their text; rows with a null id, text or label are not used. It does
    not depend on how the tables are dealt out. The driver holds the sample
    (at most 4000 * LENGTH characters) and trains.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(~held_out(F.col("id")) & (F.length("text") <= LENGTH))
    # ids and hashes are joined with the labels; only the chosen rows' texts are fetched
    hashed = stored(texts.select("id", F.xxhash64("text").alias("order")).join(known, "id").select("label", "order", "id").distinct(), "label-hashes")
    picked = [hashed.where(f"label = {label}").orderBy("order", "id").limit(SAMPLE[1 - label]) for label in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most sum(SAMPLE) rows
    rows = texts.withColumn("order", F.xxhash64("text")).join(chosen, ["id", "order"])
    sample = rows.groupBy("id", "label", "order").agg(F.min("text").alias("text")).select("text", "label", "order").toArrow()
    discard(hashed)
    if not sample.num_rows:
        return None
    table = sorted(zip(sample["order"].to_pylist(), sample["label"].to_pylist(), sample["text"].to_pylist(), strict=True))
    return fit([t for _, _, t in table], np.array([y for _, y, _ in table]))


def _scored(model: bytes, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model)
        for batch in slices(batches, "__text", 1 << 19):
            found = score(net, *text_buffers(batch.column("__text"))) if net is not None else np.zeros(batch.num_rows)
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, pa.float64())], [*kept, to])

    return run


def toxicity(df: DataFrame, net: Network | None, columns: list[str], text_col: str = "text", to: str = "score") -> DataFrame:
    """The named columns of df with the toxicity score (0 to 1) of each whole text.

    Only the text is read for the score. Null and empty texts get the score
    of a window without words; without a network every score is 0. Rows are
    independent: repeated rows get equal scores, an empty table gives an
    empty one; columns that are not named are dropped, a named one called
    like the result (`to`) is replaced by it.
    """
    columns = others(columns, to)
    kept = df.select(*columns, F.col(text_col).cast("string").alias("__text"))
    return kept.mapInArrow(_scored(pickle.dumps(net), to), f"{fields(df, columns)}`{to}` double")
