"""Toxicity with a bidirectional gated recurrent network and attention pooling.

A word's input joins a word embedding and the sum of its character inputs'
embeddings (its beginnings and ends of several lengths; all hashed), so unseen
forms of a word still share inputs.  Two gated recurrent networks read a window of ``WINDOW`` words in either
direction, attention pools their states, and a logistic unit scores the
window.  A text is scored by all its overlapping windows (``STRIDE`` words
apart, the last one ending with the text).  The largest window logit and the
mean window probability, put through a logistic fit on the training documents,
give its score.

Training is numpy only (back-propagation through time, Adam), on the driver,
from a bounded sample of labelled rows: at most ``SAMPLE_DOCS`` documents a
class, chosen by a hash of the id, and ``SAMPLE_WINDOWS`` windows of each,
also chosen by hash.  One in ``APART`` of these documents is kept from the network
for the logistic fit, as logits of fitted windows lie further apart than those of
unseen ones (all of them where that part lacks a class).  The fit takes all windows
of its documents, scored in Spark like those of any text: the largest of hundreds of
logits lies above the largest of a few.  Everything else covers every row and whole
texts.
The model has a fixed size and is broadcast.

Labels are per document while most windows of a toxic document may be clean:
after a first pass over the windows, windows of toxic documents that score
below one half are left out of the second, but for each document's best.

Defined results: a null, empty or wordless text scores 0.  Without labels of
both classes every score is 0 or 1, by the only class there is (0 without
any).  Null labels are skipped; several labels of one document count as toxic
if any is.  Rows are never merged; only the named columns are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import id_bucket, received, returning_memory, ship
from rankfold.llm.text import LOWER, WORD, Powers, mix, prefix_hash, span_hash, spans, text_chunks

WORD_SLOTS, CHAR_SLOTS = 1 << 14, 1 << 15
#: bytes of a word's beginnings and ends that are character inputs
PREFIXES, SUFFIXES = (2, 3, 4, 5, 6, 7, 8), (2, 3, 4, 5)
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
#: half a window: a run of up to WINDOW - STRIDE + 1 words is whole in some window
WINDOW, STRIDE = 48, 24
#: documents a class and windows a document that the network is fitted on
SAMPLE_DOCS, SAMPLE_WINDOWS = 2500, 6
#: one in so many sampled documents is for the calibration alone
APART = 5
EPOCHS, BATCH, RATE, SEED = 2, 128, 0.005, 7
#: a small sample is passed over more often, to as many steps in all
MIN_STEPS = 160
#: sampled documents that must hold a word for it to have an embedding of its own
#: (slot 0: all others), and the share of words that a training pass leaves out
MIN_DOCS, DROP = 5, 0.3
#: z-score that counts as chance, and the tables' share of the learning rate
CHANCE, TABLE_RATE = 2.5, 0.2
FOLDS, HELD_OUT = 5, 0
#: windows scored together
SCORE_BATCH = 2048


def word_inputs(data: np.ndarray, off: np.ndarray, powers: Powers):
    """Words of a buffer: row and distinct-word index of each, and per distinct
    word its slot and the slots of its character inputs (beginnings and ends)."""
    start, end, row = spans(WORD[data], off)
    S = prefix_hash(LOWER[data], powers)
    h = span_hash(S, start, end, powers)
    _, first, index = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    inputs = [span_hash(S, s, np.minimum(e, s + n), powers) + np.uint64(n) for n in PREFIXES]
    inputs += [span_hash(S, np.maximum(s, e - n), e, powers) + np.uint64(100 + n) for n in SUFFIXES]
    chars = (mix(np.stack(inputs, axis=1)) % np.uint64(CHAR_SLOTS)).astype(np.int32)
    return row, index, (h[first] % np.uint64(WORD_SLOTS)).astype(np.int32), chars


def window_starts(n: int) -> np.ndarray:
    """First words of the windows over n words: every STRIDE, the last one at the end."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def squash(x):
    """Softsign, the recurrent units' cheap stand-in for tanh; slope (1 - |y|)^2."""
    return x / (1 + np.abs(x))


def gate(x):
    """Softsign on (0, 1); slope 0.5 * (1 - |2y - 1|)^2 for the input as given."""
    return 0.5 + 0.5 * squash(x)


class Network:
    """Parameters, forward pass, gradients and scoring of the window network."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTEND
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": f(WORD_SLOTS, WORD_DIM, scale=0.02), "char": f(CHAR_SLOTS, CHAR_DIM, scale=0.02),
                  "attend": f(2 * h, a, scale=0.3), "context": f(a, scale=0.3), "out": f(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"x{k}": f(d, 3 * h, scale=d ** -0.5), f"h{k}": f(h, 3 * h, scale=h ** -0.5), f"c{k}": np.zeros(3 * h, np.float32)}
        self.known, self.known_chars = np.ones(WORD_SLOTS, bool), np.ones(CHAR_SLOTS, bool)
        self.scale, self.shift = np.array([1.0, 0.0]), 0.0
        self.only: float | None = None

    def slots(self, slot, chars):
        """Slots with too little evidence become slot 0."""
        return np.where(self.known[slot], slot, 0), np.where(self.known_chars[chars], chars, 0)

    def embed(self, slot, chars):
        """Inputs of distinct words."""
        slot, chars = self.slots(slot, chars)
        return np.concatenate([self.p["word"][slot], self.p["char"][chars].sum(1)], axis=1)

    def _direction(self, k, xp, mask, keep=False):
        """States of one direction over time-major projected inputs (T, B, 3H)."""
        T, B, H = len(xp), xp.shape[1], HIDDEN
        U = self.p["h" + k]
        h, states, saved = np.zeros((B, H), np.float32), np.empty((T, B, H), np.float32), []
        for t in (range(T) if k == "f" else range(T - 1, -1, -1)):
            gates = gate(xp[t, :, :2 * H] + h @ U[:, :2 * H])
            r, z = gates[:, :H], gates[:, H:]
            n = squash(xp[t, :, 2 * H:] + (r * h) @ U[:, 2 * H:])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t], new, h)
            if keep:
                saved.append((t, h, r, z, n))
            h = states[t] = new
        return states, saved

    def _pool(self, states, mask):
        u = squash(states @ self.p["attend"])
        e = u @ self.p["context"]
        if mask is not None:
            e = np.where(mask[:, :, 0], e, -1e9)
        e = np.exp(e - e.max(0))
        w = e / e.sum(0)
        return u, w, np.einsum("tb,tbh->bh", w, states)

    def logits(self, projected, ids, lengths):
        """Window logits; ids (B, T) of rows of ``projected`` = {f, b} inputs."""
        mask = None if (lengths == ids.shape[1]).all() else (np.arange(ids.shape[1])[:, None] < lengths)[:, :, None]
        states = np.concatenate([self._direction(k, projected[k][ids.T], mask)[0] for k in "fb"], axis=2)
        return self._pool(states, mask)[2] @ self.p["out"] + self.p["bias"][0]

    def project(self, x):
        return {k: x @ self.p["x" + k] + self.p["c" + k] for k in "fb"}

    def gradients(self, slot, chars, ids, lengths, y, kept):
        """Gradients of the mean log loss over a batch of windows; ``kept`` (T, B)
        says which words are read."""
        H, p = HIDDEN, self.p
        x = self.embed(slot, chars)
        mask = (np.arange(ids.shape[1])[:, None] < lengths)[:, :, None]
        xt = x[ids.T] * kept[:, :, None]
        runs = {k: self._direction(k, xt @ p["x" + k] + p["c" + k], mask, True) for k in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        u, w, pooled = self._pool(states, mask)
        err = (sigmoid(pooled @ p["out"] + p["bias"][0]) - y) / len(y)
        g = {"out": pooled.T @ err, "bias": np.array([err.sum()], np.float32)}
        dpool = err[:, None] * p["out"]
        dw = np.einsum("bh,tbh->tb", dpool, states)
        de = w * (dw - (w * dw).sum(0))
        du = de[:, :, None] * p["context"] * (1 - np.abs(u)) ** 2
        g["context"] = np.einsum("tb,tba->a", de, u)
        g["attend"] = np.einsum("tbh,tba->ha", states, du)
        ds = w[:, :, None] * dpool + du @ p["attend"].T
        dx = np.zeros_like(xt)
        for k, part in (("f", ds[:, :, :H]), ("b", ds[:, :, H:])):
            U, dU = p["h" + k], np.zeros_like(p["h" + k])
            dxp = np.zeros((len(xt), xt.shape[1], 3 * H), np.float32)
            carry = np.zeros_like(part[0])
            for t, h, r, z, n in reversed(runs[k][1]):
                total = part[t] + carry
                live = mask[t] * total
                dn = live * (1 - z) * (1 - np.abs(n)) ** 2
                dz = live * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                drh = dn @ U[:, 2 * H:].T
                dr = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                dxp[t] = np.concatenate([dr, dz, dn], axis=1)
                dU[:, :2 * H] += h.T @ dxp[t, :, :2 * H]
                dU[:, 2 * H:] += (r * h).T @ dn
                carry = live * z + drh * r + dxp[t, :, :2 * H] @ U[:, :2 * H].T + (1 - mask[t]) * total
            g["h" + k], g["c" + k] = dU, dxp.sum((0, 1))
            g["x" + k] = np.einsum("tbd,tbg->dg", xt, dxp)
            dx += dxp @ p["x" + k].T
        dx *= kept[:, :, None]
        flat = np.zeros_like(x)
        np.add.at(flat, ids.T.ravel(), dx.reshape(-1, dx.shape[2]))
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        slot, chars = self.slots(slot, chars)
        np.add.at(g["word"], slot, flat[:, :WORD_DIM])
        np.add.at(g["char"], chars.ravel(), np.repeat(flat[:, WORD_DIM:], chars.shape[1], axis=0))
        g["word"][0] = g["char"][0] = 0
        return g

    def score(self, features):
        return sigmoid(features @ self.scale + self.shift)


def text_features(model: Network, data: np.ndarray, off: np.ndarray, powers: Powers) -> np.ndarray:
    """Per row what ``pooled`` makes of its windows' logits; nan without words."""
    n = len(off) - 1
    row, index, slot, chars = word_inputs(data, off, powers)
    if not len(row):
        return np.full((n, 2), np.nan)
    projected = model.project(model.embed(slot, chars))
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    starts = [window_starts(c) for c in count]
    owner = np.repeat(np.arange(n), [len(s) for s in starts])
    begin = np.concatenate(starts) + first[owner]
    size = np.minimum(count[owner], WINDOW)
    logit = np.empty(len(owner))
    order = np.argsort(-size, kind="stable")  # like lengths together: little padding
    full = int((size == WINDOW).sum())  # these need no mask
    for a, b in [*((a, min(full, a + SCORE_BATCH)) for a in range(0, full, SCORE_BATCH)), *((a, a + SCORE_BATCH) for a in range(full, len(order), SCORE_BATCH))]:
        part = order[a:b]
        ids = index[np.minimum(begin[part][:, None] + np.arange(size[part[0]]), len(index) - 1)]
        logit[part] = model.logits(projected, ids, size[part])
    return pooled(logit, owner, n)


def pooled(logit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Largest logit and log odds of the mean probability of each owner's windows."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logit)
    windows = np.bincount(owner, minlength=n)
    mean = np.divide(np.bincount(owner, sigmoid(logit), n), windows, out=np.full(n, np.nan), where=windows > 0).clip(1e-6, 1 - 1e-6)
    return np.stack([np.where(windows > 0, top, np.nan), np.log(mean / (1 - mean))], axis=1)


def _sampled(keep_windows: int):
    """Windows of the sampled documents, chosen by hash, as word lists."""

    def run(batches):
        for batch in batches:
            ids, labels = batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist()
            out = []
            for r, t in enumerate(batch.column("text").to_pylist()):
                words = pa.array([t or ""])
                for _, _, data, off in text_chunks(words):
                    s, e, _ = spans(WORD[data], off)
                    starts = window_starts(len(s))
                    rank = mix(starts.astype(np.uint64) + np.uint64((ids[r] or 0) % (1 << 32) * 1_000_003 + 1))
                    for b in starts[np.sort(np.argsort(rank, kind="stable")[:keep_windows])]:
                        out.append((ids[r], labels[r], data[s[b]:e[min(len(s), b + WINDOW) - 1]].tobytes().decode(errors="ignore")))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["doc_id", "toxic", "piece"])

    return run


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold, one row an id."""
    return (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_bucket("doc_id", FOLDS) != HELD_OUT))
            .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))


def training_rows(docs: DataFrame, known: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, text, toxic) of the bounded sample, whole texts."""
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for c in (0, 1)]
    # at most 2 * sample_docs rows of two numbers: the bound that makes this broadcast safe
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")


def training_windows(sample: DataFrame, sample_windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """(doc_id, toxic, piece) of the sampled rows."""
    return sample.mapInArrow(returning_memory(_sampled(sample_windows)), "doc_id bigint, toxic int, piece string")


def _featured(broadcast):
    """Features of whole texts, of those with words."""

    def run(batches):
        model, powers = received(broadcast), Powers()
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column("text")):
                x = text_features(model, data, off, powers)
                part = batch.slice(i, j - i).filter(pa.array(~np.isnan(x[:, 0])))
                x = x[~np.isnan(x[:, 0])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "toxic", "top", "mean"])

    return run


def training_features(sample: DataFrame, model: Network) -> DataFrame:
    """(doc_id, toxic, top, mean) of the sampled rows, over all windows of their texts."""
    rows = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", "text")
    return rows.mapInArrow(returning_memory(_featured(ship(sample.sparkSession, model))), "doc_id bigint, toxic int, top double, mean double")


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Network:
    """Network and calibration from the bounded sample."""
    known = known_labels(labels)
    all_labels = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = training_rows(docs, known)
    rows = sorted(map(tuple, training_windows(sample).collect()))
    apart = {c: {r[0] for r in rows if r[1] == c and mix(np.array([r[0] % (1 << 64)], np.uint64))[0] % APART == 0} for c in (0, 1)}
    whole = {c: {r[0] for r in rows if r[1] == c} for c in (0, 1)}
    kept_apart = apart[0] | apart[1] if all(apart[c] and whole[c] - apart[c] for c in (0, 1)) else set()
    rows = [r for r in rows if r[0] not in kept_apart]
    model, powers = Network(), Powers()
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y)) < 2:
        model.only = float(y[0]) if len(y) else 0.0
        return model
    doc = np.unique([r[0] for r in rows], return_inverse=True)[1]
    encoded = [word_inputs(*_buffer(r[2]), powers) for r in rows]
    label = np.zeros(doc.max() + 1)
    label[doc] = y
    docs_of, z = _evidence(doc, label, [e[2] for e in encoded], WORD_SLOTS)
    model.known = docs_of >= MIN_DOCS
    model.known[0] = False
    model.p["word"][:, 0] = np.where(model.known, z, 0)
    docs_of, z = _evidence(doc, label, [e[3] for e in encoded], CHAR_SLOTS)
    model.known_chars = docs_of >= MIN_DOCS
    model.known_chars[0] = False
    model.p["char"][:, 0] = np.where(model.known_chars, z, 0)
    model.p["char"][0] = model.p["word"][0] = 0
    rng = np.random.default_rng(SEED)
    keep = np.ones(len(rows), bool)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    balanced = 2 * max((y > 0).sum(), (y == 0).sum())
    epochs = max(epochs, int(np.ceil(MIN_STEPS * BATCH / balanced)))
    for epoch in range(epochs):
        # as many windows of either class, each seen once or repeated
        toxic, clean = np.flatnonzero(keep & (y > 0)), np.flatnonzero(keep & (y == 0))
        n = max(len(toxic), len(clean))
        order = np.concatenate([np.resize(rng.permutation(c), n) for c in (toxic, clean)])
        rng.shuffle(order)
        for a in range(0, len(order), BATCH):
            part = order[a:a + BATCH]
            step += 1
            slot, chars, ids, sizes = _joined([encoded[i] for i in part])
            kept = (rng.random(ids.T.shape) >= DROP).astype(np.float32)
            g = model.gradients(slot, chars, ids, sizes, y[part], kept)
            rate = RATE * min(1.0, 1.5 - epoch / epochs)
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                # tables share one scale: words seen once must not learn as fast as all
                s += 0.001 * ((v * v if k not in ("word", "char") else (v * v).sum() / max(1, np.count_nonzero(v))) - s)
                model.p[k] -= (rate * (TABLE_RATE if k in ("word", "char") else 1) / (1 - 0.9 ** step)) * m / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-6)
        logit = _window_logits(model, encoded)
        best = np.full(doc.max() + 1, -np.inf)
        np.maximum.at(best, doc, logit)
        keep = (y == 0) | (logit > 0) | (logit == best[doc])
    points = sorted(map(tuple, training_features(sample, model).collect()))
    points = [r for r in points if not kept_apart or r[0] in kept_apart]
    _, doc, copies = np.unique([r[0] for r in points], return_inverse=True, return_counts=True)
    # rows of one id count as one document
    share = np.array([all_labels[r[1]] for r in points]) / copies[doc]
    label = np.array([r[1] for r in points])
    share /= np.array([(1 / copies[doc])[label == c].sum() for c in (0, 1)])[label]
    model.scale, model.shift = _calibrate(np.array([r[2:] for r in points]), np.array([r[1] for r in points], float), share / share.mean())
    return model


def _evidence(doc, label, slots, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled documents per slot, and how surely the slot goes with the toxic ones:
    the z-score of its log odds beyond what many slots reach by chance, where the
    first embedding component starts."""
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d, group in itertools.groupby(np.argsort(doc, kind="stable").tolist(), lambda i: doc[i]):
        held = np.unique(np.concatenate([slots[i].ravel() for i in group]))
        (a if label[d] > 0 else b)[held] += 1
    A, B = (label > 0).sum(), (label == 0).sum()
    odds = np.log((a + 0.5) / (A - a + 0.5)) - np.log((b + 0.5) / (B - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return a + b, (np.sign(z) * np.clip((np.abs(z) - CHANCE) / 2, 0, 4)).astype(np.float32)


def _buffer(text: str):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)], np.int64)


def _joined(parts):
    """One batch from single windows: distinct words are kept per window."""
    base = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])[:-1]])
    sizes = np.array([len(p[1]) for p in parts])
    ids = np.zeros((len(parts), max(1, sizes.max())), np.int64)
    for i, p in enumerate(parts):
        ids[i, :sizes[i]] = p[1] + base[i]
    return np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), ids, sizes


def _window_logits(model: Network, encoded) -> np.ndarray:
    out = []
    for a in range(0, len(encoded), SCORE_BATCH):
        slot, chars, ids, sizes = _joined(encoded[a:a + SCORE_BATCH])
        out.append(model.logits(model.project(model.embed(slot, chars)), ids, sizes))
    return np.concatenate(out)


def _calibrate(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and shift of a logistic fit of the labels (Newton steps, small ridge);
    ``share`` undoes the sample's balance of the classes."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1, 0.1, 1e-3])
    for _ in range(30):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + ridge, x.T @ (share * (p - y)) + ridge @ w)
    return w[:-1], float(w[-1])


def _scorer(broadcast, keep: list[str]):
    def run(batches):
        model, powers = received(broadcast), Powers()
        for batch in batches:
            score = []
            for _, _, data, off in text_chunks(batch.column("text")):
                if model.only is None:
                    features = text_features(model, data, off, powers)
                    score.append(np.where(np.isnan(features[:, 0]), 0.0, model.score(features)))
                else:
                    score.append(np.where(np.diff(off) > 0, model.only, 0.0))
            s = np.concatenate(score).astype(float) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``score`` and ``predicted``; ``text`` is what is scored."""
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return rows.mapInArrow(returning_memory(_scorer(ship(docs.sparkSession, model), list(keep))), f"{fields}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit outside the held-out fold, score every document."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out")), model, ("doc_id", "held_out"))
