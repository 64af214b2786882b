"""Language-model scores of texts.

Base: an additively smoothed unigram model over words, counted over all rows that may be learned from. Counts of the
most frequent words (a fixed number) go to the executors by broadcast; the other words of each text are joined with
their counts by a shuffle, so scores are exact for any vocabulary.

Model: causal self-attention over subword ids, in numpy. Each position attends to the positions before it in its window
and mixes a few experts, each a distribution over subwords. A sample of windows with fixed bounds only gives the point
that learning starts from (gradient descent and expectation-maximisation). Then every row that may be learned from is
learned from once, in groups of rows of bounded size whose changes to the network are averaged and whose
responsibilities are summed: experts, and the counts that smooth them, are those of all these rows.
Texts are encoded once and their ids written out; learning and scoring read those.
A text is cut into windows that overlap: each scores its last positions only, so each subword is scored once, with at
least ``WINDOW - STRIDE`` before it (or all there are).

Memory: how all rows that may be learned from go on after a context of ``ORDER`` subwords, for every context. Where a
context is known, its continuations are discounted by a constant and what that frees goes to the network's distribution;
the constant comes from how many continuations occur once and twice. Texts lie in chunks of bounded size. A chunk sends
each context and continuation that it has once, with its count, to the task that counts a range of contexts, and gets
back what all chunks together have; so however common a context is, a chunk has one row of it, the memory grows with the
corpus, and no task or broadcast holds it. ``contexts_of`` and ``_remembered`` are the same for a part of the contexts
as a table, which tests hold against plain counts; scores don't use them.

Nulls count as empty texts, which have the end alone; very long texts are cut into windows like others. Rows may repeat;
extra columns are ignored; an empty table gives an empty result. With nothing to learn from, counts are zero and the
model is uniform.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import coder, forget
from .common import join_hot, short_batches, stage, unstage

#: Inputs a window holds, and targets it scores.
WINDOW, STRIDE = 32, 24
#: Width of the network and number of experts.
WIDTH, EXPERTS = 16, 64
#: Documents and windows of the sample that network and experts start from, at most, and passes over it.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, EPOCHS = 2000, 20_000, 4
#: All rows train network and experts after their start, in groups of about so many words, at this rate.
GROUP_WORDS, RATE = 4_000_000, 0.004
#: Subwords of a group that are cut into windows and mixed at a time.
LEARNED_IDS = 1 << 18
#: Subwords of a context that the memory holds.
ORDER = 3
#: Subwords of a chunk of texts (a longer text goes alone), and about how many a task counts contexts of.
CHUNK_IDS, COUNTED_IDS = 3 << 20, 1 << 21
#: One in how many contexts ``contexts_of`` takes.
MEMORY = 16
#: Weight of the corpus counts in an expert, as a part of the expert's own counts.
PRIOR = 0.02
#: Words whose counts are broadcast, at most, and the bytes that such a word has at most.
HEAD_WORDS, HEAD_BYTES = 262_144, 48
#: Entries of the encoder's cache: it is held beside the words' counts.
CACHE_ENTRIES = 250_000
#: Rows cut into words at once, and bytes of words counted at once.
COUNTED_ROWS, COUNTED_BYTES = 64, 64 << 20
#: Rows and bytes handled at once: what is held for each subword is several times the text. A longer row goes alone.
SCORED_ROWS, SCORED_BYTES = 64, 1 << 20
#: Windows computed at once.
BATCH = 48
#: Logits are held within this, so that no exponential overflows or sums to zero.
LOGIT = np.float32(60)


def may_learn(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 != 1, F.lit(True))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with only A-Z lower-cased, in UTF-8."""
    return text.encode().lower().split()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; the empty word stands for the end of a text.

    Words are those of ``words_of``, cut and counted in bulk: a part of a task's texts at a time, summed by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held, pa.string()))
            batch = pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])
            held.clear()
            return batch.filter(pc.greater(pc.binary_length(batch.column(0)), 0))  # cutting at white space on the edges leaves empty pieces

        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for at in range(0, batch.num_rows, COUNTED_ROWS):  # of few rows, so that offsets of 32 bits do
                words = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(0).slice(at, COUNTED_ROWS))).flatten()
                held.append(words)
                size += words.nbytes
            if size > COUNTED_BYTES:
                yield out()
                size = 0
        if held:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- the network ---------------------------------------------------------------------------------------------------------


def windows_of(ids: np.ndarray, first: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets): the inputs of a window are the ids before its targets and those between; pads go unseen."""
    n = len(ids)
    m = -(-n // STRIDE)
    lead = WINDOW - STRIDE
    flow = np.full(lead + m * STRIDE, pad, np.int64)
    flow[lead] = first
    flow[lead + 1 : lead + n] = ids[:-1]
    goal = np.full(m * STRIDE, pad, np.int64)
    goal[:n] = ids
    return np.lib.stride_tricks.sliding_window_view(flow, WINDOW)[::STRIDE], goal.reshape(m, STRIDE)


def causal() -> np.ndarray:
    at = np.arange(WINDOW)
    return np.where(at[None, :] <= at[WINDOW - STRIDE :, None], 0, -1e9).astype(np.float32)


def _sums_of_rows(at: np.ndarray, order: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows, each once, and the sums of the ``values`` that belong to them; ``order`` sorts ``at`` or a part of it."""
    at = at[order]
    starts = _runs(at)
    return at[starts], np.add.reduceat(values.take(order, 0), starts) if len(at) else values[:0]


def _add_ordered(sums: np.ndarray, at: np.ndarray, order: np.ndarray, values: np.ndarray) -> None:
    rows, own = _sums_of_rows(at, order, values)
    sums[rows] += own


def _add_rows(sums: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add each row of ``values`` to the row ``at`` of ``sums``; rows may repeat."""
    _add_ordered(sums, at, np.argsort(at, kind="stable"), values)


class AttentionMixture:
    """One layer of causal self-attention that chooses among experts.

    The logits of the experts are linear in x + A v, x being the embedding of the last input plus that of its place.
    """

    NAMES = ("embed", "place", "query", "key", "value", "out", "bias")

    def __init__(self, vocabulary: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        scaled = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.embed = (rng.standard_normal((vocabulary, WIDTH)) * 0.3).astype(np.float32)
        self.place = (rng.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32)
        self.query, self.key, self.value = scaled(WIDTH, WIDTH), scaled(WIDTH, WIDTH), scaled(WIDTH, WIDTH)
        self.out, self.bias = scaled(WIDTH, EXPERTS), np.zeros(EXPERTS, np.float32)
        self.experts = np.full((vocabulary, EXPERTS), 1 / vocabulary, np.float32)
        self.mask = causal()

    @classmethod
    def of(cls, weights: dict[str, np.ndarray]) -> AttentionMixture:
        """A model of these weights, which it does not change."""
        out = cls.__new__(cls)
        out.__dict__ |= {k: v.copy() for k, v in weights.items()} | {"mask": causal()}
        return out

    def weights(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in (*self.NAMES, "experts")}

    def prepare(self) -> AttentionMixture:
        """Queries, keys and values of every subword, so that scoring looks them up."""
        scale = np.float32(1 / math.sqrt(WIDTH))
        self.tables = [(self.embed @ w, self.place @ w) for w in (self.query * scale, self.key, self.value)]
        return self

    def mix(self, inputs: np.ndarray, pad: int) -> tuple:
        """Weights of the experts at the scored positions, and what the backward pass needs."""
        lead = WINDOW - STRIDE
        tail = inputs[:, lead:]
        (eq, pq), (ek, pk), (ev, pv) = self.tables
        q, k, v = eq[tail] + pq[lead:], ek[inputs] + pk, ev[inputs] + pv
        return self._mixed(inputs, pad, q, k, v, self.embed[tail] + self.place[lead:])

    def _mixed(self, inputs: np.ndarray, pad: int, q: np.ndarray, k: np.ndarray, v: np.ndarray, own: np.ndarray) -> tuple:
        lead = WINDOW - STRIDE
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(s, -LOGIT, LOGIT, out=s)
        s += self.mask
        seen = inputs[:, :lead] != pad  # pads stand only before a text's start (or after its end, where nothing is scored)
        if not seen.all():
            s[:, :, :lead] += np.where(seen, 0, -1e9).astype(np.float32)[:, None, :]
        np.exp(s, out=s)
        s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(len(s), -1, 1)
        h = own + np.matmul(s, v)
        z = h.reshape(-1, WIDTH) @ self.out + self.bias
        np.clip(z, -LOGIT, LOGIT, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(EXPERTS, np.float32))[:, None]
        return z, s, h, v, q, k

    def freeze(self) -> AttentionMixture:
        """One row for each subword and place, with its query, key, value and embedding, so that scoring looks up once.

        The experts' biases are factors of the weights, and go into the experts' tables.
        """
        parts = np.concatenate([self.query / np.float32(math.sqrt(WIDTH)), self.key, self.value, np.eye(WIDTH, dtype=np.float32)], 1)
        self.rows, self.places = self.embed @ parts, self.place @ parts
        self.tilt = np.exp(np.clip(self.bias, -LOGIT / 3, LOGIT / 3))
        self.tilted = self.experts * self.tilt
        at = np.arange(WINDOW)
        self.allowed = (at[None, :] <= at[WINDOW - STRIDE :, None]).astype(np.float32)
        self.ones = np.ones(WINDOW, np.float32)
        return self

    def factors(self, inputs: np.ndarray, pad: int) -> np.ndarray:
        """What ``mix`` weighs, after ``freeze``, without the experts' biases and not yet divided by its sum."""
        lead, n = WINDOW - STRIDE, len(inputs)
        row = self.rows.take(inputs, 0)
        row += self.places
        q, k, v, h = row[:, lead:, :WIDTH], row[:, :, WIDTH : 2 * WIDTH], row[:, :, 2 * WIDTH : 3 * WIDTH], row[:, lead:, 3 * WIDTH :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(s, -LOGIT, LOGIT, out=s)
        np.exp(s, out=s)
        s *= self.allowed
        s[inputs[:, 0] == pad, :, :lead] = 0  # a text's first window: all before its start is pads, and no other window has them there
        seen = np.matmul(s, v)
        seen /= (s.reshape(-1, WINDOW) @ self.ones).reshape(n, STRIDE, 1)
        seen += h
        z = seen.reshape(-1, WIDTH) @ self.out
        np.clip(z, -LOGIT, LOGIT, out=z)
        np.exp(z, out=z)
        return z

    def probabilities(self, inputs: np.ndarray, targets: np.ndarray, pad: int) -> np.ndarray:
        """Probabilities of the targets, with one division a position in place of many."""
        z = self.factors(inputs, pad)
        return (np.einsum("nk,nk->n", z, self.tilted.take(targets.reshape(-1), 0)) / (z @ self.tilt)).reshape(targets.shape)

    def add_responsibilities(self, inputs: np.ndarray, targets: np.ndarray, pad: int, counts: np.ndarray) -> None:
        """Add to ``counts`` (subword, expert) how far each expert answers for each target; after ``freeze``."""
        for at in range(0, len(inputs), BATCH):
            goal = targets[at : at + BATCH].reshape(-1)
            r = self.factors(inputs[at : at + BATCH], pad) * self.tilted.take(goal, 0)
            r /= r.sum(1, keepdims=True) + 1e-30
            real = goal != pad
            _add_rows(counts, goal[real], r[real])

    def renew(self, counts: np.ndarray, prior: np.ndarray) -> None:
        """Experts from their counts, with the corpus counts at a weight that grows with them."""
        table = counts + prior[:, None] * (PRIOR * counts.sum(0) + 1e-3)
        self.experts = (table / table.sum(0)).astype(np.float32)

    def log10(self, ids: list[np.ndarray], first: int, pad: int) -> np.ndarray:
        """Log10 probability of every id of the sequences, one after the other."""
        return np.log10(self.chances(ids, first, pad))

    def chances(self, ids: list[np.ndarray], first: int, pad: int) -> np.ndarray:
        """Probability of every id of the sequences, one after the other."""
        cut = [windows_of(x, first, pad) for x in ids]
        if not cut:
            return np.zeros(0, np.float32)
        inputs, targets = np.concatenate([i for i, _ in cut]), np.concatenate([t for _, t in cut])
        out = np.empty(targets.shape, np.float32)
        for at in range(0, len(inputs), BATCH):
            out[at : at + BATCH] = np.maximum(self.probabilities(inputs[at : at + BATCH], targets[at : at + BATCH], pad), 1e-30)
        return out[targets != pad]

    def start(self) -> None:
        self.moments, self.step = {n: [np.zeros_like(getattr(self, n)) for _ in range(2)] for n in self.NAMES}, 0

    def learn(self, x: np.ndarray, goal: np.ndarray, pad: int, rate: float, counts: np.ndarray | None = None) -> None:
        """A step of Adam towards the experts' responsibilities, which are added to ``counts``."""
        goal, lead, n = goal.reshape(-1), WINDOW - STRIDE, len(x)
        order = np.argsort(goal, kind="stable")
        real = int(np.searchsorted(goal[order], pad))  # the pad is the last subword
        scale, share = np.float32(1 / math.sqrt(WIDTH)), np.float32(1 / max(1, real))
        flat = lambda a: a.reshape(-1, a.shape[-1])
        e = self.embed.take(x, 0)  # queries, keys and values of this batch alone, not of the whole vocabulary
        e += self.place
        turns = np.concatenate([self.query * scale, self.key, self.value], 1)
        qkv = (flat(e) @ turns).reshape(n, WINDOW, 3 * WIDTH)
        z, s, h, v, q, k = self._mixed(x, pad, qkv[:, lead:, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :], e[:, lead:])
        r = self.experts.take(goal, 0)
        r *= z
        r /= (r @ np.ones(EXPERTS, np.float32) + np.float32(1e-30))[:, None]
        if counts is not None:
            _add_ordered(counts, goal, order[:real], r)
        dz = np.subtract(z, r, out=z)
        dz[order[real:]] = 0
        g = {"out": flat(h).T @ dz * share, "bias": np.ones(len(dz), np.float32) @ dz * share}
        dh = (dz @ (self.out.T * share)).reshape(n, STRIDE, WIDTH)
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        ds -= np.einsum("nij,nij->ni", ds, s)[:, :, None]
        ds *= s
        d = np.empty((n, WINDOW, 3 * WIDTH), np.float32)  # changes of queries, keys and values
        d[:, :lead, :WIDTH] = 0
        np.matmul(ds, k, out=d[:, lead:, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
        np.matmul(s.transpose(0, 2, 1), dh, out=d[:, :, 2 * WIDTH :])
        g["query"], g["key"], g["value"] = np.split(flat(e).T @ flat(d), 3, 1)
        g["query"] = g["query"] * scale
        de = (flat(d) @ turns.T).reshape(e.shape)
        de[:, lead:] += dh
        g["place"] = (np.ones(n, np.float32) @ de.reshape(n, -1)).reshape(WINDOW, WIDTH)
        rows, own = _sums_of_rows(x.reshape(-1), np.argsort(x.reshape(-1), kind="stable"), flat(de))
        self.step += 1
        fix = math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for name in self.NAMES:
            table, (m, w) = getattr(self, name), self.moments[name]
            some = name == "embed"  # of the embeddings only those that occur
            grad = own if some else g[name]
            first, second = (m.take(rows, 0), w.take(rows, 0)) if some else (m, w)
            first *= np.float32(0.9)
            first += np.float32(0.1) * grad
            second *= np.float32(0.99)
            second += np.float32(0.01) * grad * grad
            step = np.float32(rate * fix) * first / (np.sqrt(second) + np.float32(1e-8))
            if some:
                m[rows], w[rows] = first, second
                table[rows] -= step
            else:
                table -= step

    def fit(self, inputs: np.ndarray, targets: np.ndarray, pad: int, prior: np.ndarray, start: np.ndarray, epochs: int = EPOCHS, size: int = 128) -> AttentionMixture:
        """Experts by expectation-maximisation, the network by Adam towards the experts' responsibilities.

        ``prior``: probabilities of subwords over the whole corpus; ``start``: the expert that each subword starts in.
        """
        vocabulary, rng = len(self.embed), np.random.default_rng(5)
        counts = np.ones((vocabulary, EXPERTS)) * 0.02
        counts[np.arange(vocabulary), start] += 1
        counts *= prior[:, None] * max(1, targets.size)

        self.renew(counts, prior)
        self.start()
        for epoch in range(epochs):
            counts = np.zeros((vocabulary, EXPERTS))
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), size):
                pick = order[at : at + size]
                self.learn(inputs[pick], targets[pick], pad, 0.02 * (1 - 0.8 * epoch / epochs), counts)
            self.renew(counts, prior)
        return self.freeze()


def learn_network(train: DataFrame, words: int, vocabulary: str) -> AttentionMixture:
    """Network and experts from all rows of (id, ids), of so many words; a sample of windows gives the point to start from."""
    bpe = coder(vocabulary)
    size, end = len(bpe.strings) + 1, len(bpe.strings) - 1
    pad = size - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code in batch.column(0).to_pylist():
                inputs, targets = windows_of(_unpacked(code, size), end, pad)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(np.int32)), kind) for x in (inputs, targets)], names=["inputs", "targets"])

    chosen = train.select(F.col("id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCUMENTS).distinct()
    texts = train.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("ids")
    windows = stage(texts.mapInArrow(cut, "inputs array<int>, targets array<int>"), "windows")
    part = min(1.0, SAMPLE_WINDOWS / max(1, windows.count()))
    sample = windows.where(F.pmod(F.xxhash64("inputs", "targets"), F.lit(1 << 20)) < int(part * (1 << 20))).toArrow()
    unstage(windows)
    model = AttentionMixture(size)
    if sample.num_rows:
        inputs, targets = (np.stack(sample.column(c).to_pandas().to_numpy()).astype(np.int64) for c in ("inputs", "targets"))
        order = np.lexsort([*inputs.T[:4], *targets.T])  # whatever order the rows came in
        inputs, targets = inputs[order], targets[order]
        prior = np.bincount(targets[targets != pad], minlength=size) + 0.1
        prior[pad] = 0
        prior /= prior.sum()
        # Subwords start in experts by whether they end a word, and by their first letters.
        start = np.array([(hash_of(s[:2]) * 2 + s.endswith("</w>")) % EXPERTS for s in bpe.strings] + [0])
        model.fit(inputs, targets, pad, prior, start)
    refine(model, train, max(1, round(words / GROUP_WORDS)))
    return model.freeze()


def _packed(ids: np.ndarray, size: int) -> bytes:
    """Ids below ``size`` in two bytes each, if that holds them, else in four."""
    return ids.astype("<u2" if size <= 1 << 16 else "<u4").tobytes()


def _ids(code: bytes, size: int) -> np.ndarray:
    return np.frombuffer(code, "<u2" if size <= 1 << 16 else "<u4")


def _unpacked(code: bytes, size: int) -> np.ndarray:
    return _ids(code, size).astype(np.int64)


def _pieces(codes: pa.ChunkedArray, size: int) -> Iterator[list[np.ndarray]]:
    """The ids of rows in their order, so many rows together that they hold about LEARNED_IDS."""
    held, count = [], 0
    for code in codes:
        held.append(_unpacked(code.as_py(), size))
        count += len(held[-1])
        if count >= LEARNED_IDS:
            yield held
            held, count = [], 0
    if held:
        yield held


_SUMS = [f"c{i}" for i in range(EXPERTS)]
_PARTS = "part string, at int, n double, " + ", ".join(f"{c} float" for c in _SUMS)


def _parts(part: str, at: np.ndarray, n: float, values: np.ndarray) -> pa.RecordBatch:
    """Rows of a table of weights or counts, at most EXPERTS wide; columns beyond its width are null."""
    none = pa.nulls(len(at), pa.float32())
    columns = [pa.array(np.ascontiguousarray(values[:, i], np.float32)) if i < values.shape[1] else none for i in range(EXPERTS)]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), float(n))), *columns], names=["part", "at", "n", *_SUMS])


def _summed(parts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, n, sums) by part: no more than the weights' size reaches the driver."""
    found = stage(parts.groupBy("part", "at").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS]), "sums").toArrow()
    names, at, n = np.array(found.column("part").to_pylist()), found.column("at").to_numpy(), found.column("n").to_numpy()
    values = np.stack([np.nan_to_num(found.column(c).to_numpy()) for c in _SUMS], 1) if len(at) else np.zeros((0, EXPERTS))
    return {str(p): (at[names == p], n[names == p], values[names == p]) for p in set(names.tolist())}


def refine(model: AttentionMixture, train: DataFrame, groups: int) -> None:
    """Learn from all rows of (id, ids): groups of rows start alike, their changes to the network are averaged, and what
    the experts answer for in all of them is summed. A row's group depends on the row alone."""
    rows = train.select(F.xxhash64("id", "ids").alias("key"), "ids").withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    sent = train.sparkSession.sparkContext.broadcast(model.weights())

    def tune(table: pa.Table) -> pa.Table:
        forget()
        before = sent.value
        own = AttentionMixture.of(before)
        size, rng = len(own.embed), np.random.default_rng(5)
        pad, end = size - 1, size - 2
        counts, learned = np.zeros((size, EXPERTS)), 0
        own.start()
        for ids in _pieces(table.sort_by("key").column("ids"), size):
            cut = [windows_of(x, end, pad) for x in ids]
            inputs, targets = np.concatenate([i for i, _ in cut]), np.concatenate([t for _, t in cut])
            order, few = rng.permutation(len(inputs)), np.zeros((size, EXPERTS), np.float32)  # half as much to move as what is summed in the end
            for at in range(0, len(order), 128):
                own.learn(inputs[order[at : at + 128]], targets[order[at : at + 128]], pad, RATE, few)
            counts += few
            learned += len(inputs)
        out = []
        for name in own.NAMES:
            change = np.atleast_2d(getattr(own, name) - before[name])
            at = np.flatnonzero(change.any(1))
            out.append(_parts(name, at, learned, change[at] * float(learned)))
        at = np.flatnonzero(counts.any(1))
        out.append(_parts("experts", at, 0, counts[at]))
        return pa.Table.from_batches(out)

    counts = np.zeros((len(model.embed), EXPERTS))
    for name, (at, n, sums) in _summed(rows.groupBy("group").applyInArrow(tune, _PARTS)).items():
        if name == "experts":
            counts[at] = sums
        else:
            weights = np.atleast_2d(getattr(model, name))
            weights[at] += (sums[:, : weights.shape[1]] / n[:, None]).astype(np.float32)
    if counts.any():
        prior = counts.sum(1) + 0.1
        prior[-1] = 0  # the pad
        model.renew(counts, prior / prior.sum())
    sent.unpersist()


def hash_of(text: str) -> int:
    out = 7
    for c in text:
        out = (out * 31 + ord(c)) % 1_000_003
    return out


# -- scoring -------------------------------------------------------------------------------------------------------------

_CODED = "id {}, row long, held_out boolean, n_tokens long, known long, base double, words array<struct<word: binary, times: long>>, ids binary, n_ids long, chunk long"


def _handled(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches of at most SCORED_ROWS rows and about SCORED_BYTES bytes in a column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + SCORED_BYTES
            to = min(at + SCORED_ROWS, max(at + 1, int(np.searchsorted(ends, most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def contexts_of(ids: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, context, context with what follows) of the positions whose context the memory holds, over all sequences.

    A context is the hash of the ORDER ids before a position; before a sequence's start stands ``first``.
    """
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(ids)) - np.repeat(starts, lengths)
    h = np.zeros(len(ids), np.uint64)
    for back in range(1, ORDER + 1):
        before = np.full(len(ids), first, np.int64)
        before[back:] = ids[: len(ids) - back] if len(ids) > back else ids[:0]
        h = _mix(h * np.uint64(31) + np.where(inside >= back, before, first).astype(np.uint64) + np.uint64(back))
    place = np.flatnonzero(h % np.uint64(MEMORY) == 0)
    h = h[place]
    whole = _mix(h + np.uint64(0x632BE59BD9B4E019) * (ids[place].astype(np.uint64) + np.uint64(1)))
    return place, (h >> np.uint64(1)).astype(np.int64), (whole >> np.uint64(1)).astype(np.int64)


def context_bits(size: int) -> tuple[int, int]:
    """Bits of an id below ``size``, and of a context beside it in a 64-bit word."""
    bits = (size - 1).bit_length()
    return bits, min(ORDER * bits, 64 - bits)


def keys_of(ids: np.ndarray, lengths: np.ndarray, first: int, size: int) -> np.ndarray:
    """A 64-bit word for every position of the sequences: its context, spread over all words, and then its id.

    A context is the ORDER ids before a position; before a sequence's start stands ``first``. Where they fit beside the id,
    words differ if contexts do; else they are hashes.
    """
    bits, wide = context_bits(size)
    starts = np.cumsum(lengths) - lengths
    own = ids.astype(np.uint64)
    h = np.zeros(len(ids), np.uint64)
    for back in range(1, ORDER + 1):
        before = np.empty_like(own)
        before[back:], before[:back] = own[:-back], first
        for at in range(back):
            before[starts[lengths > at] + at] = first
        h = h << np.uint64(bits) | before if ORDER * bits <= wide else _mix(h * np.uint64(31) + before + np.uint64(back))
    every = np.uint64((1 << wide) - 1)
    h = h & every if ORDER * bits <= wide else h >> np.uint64(64 - wide)
    half = np.uint64(wide // 2)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):  # one to one on words of so many bits
        h ^= h >> half
        h *= np.uint64(factor)
        h &= every
    h ^= h >> half
    return h << np.uint64(bits) | own


def _chunk_keys(texts: list[np.ndarray], size: int) -> np.ndarray:
    """``keys_of`` all texts of a chunk, made for about LEARNED_IDS subwords at a time: it takes several times what it gives."""
    out, done, at = np.empty(sum(map(len, texts)), np.uint64), 0, 0
    while at < len(texts):
        to, n = at + 1, len(texts[at])
        while to < len(texts) and n + len(texts[to]) <= LEARNED_IDS:
            n += len(texts[to])
            to += 1
        out[done : done + n] = keys_of(np.concatenate(texts[at:to]), np.array([len(x) for x in texts[at:to]]), size - 2, size)
        at, done = to, done + n
    return out


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of integers from 0 up, as planes of bytes that compress well."""
    out = []
    for values in columns:
        wide = (int(values.max(initial=0)).bit_length() + 7) // 8
        out += [pack("<QB", len(values), wide), values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()]
    plain = b"".join(out)
    return pack("<Q", len(plain)) + pa.compress(plain, codec="zstd", asbytes=True)


def _loosed(data: bytes) -> list[np.ndarray]:
    plain = pa.decompress(data[8:], decompressed_size=unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(plain):
        n, wide = unpack_from("<QB", plain, at)
        values = np.zeros((n, 8), np.uint8)
        values[:, :wide] = np.frombuffer(plain, np.uint8, n * wide, at + 9).reshape(wide, n).T
        out.append(values.reshape(-1).view("<u8"))
        at += 9 + n * wide
    return out


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values stand among ordered ones."""
    at = np.searchsorted(ordered, values)
    out = at < len(ordered)
    out[out] = ordered[at[out]] == values[out]
    return out


def _cuts(keys: np.ndarray, bits: int, wide: int, parts: int) -> np.ndarray:
    """Where, in ordered keys, each of so many ranges of contexts begins, and the end."""
    step = -(-(1 << wide) // parts)
    return np.append(np.searchsorted(keys, np.array([min(i * step, (1 << wide) - 1) for i in range(parts)], np.uint64) << np.uint64(bits)), len(keys))


_ASKED = "part int, chunk long, start long, stop long, keys binary"
_ANSWERED = "part int, chunk long, start long, stop long, counts binary, once long, twice long"


def _asked(coded: DataFrame, size: int, parts: int) -> DataFrame:
    """What each chunk has of each range of contexts: contexts, how many continuations each has, these, and how often each is
    learned from. Where a task reads only some rows of a chunk, ``start`` to ``stop`` tells them."""
    bits, wide = context_bits(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pa.default_memory_pool().release_unused()  # what a learning task held
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            taught = _chunk_keys([_ids(code, size) for _, _, out, code in held if not out], size)
            taught.sort()
            starts = _runs(taught)
            times, taught = np.diff(starts, append=len(taught)).astype(np.uint32), taught[starts]
            others = _chunk_keys([_ids(code, size) for _, _, out, code in held if out], size)
            others.sort()
            others = others[_runs(others)]
            ordered = np.concatenate([taught, others[~_among(others, taught)]])
            order = np.argsort(ordered, kind="stable")
            ordered, times = ordered[order], np.concatenate([times, np.zeros(len(order) - len(times), np.uint32)])[order]
            cuts = _cuts(ordered, bits, wide, parts)
            for part in range(parts):
                a, b = cuts[part], cuts[part + 1]
                if a < b:
                    contexts = ordered[a:b] >> np.uint64(bits)
                    at = _runs(contexts)
                    data = _squeezed(np.diff(contexts[at], prepend=np.uint64(0)), np.diff(at, append=b - a), ordered[a:b] & np.uint64((1 << bits) - 1), times[a:b])
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": [held[0][0]], "start": [held[0][1]], "stop": [held[-1][1]], "keys": pa.array([data], pa.binary())})

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    yield from out()
                    held = []
                held.append(row)
        if held:
            yield from out()

    return coded.select("chunk", "row", "held_out", "ids").mapInArrow(run, _ASKED)


def _answered(asked: DataFrame, size: int) -> DataFrame:
    """For each chunk and range: of its continuations how often all chunks have them, of its contexts that in all and of how
    many kinds. Of each range also how many continuations occur once and twice."""
    bits = np.uint64(context_bits(size)[0])

    def run(table: pa.Table) -> pa.Table:
        forget()
        parts = [_loosed(x) for x in table.column("keys").to_pylist()]
        keys = np.concatenate([np.repeat(np.cumsum(c), n.astype(np.int64)) << bits | k for c, n, k, _ in parts])
        times = np.concatenate([t.astype(np.uint32) for *_, t in parts])
        parts = [(n.astype(np.int32), len(k)) for _, n, k, _ in parts]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = _runs(keys)
        c = np.add.reduceat(times[order], at, dtype=np.int64)
        place = np.empty(len(keys), np.int32)
        place[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(at, append=len(keys)))
        contexts = keys[at] >> bits
        start = _runs(contexts)
        total, kinds = np.add.reduceat(c, start), np.add.reduceat((c > 0).astype(np.int64), start)
        owner = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(start, append=len(at)))
        out, ahead = [], 0
        for n, held in parts:
            own = place[ahead : ahead + held]
            of = owner[own[np.cumsum(n) - n]]
            out.append(_squeezed(c[own], n, total[of], kinds[of]))
            ahead += held
        seen = [[int((c == k).sum())] + [0] * (len(out) - 1) for k in (1, 2)]
        columns = [*[table.column(x) for x in ("part", "chunk", "start", "stop")], pa.array(out, pa.binary()), *[pa.array(x, pa.int64()) for x in seen]]
        return pa.table(columns, names=["part", "chunk", "start", "stop", "counts", "once", "twice"])

    return asked.groupBy("part").applyInArrow(run, _ANSWERED)


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _known(keys: np.ndarray, counts: list[bytes], discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each position: with the memory its probability p is a + b p. ``counts``: the answers to its chunk, in order."""
    order = np.argsort(keys)
    at = _runs(keys[order])
    a, b = np.zeros(len(at), np.float32), np.ones(len(at), np.float32)
    ahead = 0
    for data in counts:
        c, n, total, kinds = (x.astype(np.int64) for x in _loosed(data))
        total, kinds = np.repeat(total, n), np.repeat(kinds, n)
        own = slice(ahead, ahead + len(c))
        a[own] = np.where(total > 0, np.maximum(c - discount, 0) / np.maximum(total, 1), 0)
        b[own] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1)
        ahead += len(c)
    if ahead != len(at):
        raise ValueError(f"a chunk of {len(at)} continuations has answers for {ahead}")
    sizes, spread = np.diff(at, append=len(keys)), [np.empty(len(keys), np.float32) for _ in "ab"]
    for out, values in zip(spread, (a, b)):
        out[order] = np.repeat(values, sizes)
    return spread[0], spread[1]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (constants of a common finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs, of which some may be empty."""
    return np.add.reduceat(np.append(values, 0), starts) * (sizes > 0)


def _structs(sizes: np.ndarray, **columns: pa.Array) -> pa.ListArray:
    """Lists of structs, so many for each row."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _head(counts: DataFrame) -> pa.Table:
    """The most frequent words, at most HEAD_WORDS: a histogram of counts gives the least count, then only those are read."""
    short = counts.where(F.length("word") <= HEAD_BYTES).withColumn("class", F.floor(F.log2("n") * 16).cast("int"))
    room, least = HEAD_WORDS, None
    for r in sorted(short.groupBy("class").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["class"]
    chosen = short.where(F.col("class") >= least) if least is not None else short.where("false")
    return chosen.select("word", "n").toArrow()


def _remembered(scored: DataFrame) -> DataFrame:
    """(row, more): what the memory adds to a row's score."""
    at = scored.select("row", "held_out", F.inline("places"))
    counts = at.where("not held_out").groupBy("context", "going_on").agg(F.count("*").alias("c"))
    window = Window.partitionBy("context")  # at most as many rows as the vocabulary has subwords
    counts = stage(counts.withColumn("total", F.sum("c").over(window)).withColumn("kinds", F.count("*").over(window)), "memory")
    once = counts.agg(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("n2")).first()
    n1, n2 = once["n1"] or 0, once["n2"] or 0
    discount = discount_of(n1, n2)
    counted = counts.select("going_on", "c", "total", "kinds")
    p = F.col("p").cast("double")
    known = (F.col("c") - discount + discount * F.col("kinds") * p) / F.col("total")
    learned = join_hot(at.where("not held_out").select("row", "going_on", "p"), counted, "going_on", "c", "row").select("row", F.log10(known / p).alias("more"))
    # only rows not learned from have contexts that never went on as they do there
    met = join_hot(at.where("held_out").select("row", "context", "going_on", "p"), counted, "going_on", "c", "row")
    totals = counts.groupBy("context").agg(F.first("total").alias("all"), F.first("kinds").alias("ways")).withColumnRenamed("context", "open")
    met = met.withColumn("open", F.when(F.col("c").isNull(), F.col("context")).otherwise(-1 - F.col("row")))
    met = join_hot(met, totals, "open", "all", "row")
    mixed = F.coalesce(known, discount * F.col("ways") * p / F.col("all"), p)
    return learned.unionByName(met.select("row", F.log10(mixed / p).alias("more"))).groupBy("row").agg(F.sum("more").alias("more"))


def _let_go(spark) -> None:
    """Have the files of shuffles deleted that no table needs any more: the driver's collector finds them, but need not run before the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities."""
    spark = docs.sparkSession
    short_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), (~may_learn(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    counts = stage(count_words(rows.where("not held_out").select("text")), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = n + 0.5 * (v + 1)
    head = _head(counts)
    logs = np.log10((head.column("n").to_numpy() + 0.5) / total)
    heads: Broadcast = spark.sparkContext.broadcast((b"\n".join(head.column("word").to_pylist()), logs.astype(np.float64)))
    unseen = math.log10(0.5 / total)
    size = len(coder(vocabulary).strings) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = heads.value
        known, bpe = dict(zip(words.split(b"\n"), values.tolist())), coder(vocabulary)
        bpe.entries = CACHE_ENTRIES
        end = size - 2
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in _handled(batches, 3):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            codes = [_packed(np.append(np.frombuffer(c, "<u4"), end), size) for c in bpe.encode_plain(texts)]
            split = [words_of(t) for t in texts]
            sizes = np.array([len(w) for w in split])
            whole = list(chain.from_iterable(split))
            values = np.array(list(map(known.get, whole)), np.float64)  # None, where a word is not known, becomes NaN
            far, starts = np.isnan(values), np.cumsum(sizes) - sizes
            ended = known.get(b"", math.nan)
            base = _sums(np.where(far, 0.0, values), starts, sizes) + (0.0 if math.isnan(ended) else ended)
            kn = _sums((~far).astype(np.int64), starts, sizes) + (not math.isnan(ended))
            rest: list[Counter] = [Counter() for _ in texts]
            for i, k in zip(np.repeat(np.arange(len(texts)), sizes)[far].tolist(), np.flatnonzero(far).tolist()):
                rest[i][whole[k]] += 1
            if math.isnan(ended):
                for found in rest:
                    found[b""] = 1
            words = _structs([len(c) for c in rest], word=pa.array([w for c in rest for w in c], pa.binary()), times=pa.array([n for c in rest for n in c.values()], pa.int64()))
            counts_of = [len(_ids(c, size)) for c in codes]
            chunks = []
            for n_ids in counts_of:
                if held and held + n_ids > CHUNK_IDS:
                    chunk, held = chunk + 1, 0
                held += n_ids
                chunks.append(chunk)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes + 1, pa.int64()), pa.array(kn, pa.int64()), pa.array(base, pa.float64()), words, pa.array(codes, pa.binary()), pa.array(counts_of, pa.int64()), pa.array(chunks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "held_out", "n_tokens", "known", "base", "words", "ids", "n_ids", "chunk"])

    coded = stage(rows.mapInArrow(encode, _CODED.format(id_type)), "coded")
    sent = spark.sparkContext.broadcast(learn_network(coded.where("not held_out").select("id", "ids"), n, vocabulary).weights())

    _let_go(spark)
    parts = max(1, -(-(coded.agg(F.sum("n_ids")).first()[0] or 0) // COUNTED_IDS))
    answers = stage(_answered(_asked(coded, size, parts), size), "memory")
    discount = discount_of(*answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("once", "twice")]).first())
    _let_go(spark)  # the last query's shuffle is held until another has run

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        forget()
        own = AttentionMixture.of(sent.value).freeze()
        texts, answers = texts.sort_by("row"), answers.sort_by([("start", "ascending"), ("part", "ascending")])
        at, out = texts.column("row").to_numpy(), []
        starts, stops = answers.column("start").to_numpy(), answers.column("stop").to_numpy()
        for start in np.unique(starts):
            mine = np.flatnonzero(starts == start)
            first, last = np.searchsorted(at, start), np.searchsorted(at, stops[mine[0]], side="right")
            codes = [_ids(c.as_py(), size) for c in texts.column("ids").slice(first, last - first)]
            lengths = np.array([len(x) for x in codes])
            a, b = _known(_chunk_keys(codes, size), answers.column("counts").take(mine).to_pylist(), discount)
            ends, p = np.cumsum(lengths), np.empty(len(a), np.float32)
            done = 0
            while done < len(lengths):
                most = (ends[done - 1] if done else 0) + SCORED_BYTES // 4
                to = min(done + SCORED_ROWS, max(done + 1, int(np.searchsorted(ends, most, side="right"))))
                p[ends[done] - lengths[done] : ends[to - 1]] = own.chances(codes[done:to], size - 2, size - 1)
                done = to
            b *= p
            b += a
            out.append(pa.table([pa.array(at[first:last]), np.add.reduceat(np.log10(b, out=b), ends - lengths, dtype=np.float64)], names=["row", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())], names=["row", "score"])

    scores = stage(coded.select("chunk", "row", "ids").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "row long, score double"), "scores")
    unstage(answers)
    scored = coded.drop("ids", "n_ids", "chunk")
    rest = scored.select("row", F.inline("words")).join(counts, "word", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.coalesce(F.log10((F.col("n") + 0.5) / total), F.lit(unseen))).alias("more_base"),
    )
    out = scored.drop("words").join(rest, "row", "left").join(scores, "row")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
