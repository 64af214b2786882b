"""Packing documents into training sequences as vector bin packing.

Each document is encoded and ended by one separator id. Whole sequences' worth of a document is cut off first; what
remains is an item with a demand in three resources: tokens, segments (pieces in a sequence) and loss-bearing tokens.
The item that fits and has the largest dot product of demand and room left, each as a share of its limit, goes in next.
When none fits, the item with most tokens is cut so that its head fills the room.

Packing runs inside each input partition, as a stream with a pool of bounded size, so nothing is shuffled and a lost
task is simply run again on its split. What is left at a partition's end goes into sequences whose lengths are powers
of two. Null texts count as empty (the separator alone); rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder
from .common import short_batches

#: Items in the pool at which sequences are closed.
POOL_ITEMS = 1500


class Packer:
    """Places items (document, start, tokens, loss tokens) in sequences under limits on all three resources."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("each limit is at least 1")
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.pool: list[tuple] = []  # (document, start, tokens, prompt)
        self.sequences = 0

    @staticmethod
    def loss(start: int, tokens: int, prompt: int) -> int:
        return tokens - max(0, min(prompt - start, tokens))

    def _cut(self, item: tuple, tokens: int, room_loss: float) -> int:
        """The longest head, of at most ``tokens``, whose loss tokens fit."""
        _, start, length, prompt = item
        free = max(0, prompt - start)
        return int(min(tokens, length, free + room_loss))

    def add(self, document, length: int, prompt: int = 0) -> Iterator[list[tuple]]:
        """Take a document in; yields sequences that are full: lists of (document, start, tokens)."""
        start, most = 0, int(self.limits[0])
        while length - start >= most:
            n = self._cut((document, start, length - start, prompt), most, self.limits[2])
            yield [(document, start, n)]
            start += n
        if start < length:
            self.pool.append((document, start, length - start, prompt))
        if len(self.pool) >= POOL_ITEMS:
            yield from self.close(whole_only=True)

    def close(self, whole_only: bool = False) -> Iterator[list[tuple]]:
        """Sequences of the pool; with ``whole_only`` those that are full, the rest stays."""
        items = self.pool
        need = np.array([[n, 1, self.loss(s, n, p)] for _, s, n, p in items], float).reshape(-1, 3)
        open_, total = np.ones(len(items), bool), need[:, 0].sum()
        while open_.any():
            if whole_only and total < self.limits[0] * 4:
                break
            sequence, room = [], self.limits.copy()
            while room[0] >= 1 and room[1] >= 1 and open_.any():
                fits = open_ & (need <= room).all(1)
                if fits.any():
                    score = (need / self.limits) @ (room / self.limits)
                    score[~fits] = -1
                    i = int(score.argmax())
                    n = int(need[i, 0])
                    open_[i] = False
                else:
                    i = int(np.where(open_, need[:, 0], -1).argmax())
                    n = self._cut(items[i], int(room[0]), room[2])
                    if n < 1:
                        break
                document, start, length, prompt = items[i]
                sequence.append((document, start, n))
                room -= (n, 1, self.loss(start, n, prompt))
                total -= n
                if n < length:
                    items[i] = (document, start + n, length - n, prompt)
                    need[i] = (length - n, 1, self.loss(start + n, length - n, prompt))
            yield sequence
        self.pool = [x for x, o in zip(items, open_) if o]

    def finish(self) -> Iterator[list[tuple]]:
        """The rest. A sequence that is not full is dealt into sequences whose lengths are powers of two."""
        for sequence in self.close():
            left = sum(n for _, _, n in sequence)
            if left >= self.limits[0]:
                yield sequence
                continue
            pieces = list(sequence)
            while left:
                size, out = 1 << (left.bit_length() - 1), []
                left -= size
                while size:
                    document, start, n = pieces.pop(0)
                    take = min(n, size)
                    out.append((document, start, take))
                    size -= take
                    if take < n:
                        pieces.insert(0, (document, start + take, n - take))
                yield out


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, max_tokens: int = 2048, max_segments: int = 512, max_loss: int | None = None, separator: int = 1, prompt_col: str | None = None, ids: bool = True) -> DataFrame:
    """One row per piece: where it starts in its document, its sequence and its offset there, and its ids (or digest).

    ``prompt_col`` has the number of a row's leading tokens that bear no loss (instruction data); without it, or where
    it is null, all tokens bear loss. ``sequence_id`` is unique over all partitions.
    """
    short_batches(docs.sparkSession)
    max_loss = max_loss or max_tokens
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["token_ids"] * ids
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in names[1:8]) + ", token_ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = coder(vocabulary), Packer(max_tokens, max_segments, max_loss)
        end, first = np.array([separator], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        key_type = None

        def put(sequences) -> None:
            for sequence in sequences:
                offset, number = 0, first + packer.sequences
                packer.sequences += 1
                for (key, code, prompt), start, n in sequence:
                    part = code[4 * start : 4 * (start + n)]
                    rows.append((key, start, n, zlib.crc32(part), len(code) // 4, number, offset, packer.loss(start, n, prompt), *([np.frombuffer(part, "<i4")] if ids else [])))
                    offset += n

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [key_type] + [pa.int64()] * 7 + [pa.list_(pa.int32())] * ids
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            key_type = batch.column(0).type
            prompts = batch.column(2).to_pylist() if prompt_col else [0] * batch.num_rows
            for key, code, prompt in zip(batch.column(0).to_pylist(), bpe.encode(batch.column(1).to_pylist()), prompts):
                code += end
                put(packer.add((key, code, prompt or 0), len(code) // 4, prompt or 0))
            if rows:
                yield out()
        put(packer.finish())
        if rows:
            yield out()

    return docs.select(F.col(id_col), F.col(text_col), *([F.col(prompt_col).cast("long")] if prompt_col else [])).mapInArrow(run, schema)
