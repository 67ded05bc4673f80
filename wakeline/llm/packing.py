"""Vector bin packing of token pieces into training sequences.

Every piece asks for a vector of resources: tokens, one segment, and tokens that bear loss.
A sequence is filled by repeatedly taking, among the pieces that fit, the one whose vector has
the largest dot product with what the sequence has left, both in parts of the limits. Pieces
are packed in blocks of bounded size, dealt by hash, so one block is one task's work and no
key, however frequent, meets in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import map_rows, text_or_empty
from wakeline.llm.tokens import ByteBpe
from wakeline.session import staged

#: Pieces packed together. More fill sequences better, fewer make smaller tasks.
BLOCK_PIECES = 16_384


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


def token_pieces(docs: DataFrame, tokenizer: str, tokens: int, end_id: int = 0) -> DataFrame:
    """Cut each text's ids, closed by ``end_id``, into pieces of ``tokens`` and a rest.

    ``docs`` needs doc_id and text; null text counts as empty and yields the end id alone.
    Every id bears loss. Repeated rows are cut as often as they occur.
    """

    def make():
        bpe = ByteBpe(tokenizer)

        def work(columns):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(*columns):
                ids = np.append(bpe.ids(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), tokens):
                    piece = ids[start:start + tokens]
                    for column, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece), len(ids))):
                        column.append(value)
            return [*out, out[2]]

        return work

    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), make,
                    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long")


def fill(length: np.ndarray, loss: np.ndarray, limits: Limits) -> Iterator[list[int]]:
    """Rows of one block, sequence by sequence."""
    order = np.lexsort((loss, length))
    kinds, first, left = np.unique(
        np.stack([length[order], loss[order]]), axis=1, return_index=True, return_counts=True)
    tokens, weight = kinds
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
    if (tokens > most[0]).any() or (weight > most[2]).any():
        raise ValueError("a piece is larger than a sequence")
    demand = np.stack([tokens, np.ones_like(tokens), weight]) / most[:, None]
    remaining, taken = int(left.sum()), 0
    while taken < remaining:
        room, rows = np.ones(3), []
        while True:
            fits = (demand <= room[:, None] + 1e-12).all(axis=0) & (left > 0)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, room @ demand, -1.0)))
            left[best] -= 1
            rows.append(int(order[first[best] + left[best]]))
            room = room - demand[:, best]
        taken += len(rows)
        yield rows


def pack(pieces: DataFrame, limits: Limits = Limits(), block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` (any columns, with length and loss of at most the limits) plus sequence_id, offset.

    Offsets are gapless from 0. A null length or loss counts as 0. The result depends only
    on the rows and the block size, not on timing, if the source is read in a fixed order.
    """
    n_blocks = max(1, -(-pieces.count() // block_pieces))
    names = pieces.columns
    # equal rows get different blocks, so that no repeated row gathers in one
    blocks = pieces.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))

    def pack_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names, kind="stable", na_position="first").reset_index(drop=True)
        length = rows["length"].fillna(0).to_numpy(dtype=np.int64)
        sequence, offset = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        for n, members in enumerate(fill(length, rows["loss"].fillna(0).to_numpy(dtype=np.int64), limits)):
            sequence[members] = key[0] * (1 << 32) + n
            offset[members] = np.cumsum(length[members]) - length[members]
        return rows[names].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return blocks.groupBy("_block").applyInPandas(pack_block, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack whole documents. Clashing column names of ``docs`` are ignored."""
    pieces = staged(token_pieces(docs, tokenizer, limits.tokens, end_id), "pieces")
    return pack(pieces, limits).drop("loss")
