"""Packing tokenised documents into windows of a fixed number of tokens.

A document is cut at every multiple of the window; its full pieces are sequences of their
own, so only the remainder of each document has to be placed. Remainders are dealt into
groups of about ``group_rows`` by a seeded hash and each group is packed online by the
sum-of-squares rule: a level array holds how many windows are open at each fill, and a piece
goes to the level (an open one or a new window) for which the sum of the squared counts
becomes least. A group is one task's work, bounded whatever the size of the table. The rule
leaves some hundred windows open whatever the size of a group, so the pieces in them are
dealt and packed once more.

Texts are tokenised once, where they are read; only narrow piece rows move.

Null texts count as empty; every document ends in the end id, so an empty one is a piece of
one id. Repeated rows are packed like any others; an empty table gives an empty table; null
and repeated document ids are allowed; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playcohort.llm.common import arrow_schema, bounded_batches, text_of
from playcohort.session import staged

#: What tells pieces apart; rows equal in all three are interchangeable.
PIECE = ["id", "ids_crc32", "start"]


#: Characters on whose classes (letter, digit, white space) the two libraries agree.
COMMON = re.compile("[\\x00-\u024f\u1e00-\u1eff\u2010-\u2027\u20ac]*")


def id_encoder(tokenizer_file: str, ranks_file: str | None, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit integers.

    Ids are those of ``tokenizer_file`` in the tokenizers library, without special tokens
    added. ``ranks_file`` is the same byte-level vocabulary as merge ranks: where it is given,
    texts of common characters without the string of an added token are encoded from the
    ranks, which gives the same ids in a third of the time. Other texts, whose words the
    libraries might cut differently, always go to the tokenizer.
    """
    state: dict = {}

    def start() -> None:
        # Without this the library keeps a pool of threads that compete with other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        state["tokenizer"] = Tokenizer.from_file(tokenizer_file)
        state["special"] = [t.content for t in state["tokenizer"].get_added_tokens_decoder().values()]
        if ranks_file:
            import base64

            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            state["ranks"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[bytes]:
        if not state:
            start()
        out: list[bytes] = []
        for text in texts:
            if ranks_file and COMMON.fullmatch(text) and not any(s in text for s in state["special"]):
                ids = state["ranks"].encode_ordinary(text)
            else:
                ids = state["tokenizer"].encode(text, add_special_tokens=False).ids
            out.append(np.asarray(ids, dtype="<u4").tobytes())
        return out

    return encode


def pieces(
    docs: DataFrame,
    tokenizer_file: str,
    window: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    ranks_file: str | None = None,
    pattern: str = "",
) -> DataFrame:
    """Documents as pieces of at most ``window`` ids: id, start, length, ids_crc32, doc_tokens.

    ``tokenizer_file``, ``ranks_file`` and ``pattern``: see ``id_encoder``; the files are paths
    that every executor has.

    ``with_ids`` adds the ids themselves (``ids``, an array of int).
    """
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    schema = (
        T.StructType()
        .add("id", given.schema["id"].dataType)
        .add("start", "long")
        .add("length", "long")
        .add("ids_crc32", "long")
        .add("doc_tokens", "long")
    )
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    target = arrow_schema(schema)
    encode = id_encoder(tokenizer_file, ranks_file, pattern)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns: list[list] = [[] for _ in target]
            for at in range(0, len(texts), 32):
                for key, ids in zip(keys[at : at + 32], encode(texts[at : at + 32])):
                    ids += end
                    for start in range(0, len(ids), 4 * window):
                        part = ids[start : start + 4 * window]
                        row = [key, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4]
                        if with_ids:
                            row.append(np.frombuffer(part, dtype="<u4"))
                        for column, value in zip(columns, row):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target
            )

    return given.mapInArrow(cut, schema)


def sum_of_squares(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Online placement of ``sizes`` (1 to ``window``): window number and offset of each, final fills.

    For a piece of size s and a level h with N(h) open windows, moving one of them to h + s
    changes the sum of squares by 2 (N(h + s) - N(h) + 1), or by 1 - 2 N(h) when it closes;
    a new window changes it by 2 N(s) + 1. Ties go to the fullest level.
    """
    counts = np.zeros(window + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    fills: list[int] = []
    where = np.empty(len(sizes), dtype=np.int64)
    offset = np.empty(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        # Levels 0 to window - size; level 0 is a new window.
        change = 2 * (counts[size:] - counts[: window - size + 1] + 1)
        change[-1] = 1 - 2 * counts[window - size]
        change[counts[: window - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1 if size < window else 0
        level = window - size - int(np.argmin(change[::-1]))
        if level:
            number = open_at[level].pop()
            counts[level] -= 1
        else:
            number = len(fills)
            fills.append(0)
        where[i], offset[i] = number, level
        fills[number] = level + size
        if level + size < window:
            open_at[level + size].append(number)
            counts[level + size] += 1
    return where, offset, np.asarray(fills, dtype=np.int64)


def place(rows: DataFrame, size: str, window: int, group_rows: int, seed: int, keys: list[str]) -> DataFrame:
    """``rows`` with ``_window`` (unique over the table), ``_base`` (offset in it) and ``_fill``."""
    groups = max(1, -(-rows.count() // group_rows))
    dealt = rows.withColumn("_draw", F.xxhash64(F.lit(seed), *keys)).withColumn(
        "_group", F.pmod(F.col("_draw"), F.lit(groups))
    )
    schema = T.StructType([*rows.schema.fields]).add("_window", "long").add("_base", "long").add("_fill", "long")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(name, "ascending") for name in ["_draw", *keys]])
        number, offset, fills = sum_of_squares(group.column(size).to_numpy(), window)
        number_of_group = group.column("_group")[0].as_py()
        for name, values in (
            ("_window", (number_of_group << 32) + number), ("_base", offset), ("_fill", fills[number])
        ):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group.select(schema.names)

    return dealt.groupBy("_group").applyInArrow(pack, schema)


def pack(cut: DataFrame, window: int, group_rows: int = 65_536, seed: int = 0) -> DataFrame:
    """Pieces with the ``sequence_id`` and ``offset`` of each.

    Offsets of a sequence run from 0 without a gap; every sequence but those left open at the
    end holds exactly ``window`` ids.
    """
    cut = staged(cut)
    columns = cut.columns
    full = cut.where(F.col("length") == window)
    first = staged(place(cut.where(F.col("length") < window), "length", window, group_rows, seed, PIECE))
    closed = first.where(F.col("_fill") == window)
    left = first.where(F.col("_fill") < window).select(*columns)
    second = place(left, "length", window, group_rows, seed + 1, PIECE)

    def rows(df: DataFrame, number: Column, kind: int, offset: Column) -> DataFrame:
        # Three ranges of sequence ids that cannot meet.
        return df.select(*columns, (number * 3 + kind).alias("sequence_id"), offset.alias("offset"))

    base = F.col("_base")
    return (
        rows(full, F.monotonically_increasing_id(), 0, F.lit(0).cast("long"))
        .unionByName(rows(closed, F.col("_window"), 1, base))
        .unionByName(rows(second, F.col("_window"), 2, base))
    )


def sequences(packed: DataFrame, window: int, pad_id: int) -> DataFrame:
    """One row per sequence: ``sequence_id`` and its ``window`` ids, padded with ``pad_id``.

    Needs pieces made ``with_ids``.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda part: part["ids"]))
    joined = packed.groupBy("sequence_id").agg(ids.alias("ids"))
    padding = F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))
    return joined.withColumn("ids", F.concat("ids", padding))
