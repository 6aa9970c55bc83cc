"""Token counts of texts under a SentencePiece model.

A text of up to ``chunk`` characters is encoded whole. A longer one is encoded in chunks
that overlap; two neighbours are spliced at a position inside their overlap where

* a token starts in both encodings, and
* no piece of the vocabulary has the two characters at that position next to each other.

The second condition proves that the splice is right: a merge builds a piece of the
vocabulary, so no merge can reach across such a position, neither in the chunks nor in the
whole text, and the tokens on either side depend on that side alone. Where the overlap has
no such position it is doubled, up to the end of the text. So counts are always those of
the whole text, while the encoder never holds more than a chunk of an ordinary document.

Null texts count as empty (0 bytes, 0 tokens); rows are neither dropped nor merged, equal
rows give equal rows; an empty table gives an empty table; columns other than the id and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playcohort.llm.common import map_rows, text_of

SPACE = "▁"


def adjacent_pairs(processor) -> set[str]:
    """The pairs of characters that stand next to each other in some piece."""
    pairs: set[str] = set()
    for i in range(processor.get_piece_size()):
        if processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i):
            continue
        piece = processor.id_to_piece(i).replace(SPACE, " ")
        pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
    return pairs


def token_starts(processor, text: str, shift: int = 0) -> list[int]:
    """Where each token of ``text`` starts, in code points, moved by ``shift``.

    The library gives offsets in bytes; a token that starts inside a character (one byte of
    several) counts as starting with it.
    """
    begins = [piece.begin for piece in processor.encode(text, return_type="proto").pieces]
    if text.isascii():
        return [shift + begin for begin in begins]
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))
    return (shift + character[begins]).tolist()


def common_boundary(
    text: str, left: list[int], right: list[int], low: int, high: int, pairs: set[str]
) -> int | None:
    """The first proven boundary in ``(low, high)`` at which a token starts in both encodings."""
    both = set(left).intersection(right)
    for position in sorted(p for p in both if low < p < high):
        if text[position - 1 : position + 1].replace(SPACE, " ") not in pairs:
            return position
    return None


def spliced_count(processor, text: str, pairs: set[str], chunk: int, overlap: int) -> int:
    """Tokens of a text, encoded in overlapping chunks."""
    total, start, counted_to, size = 0, 0, 0, len(text)
    end = min(chunk, size)
    left = token_starts(processor, text[:end])
    while end < size:
        width = overlap
        next_start = max(start + 1, end - width)
        next_end = min(next_start + chunk, size)
        right = token_starts(processor, text[next_start:next_end], next_start)
        while (at := common_boundary(text, left, right, next_start, min(end, next_end), pairs)) is None:
            if end == size:
                break
            end, width = min(end + width, size), 2 * width
            next_end = min(max(next_end, end + chunk), size)
            left = token_starts(processor, text[start:end], start)
            right = token_starts(processor, text[next_start:next_end], next_start)
        if at is None:
            break
        total += sum(counted_to <= begin < at for begin in left)
        start, end, left, counted_to = next_start, next_end, right, at
    return total + sum(begin >= counted_to for begin in left)


def counter(model_file: str, chunk: int, overlap: int) -> Callable[[dict[str, list]], dict[str, list]]:
    state: dict = {}

    def count(columns: dict[str, list]) -> dict[str, list]:
        if not state:
            import sentencepiece

            state["processor"] = sentencepiece.SentencePieceProcessor(model_file=model_file)
        processor, texts = state["processor"], columns["text"]
        short = [text if len(text) <= chunk else "" for text in texts]
        counts = [len(ids) for ids in processor.encode(short, num_threads=1)]
        for i, text in enumerate(texts):
            if len(text) > chunk:
                if "pairs" not in state:
                    state["pairs"] = adjacent_pairs(processor)
                counts[i] = spliced_count(processor, text, state["pairs"], chunk, overlap)
        return {**columns, "n_tokens": counts}

    return count


def token_counts(
    docs: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 16_384,
    overlap: int = 256,
) -> DataFrame:
    """Columns ``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens``, one row per row of ``docs``.

    ``model_file`` is a path that every executor has. Nothing is shuffled.
    """
    if not 1 <= overlap < chunk:
        raise ValueError("overlap must be at least 1 and below chunk")
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    count = counter(model_file, chunk, overlap)

    def rows(columns: dict[str, list]) -> dict[str, list]:
        out = count(columns)
        return {
            "id": out["id"],
            "n_bytes": [len(text.encode()) for text in out["text"]],
            "n_tokens": out["n_tokens"],
        }

    counted = map_rows(given, rows, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumnRenamed("id", id_col)
