"""Token counts by a whole-token shortcut.

Before any text is read, every vocabulary string that can stand for a pre-token is run through the merge list. Those
that end as the one token of their own name are proven whole: as no merge crosses the border of a pre-token, such a
pre-token counts one token wherever it stands. Texts are then split, whole pre-tokens are counted by looking them
up, and only the others are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Codec, Transducer
from tidemark.llm.common import pieces

#: Tokens that a text may have before it is over the limit.
LIMIT = 2048
#: Distinct merged pre-tokens in one generation of a worker's memory; it holds two.
REMEMBERED = 200_000
#: Longer pre-tokens stream through the transducer and are not remembered.
LONG_PIECE = 256


def whole_pieces(own: Codec) -> frozenset[str]:
    """Pre-tokens that the merge list turns into exactly one token: proven by merging each vocabulary string."""
    found = set()
    for token, number in own.merges.vocab.items():
        shown = token.removesuffix(own.end) if own.end else token
        if not shown or (own.end and not token.endswith(own.end)) or any(c not in own.byte_of for c in shown):
            continue
        piece = bytes(own.byte_of[c] for c in shown).decode("utf-8", "surrogateescape")
        if own.merges.apply(list(own._symbols(piece))) == [number]:
            found.add(piece)
    return frozenset(found)


class Counter:
    """Counts the tokens of whole texts; `merged` counts the distinct pre-tokens that had to be merged."""

    def __init__(self, path: str) -> None:
        self.codec = Codec(path)
        self.whole = whole_pieces(self.codec)
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.merged = 0

    def _merged_size(self, piece: str) -> int:
        found = self.recent.get(piece)
        if found is not None:
            return found
        found = self.older.get(piece)
        if found is None:
            self.merged += 1
            own = self.codec
            if len(piece) > LONG_PIECE:
                stream = Transducer(own.merges, own.sizes)
                return sum(1 for _ in stream.push(own._symbols(piece))) + sum(1 for _ in stream.finish())
            found = len(own.merges.apply(list(own._symbols(piece))))
        if len(self.recent) >= REMEMBERED:
            self.older, self.recent = self.recent, {}
        self.recent[piece] = found
        return found

    def _part(self, part: str) -> int:
        split = self.codec._split(part)
        whole = self.whole
        rest = [piece for piece in split if piece not in whole]
        return len(split) - len(rest) + sum(map(self._merged_size, rest))

    def count(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one token."""
        total, at = 0, 0
        for mark in self.codec.added_split.finditer(text):
            total += self._part(text[at : mark.start()]) + 1
            at = mark.end()
        return total + self._part(text[at:])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit.

    A null or empty text has no bytes and no tokens. Repeated ids give a row each; a null id stays null. Other
    columns are ignored; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in pieces(batches):
            found = [own.count(text) if text else 0 for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(
        F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = picked.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
