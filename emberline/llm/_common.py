"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberline.tables import materialize  # noqa: F401

#: Words end at space and the five ASCII controls 09-0D, which is what ``bytes.split()`` cuts at.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower case, and every ASCII byte that is neither a digit nor a letter becomes a space.
ALNUM_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
#: A task's word memo is emptied beyond this many entries, so its memory is bounded.
MEMO_LIMIT = 300_000
TMP = "__emberline_"


class WordHash(dict):
    """Memo of 63-bit word hashes."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
