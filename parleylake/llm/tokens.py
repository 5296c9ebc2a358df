"""Token sizes and offsets with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks file of the tokenizer; a parameter of every operator. Each worker reads it from this place.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """A byte-level tokenizer whose tokens have known byte lengths."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """The tokens of a text. The library refuses runs of white space beyond some 100,000; these go in parts."""
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            parts = [p[i : i + 5000] if p.isspace() else p for p in re.split(r"(\s{5000,})", text) if p for i in (range(0, len(p), 5000) if p.isspace() else (0,))]
            return np.concatenate([self.encoding.encode_to_numpy(p, disallowed_special=()) for p in parts])

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def ends(self, text: str) -> np.ndarray:
        """Prefix sums: the byte offset at which each token ends."""
        return np.cumsum(self.lengths[self.ids(text)])


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str) -> Tokenizer:
    """One tokenizer per worker process."""
    return Tokenizer(vocabulary)


def token_counts(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The key columns and ``n_tokens`` of the whole text; a null or empty text has 0 tokens."""
    narrow = df.select(*keys, F.col(text).alias("_text"))
    schema = narrow.drop("_text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for b in batches:
            n = pa.array([t.count(x) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keys, "n_tokens"])

    return narrow.mapInArrow(run, schema)
