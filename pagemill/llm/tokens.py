"""Token sizes of texts under a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.rows import map_batches

#: Vocabulary file on the driver (ranks, base64 token and rank a line), unless the session names one in ``spark.pagemill.vocabulary``.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How such vocabularies split text before merging, as published with them; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """The tokenizer of a ranks file, once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, *keep: str, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``key, keep..., tokens`` of every row; special-token strings count as ordinary text, a NULL text has 0 tokens.

    The vocabulary (``vocabulary``, the session's, or ``VOCABULARY``) is a file on the driver or of a shared file system;
    it is sent to the executors, which need not have it.
    """
    session = df.sparkSession
    path = vocabulary or session.conf.get("spark.pagemill.vocabulary", VOCABULARY)
    session.sparkContext.addFile(path)
    name = os.path.basename(path)

    def make():
        enc = encoder(SparkFiles.get(name), pattern)

        def fn(cols):
            *rest, texts = cols
            return [*rest, [len(enc.encode_ordinary(t)) if t else 0 for t in texts]]

        return fn

    fields = [key, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in fields) + ", tokens int"
    return map_batches(df.select(*fields, F.col(text).alias("__text")), make, schema)
