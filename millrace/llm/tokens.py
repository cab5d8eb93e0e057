"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import by_size, decoded

#: Where the vocabulary files are, and the one that sizes are counted in.
VOCABULARIES = os.environ.get("MILLRACE_VOCABULARIES", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the byte-level vocabularies split text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens by the vocabulary file at ``path``, whose suffix tells its library."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coder.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def sized_texts(df: DataFrame, key: str, source: str, text: str, path: str | None = None) -> DataFrame:
    """``key, source, n_tokens, cluster``: the size of each text and a digest that equal texts share.

    Texts are equal if they are in lower case with runs of white space as one blank. Null and empty
    texts have 0 tokens. Texts are counted whole. Only the three named columns are read.
    """
    path = path or os.path.join(VOCABULARIES, VOCABULARY)
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in batches:
            sizes, digests = [], []
            for _, bodies in decoded(batch.column(2)):
                texts = [t or "" for t in bodies]
                sizes += [n for part in by_size(texts) for n in counter(texts[part])]
                digests += [int.from_bytes(hashlib.blake2b(" ".join(t.lower().split()).encode(), digest_size=8).digest(), "little", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64())], names=["_key", "_source", "n_tokens", "cluster"])

    narrow = df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"))
    sized = narrow.mapInArrow(count, f"_key {kind}, _source string, n_tokens long, cluster long")
    return sized.withColumnsRenamed({"_key": key, "_source": source})


def has_vocabularies() -> bool:
    return os.path.isdir(VOCABULARIES) and importlib.util.find_spec("tiktoken") is not None
