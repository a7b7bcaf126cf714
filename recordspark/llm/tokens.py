"""Sizes of texts in tokens of a public tokenizer, whose folder is a parameter; the encoder is built once per worker."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.runtime import spread

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, ranks: str = RANKS):
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_folder", os.path.join(folder, "__init__.py"))
    info = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(info)
    with open(os.path.join(folder, ranks), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=info.PATTERN, mergeable_ranks=merges, special_tokens={})


def token_count(text: Column, folder: str = FOLDER) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""

    def count(s: pd.Series) -> pd.Series:
        enc = encoder(folder)
        return pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def document_sizes(documents: DataFrame, folder: str = FOLDER, *more: str) -> DataFrame:
    """doc_id, n_tokens and the columns named in `more`; a doc_id met several times counts once, with its longest text, a row without one for itself."""
    rows = spread(documents.select("doc_id", "text", *more)).select("doc_id", token_count(F.col("text"), folder).alias("n_tokens"), *more)
    known = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_tokens", *more)).alias("r")).select("doc_id", "r.*")
    return known.unionByName(rows.filter("doc_id is null"))
