"""Token counts by a public vocabulary file; the file's path is a parameter."""

from __future__ import annotations

import functools
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def tokenizer(path: str):
    """This process's tokenizer of a file; a bare name is one of the public vocabularies."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text without special ones; null for null."""

    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        coder = tokenizer(path)
        return values.map(lambda t: None if t is None else len(coder.encode(t, add_special_tokens=False).ids)).astype("Int32")

    return count(text)
