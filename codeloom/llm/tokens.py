"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tokenizer's ranks; another file of the same kind may be given.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in parts of about this many characters, cut where white space begins, over which no token of the pattern reaches; so the parts' tokens are the text's.
_PART = 50_000
_CUT, _CUT_BACK = regex.compile(r"(?<=\S)\s"), regex.compile(r"(?r)(?<=\S)\s")
_PRETOKEN = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = RANKS) -> int:
    """Tokens of a whole text; 0 for null and empty ones. The same as of the text encoded at once, at any length.

    A part without a cut, such as a million spaces, overflows the tokenizer's pattern matcher, so its pieces are taken here and merged one by one.
    """
    if not text:
        return 0
    enc, n, at = encoding(path), 0, 0
    while at < len(text):
        end = len(text)
        if end - at > _PART:
            m = _CUT_BACK.search(text, at + 1, at + _PART) or _CUT.search(text, at + _PART)
            end = m.start() if m else end
        part = text[at:end]
        if len(part) <= 2 * _PART:
            n += len(enc.encode_ordinary(part))
        else:
            n += sum(len(enc._encode_single_piece(m[0].encode("utf-8", "surrogatepass"))) for m in _PRETOKEN.finditer(part))
        at = end
    return n


def clean_source(column: str) -> Column:
    """A source's name in lower case with underscores."""
    return F.regexp_replace(F.trim(F.lower(column)), r"[\s\-]+", "_")


def sized(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of each document once; ``source`` in lower case with underscores."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "n_tokens": [count(t, path) for t in pdf.text]})

    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", clean_source("source").alias("source"), "text")
    return rows.mapInPandas(counted, "doc_id long, source string, n_tokens long").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
