"""Token counts and ids by a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame

#: Where the vocabulary files lie on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a file, once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters encoded at once: longer texts are cut at white space, where no token crosses in this vocabulary's pattern.
PIECE = 20_000


def encode(text: str | None, path: str = TOKENIZER) -> list[int]:
    """Token ids of the whole text; a null text has none."""
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        # a lone line break before a letter is a token of its own in the whole text as at the end of a piece
        while end < len(text) and not (text[end - 1] == "\n" and text[end].isalnum() and not text[end - 2].isspace()):
            end += 1
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and n_tokens of each row's whole text."""
    fields = [df.schema[c] for c in keep]

    def run(batches):
        for b in batches:
            out = b[keep].copy()
            out["n_tokens"] = [len(encode(t, path)) for t in b[text]]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return df.select(*keep, text).mapInPandas(run, schema)


def token_ids(df: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep``, n_tokens and the token ids."""
    fields = [df.schema[c] for c in keep]

    def run(batches):
        for b in batches:
            ids = [encode(t, path) for t in b[text]]
            out = b[keep].copy()
            out["n_tokens"] = [len(x) for x in ids]
            out["tokens"] = ids
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, tokens array<int>"
    return df.select(*keep, text).mapInPandas(run, schema)


