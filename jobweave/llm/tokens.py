"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from jobweave.llm.common import spread

#: Where the vocabulary files lie; another folder can be named by the parameter of every operator.
#: ``.tiktoken`` files hold ranks for byte-level pieces, ``.json`` files a whole tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of ranks split a text before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A longer text is counted in pieces, cut at single blanks between letters, where no token of a byte-level vocabulary crosses.
PIECE = 100_000
_CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of about ``size`` characters whose token counts add up to that of the whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """A function that gives the sizes of texts; strings of special tokens count as ordinary text."""
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(ranked.encode_ordinary(x)) for x in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for k in range(0, len(texts), 64) for e in t.encode_batch(texts[k : k + 64], add_special_tokens=False)]


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of ``docs`` but the text, and n_tokens. A null or empty text has 0 tokens."""
    keep = [f for f in docs.schema if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n_tokens long"
    names = [f.name for f in keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = counter(tokenizer)
        for b in batches:
            cut = [pieces(x or "") for x in b[text]]
            sizes = size([p for c in cut for p in c])
            at, total = 0, []
            for c in cut:
                total.append(sum(sizes[at : at + len(c)]))
                at += len(c)
            yield b[names].assign(n_tokens=total)

    return spread(docs).mapInPandas(count, schema)
