"""Token counts without token ids.

The number of pieces of each pre-token is found once, joined to the frequencies of the pre-tokens in
each document, and summed; ids are never put together. The table of counts belongs to a task and is
bounded: a join by shuffle would move about as many rows as there are words.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which the installed regex module and the tokenizer library class letters, digits and
#: spaces alike; texts with others are split by the library.
ALIKE = r"[\x00-\u052f\u2000-\u206f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]"
_TABLE = 200_000  # pre-tokens a task remembers


class PieceCounter:
    """Counts tokens of texts as the library does, with its default treatment of special strings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("the vocabulary must be byte-level, without normalizer or prefix space")
        added = [a for a in spec["added_tokens"]]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names)) or r"(?!)")
        self.split = regex.compile(PATTERN).findall
        self.odd = regex.compile(ALIKE.replace("[", "[^", 1)).search
        self.plain: dict[str, int] = {}
        self.mapped: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[dict[str, int], Counter]:
        """The table that knows these pre-tokens, and their frequencies in the text."""
        if self.odd(text) is None:
            return self.plain, Counter(self.split(text))
        pre = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return self.mapped, Counter(p for p, _ in pre)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty."""
        parts, special = [], []
        for text in texts:
            segments = self.special.split(text or "")
            special.append(len(segments) - 1)
            parts.append([self.pieces(s) for s in segments if s])
        for table in (self.plain, self.mapped):
            if len(table) > _TABLE:
                table.clear()
        self._learn({p for ps in parts for table, freq in ps if table is self.plain for p in freq if p not in table})
        for ps in parts:
            for table, freq in ps:
                if table is self.mapped:
                    for p in freq.keys() - table.keys():
                        table[p] = len(self.tokenizer.model.tokenize(p))
        return [
            n + sum(table[p] * k for table, freq in ps for p, k in freq.items())
            for n, ps in zip(special, parts, strict=True)
        ]

    def _learn(self, new: set[str]) -> None:
        fresh = list(new)
        for i in range(0, len(fresh), 50_000):
            some = fresh[i : i + 50_000]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.plain.update(zip(some, map(len, found), strict=True))


def token_counts(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, n_tokens`` (long) of every row of ``docs``; null texts have 0 tokens.

    ``path`` names the vocabulary file on the executors. Rows that repeat are all counted; other
    columns are not read. A batch is worked on in pieces of about 2 million characters.
    """
    schema = T.StructType([docs.select(F.col(id)).schema[0], T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or PieceCounter(path)
            counts: list[int] = []
            held: list[str | None] = []
            size = 0
            for value in batch.column(1):
                held.append(value.as_py())
                size += len(held[-1] or "")
                if size > 2_000_000:
                    counts += counter.counts(held)
                    held, size = [], 0
            counts += counter.counts(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=[batch.schema.names[0], "n_tokens"]
            )

    return docs.select(F.col(id), F.col(text)).mapInArrow(tidy(run), schema)
