"""WordPiece encoding as an Arrow UDF, for an optional prose model in ONNX form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

LENGTH = 512
ENCODED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("mask", ArrayType(IntegerType()))])


class WordPiece:
    """Lower-cased words and single punctuation signs, cut greedily into the longest pieces of a vocabulary."""

    def __init__(self, vocabulary: dict[str, int], lower: bool = True):
        self.ids, self.lower = vocabulary, lower
        self.unknown, self.start, self.stop, self.pad = (vocabulary.get(t, d) for t, d in (("[UNK]", 100), ("[CLS]", 101), ("[SEP]", 102), ("[PAD]", 0)))
        self.longest = max(map(len, vocabulary), default=1)

    def words(self, text: str | None) -> list[str]:
        x = unicodedata.normalize("NFKC", text or "")
        x = x.lower() if self.lower else x
        return "".join(f" {c} " if unicodedata.category(c)[0] in "PS" else c for c in x).split()

    def pieces(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            prefix = "##" if at else ""
            ends = range(len(word), at, -1)
            end = next((e for e in ends if prefix + word[at:e] in self.ids), None)
            if end is None:
                return [self.unknown]
            out.append(self.ids[prefix + word[at:end]])
            at = end
        return out

    def encode(self, text: str | None, length: int = LENGTH) -> tuple[list[int], list[int]]:
        ids = [self.start]
        for w in self.words(text):
            ids += [self.ids[w]] if w in self.ids else self.pieces(w)
            if len(ids) >= length - 1:
                break
        ids = [*ids[: length - 1], self.stop]
        fill = length - len(ids)
        return ids + [self.pad] * fill, [1] * len(ids) + [0] * fill


def read_vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {re.sub(r"\n\Z", "", line): i for i, line in enumerate(f)}


def encode(text: Column, vocabulary: dict[str, int], length: int = LENGTH) -> Column:
    """A struct of ids and mask of the given length."""

    @F.pandas_udf(ENCODED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        piece = WordPiece(vocabulary)
        for s in parts:
            yield pd.DataFrame([piece.encode(t, length) for t in s], columns=["ids", "mask"])

    return run(text)


def injection_probability(text: Column, model: str | None, vocabulary: dict[str, int]) -> Column:
    """The last class's probability by an ONNX classifier of (input_ids, attention_mask); 0 without a model, or where it fails."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf(DoubleType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        try:
            session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        except Exception:  # no usable model: scoring goes by rules alone
            session = None
        piece = WordPiece(vocabulary)

        def one(t: str | None) -> float:
            if not t or session is None:
                return 0.0
            try:
                ids, mask = piece.encode(t)
                logits = np.asarray(session.run(None, {"input_ids": np.array([ids], "int64"), "attention_mask": np.array([mask], "int64")})[0][0], float)
                e = np.exp(logits - logits.max())
                return float(e[-1] / e.sum())
            except Exception:  # one text must not end the job
                return 0.0

        for s in parts:
            yield s.map(one)

    return run(text)
