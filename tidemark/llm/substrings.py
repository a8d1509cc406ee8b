"""Substring dedup by super-k-mers: remove words of windows that already start in an earlier document.

A window is ``length`` words, its minimiser the smallest hash of a few words in it.
Consecutive windows that share a minimiser are one super-k-mer. Minimisers that occur
once go at once, and equal super-k-mers merge; the different ones of a minimiser travel
as one packed string each to its bucket, where sorting their words counts the windows
exactly. ``anchored`` says what happens to a minimiser with very many super-k-mers.

Null texts have no words; rows without an id lose nothing and make nothing a repeat;
rows of one id are not earlier than each other; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchored, common

MINIMISER_WORDS = 5


def _split(text: str) -> list[bytes]:
    return text.encode().split()


def _numbers(text: str) -> np.ndarray:
    """Two independent numbers below 2^61 for each word, hashed anew: to look a word up takes longer in a large vocabulary."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, _split(text))), dtype=">u8").reshape(-1, 2).T.astype(np.uint64)
    return np.stack([both[0] >> np.uint64(3) | np.uint64(1), both[1] & np.uint64(anchored.PRIME)])


def _units(packed: list[bytes]) -> np.ndarray:
    words = b" ".join(packed).split()
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), dtype=">u4", count=len(words))


SYMBOLS = anchored.Symbols(numbers=_numbers, split=_split, pack=b" ".join, units=_units)


def _found(docs: DataFrame, length: int, name: str = "_tm_found") -> DataFrame:
    found = anchored.flagged(docs.select("doc_id", "text"), SYMBOLS, length, min(MINIMISER_WORDS, length), earlier=True)
    return anchored.with_found(docs, found, name)


def _kept(text: str, stretches, length: int) -> tuple[list[bytes], list[bytes]]:
    words = text.encode().split()
    if stretches is None or not len(stretches):
        return words, words
    stays = ~anchored.covered(len(words), stretches, length)
    return words, [words[i] for i in np.flatnonzero(stays)]


def remove_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_removed", "kept_sha256")}
            for text, stretches in zip(common.text_rows(batch), batch.column("_tm_found"), strict=True):
                words, kept = _kept(text, stretches.values, length)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield out | {"doc_id": batch.column("doc_id")}

    both = _found(docs.select("doc_id", "text"), length)
    return common.map_arrow(both.select("doc_id", "text", "_tm_found"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """Documents without the repeated words: changed texts have their kept words joined by one space, others stay as they are.

    Documents of which nothing is left go; those that had no words stay. Columns of any
    other name stay as they are.
    """
    names = docs.columns
    mark, gone = common.free(docs, "_tm_found", "_tm_emptied")
    both = _found(docs, length, mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts, emptied = [], []
            for value, stretches in zip(batch.column("text"), batch.column(mark), strict=True):
                text = value.as_py()
                if stretches.values is not None and len(stretches.values):
                    _, kept = _kept(text, stretches.values, length)
                    text = b" ".join(kept).decode()
                texts.append(text)
                emptied.append(text == "" and value.as_py() != "")
            yield {c: batch.column(c) for c in names} | {"text": texts, gone: emptied}

    out = common.map_arrow(both.select(*(f"`{c.replace('`', '``')}`" for c in names), mark), run, common.widened(docs, **{gone: "boolean"})).where(~F.col(gone)).drop(gone)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
