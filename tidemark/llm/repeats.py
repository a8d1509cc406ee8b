"""Suffix-array dedup by prefix-free parsing: remove bytes of long strings that occur more than once.

Rolling-hash triggers (the smallest hash in a span, so every string of ``length`` bytes
holds one) cut texts into overlapping phrases. Only triggers that occur more than once
can lie in a repeat. For these the dictionary holds what leads up to the trigger and the
parse what goes on from it; phrases that agree in both are one entry with a count. In a
trigger's bucket two suffix arrays are built, of the dictionary (phrase ends, sorted from
the trigger backwards, so the suffixes that phrases share lie together) and of the parse
(the texts from the trigger on). Ranks in both combine into the order of all suffixes that
reach the trigger; neighbours equal for ``length`` bytes are the repeats. A phrase that
occurs twice settles all its suffixes at once. Order between buckets is not needed and is
not made; ``anchored`` says what happens to a trigger with very many entries.

Null texts are empty; texts shorter than ``length`` lose nothing; repeated rows and
repeated ids are separate texts; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchored, common

TRIGGER_BYTES = 64
#: A random number for each byte value, from a fixed seed.
BYTES = np.random.default_rng(2024).integers(1, anchored.PRIME, 256, dtype=np.uint64)


def _numbers(text: str) -> np.ndarray:
    return BYTES[np.frombuffer(text.encode(), dtype=np.uint8)][None]


def _units(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.uint8)


SYMBOLS = anchored.Symbols(numbers=_numbers, split=str.encode, pack=bytes, units=_units)


def remove_repeats(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes and ``spans`` removed."""
    found = anchored.flagged(docs.select("doc_id", "text"), SYMBOLS, length, min(TRIGGER_BYTES, length), earlier=False)
    both = anchored.with_found(docs.select("doc_id", "text"), found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for text, stretches in zip(common.text_rows(batch), batch.column("_tm_found"), strict=True):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                gone = anchored.covered(len(raw), stretches.values, length)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                kept = raw[~gone].tobytes() if len(edges) else raw.tobytes()
                for name, value in zip(out, (len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept if texts else None, edges.tolist() if texts else None), strict=True):
                    out[name].append(value)
            yield out | {"doc_id": batch.column("doc_id")}

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<long>" * texts
    return common.map_arrow(both.select("doc_id", "text", "_tm_found"), run, schema)
