"""Byte-level BPE with the tiktoken library: encoding, decoding to raw bytes.

The ranks are a local file whose path is a parameter. The driver reads it and broadcasts its bytes (the size is that of the
vocabulary, whatever the table's); a worker builds the encoder once.

Long texts are cut before they are encoded, at places where every match of the pattern ends whatever stands around: before a
white-space character that follows another character. (A match holds white space only in front, so none goes on past such a
place, and no alternative looks back.) A run of white space without end is the one thing on which the library's matcher
gives up: it is one match up to its last character, which belongs to what follows, or up to the end of the text; so
it is handed to the merges directly.

Defined cases: NULL text is encoded like an empty one, as no ids; NULL ids decode to no bytes; special tokens do not exist, their
strings are ordinary text; repeated rows are encoded each; a text may be as long as a string of Spark; an id that the ranks do not hold is an error.
``encoded`` reads doc_id and text only, ``decoded`` keeps every column beside the one it adds.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed value: the pattern published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: Unicode's White_Space, in which the pattern's \s and Python's differ.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

STEP = 32_768  # characters after which a long text is cut at the next safe place
RUN = 16_384  # white space in a row from which it is handed over directly
SLICE_CHARS = 2_000_000

_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")


@lru_cache(maxsize=4)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class Codec:
    """Ranks and pattern, sent to tasks as a broadcast variable."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = PATTERN) -> None:
        self._ranks, self._pattern = spark.sparkContext.broadcast(Path(path).read_bytes()), pattern

    def encoder(self):
        return _encoder(self._ranks.value, self._pattern)


def cuts(text: str, step: int = STEP) -> Iterator[str]:
    """Parts of some ``step`` characters that can be encoded apart; a part without a safe place in it stays whole."""
    at = 0
    while len(text) - at > step:
        found = _SAFE.search(text, at + step)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode(encoder, text: str, step: int = STEP) -> np.ndarray:
    """Ids of a whole text."""
    if len(text) <= step:
        return encoder.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
    found: list[np.ndarray] = []
    for part in cuts(text, step):
        at = 0
        for run in _LONG_RUN.finditer(part) if len(part) >= RUN else ():
            # its last character goes with what follows; before it, every match ended where the run begins
            end = run.end() if run.end() == len(part) else run.end() - 1
            found.append(encoder.encode_to_numpy(part[at:run.start()], disallowed_special=()))
            found.append(np.array(encoder._encode_single_piece(part[run.start():end].encode()), np.uint32))
            at = end
        found.append(encoder.encode_to_numpy(part[at:] if at else part, disallowed_special=()))
    return np.concatenate(found).astype(np.uint32, copy=False)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_CHARS bytes in a column, one row at least."""
    size = pc.binary_length(batch.column(column)) if not pa.types.is_list(batch.schema.field(column).type) else pc.list_value_length(batch.column(column))
    total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(docs: DataFrame, codec: Codec, packed: bool = False) -> DataFrame:
    """doc_id, ids (array<int>, or with ``packed`` their little-endian unsigned 32-bit bytes), n_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for batch in batches:
            for part in _slices(batch, 1):
                ids = [encode(encoder, t) if t else np.zeros(0, np.uint32) for t in part.column(1).to_pylist()]
                sizes = np.array([len(i) for i in ids], np.int64)
                if packed:
                    column = pa.array([i.astype("<u4", copy=False).tobytes() for i in ids], pa.binary())
                else:
                    flat = pa.array(np.concatenate(ids).astype(np.int32))
                    column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids {'binary' if packed else 'array<int>'}, n_tokens long")


def decoded(rows: DataFrame, codec: Codec, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """The rows and the raw bytes of their ids, which need not be text: a token may end inside a character."""
    place = rows.columns.index(ids)
    is_packed = isinstance(rows.schema[ids].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for batch in batches:
            for part in _slices(batch, place):
                column = part.column(place).to_pylist()
                if is_packed:
                    column = [np.frombuffer(i, "<u4").tolist() if i else [] for i in column]
                back = pa.array([encoder.decode_bytes(i) if i else b"" for i in column], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, back], [*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))
