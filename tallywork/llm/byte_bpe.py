"""Byte-level BPE by a local rank file: encoding of whole texts and decoding to raw bytes."""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import page_texts

register_pickle_by_value(sys.modules[__name__])

#: Length from which a text is cut before encoding. A cut never changes the ids.
LONG_TEXT = 1 << 16
ROWS_AT_ONCE = 128

# Places where every match of the pattern ends, whatever stands further left or right: before white space after
# something else, and between ASCII letters, digits and signs. Python's \s holds all that the pattern calls white
# space. A space belongs to what follows it, and an apostrophe may start a contraction, so neither is cut after.
SAFE_CUT = re.compile(
    r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])"
    r"|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])|(?<=')(?=[0-9])")

#: White space as the pattern has it, in runs that its backtracking can't be trusted with.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_TEXT)


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters or a little more, cut at the next safe place.

    A stretch without a safe place stays in one piece.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def load_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def encode_text(encoding, text: str) -> list[int]:
    """The ids of the whole text. Of a very long run of white space the pattern makes one match, less its last character if
    something else follows; that match is encoded as its bytes, and the text before and after it apart."""
    if len(text) <= LONG_TEXT:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += [i for piece in safe_pieces(text[at:run.start()]) for i in encoding.encode_ordinary(piece)]
        ids += encoding._encode_single_piece(text[run.start():end].encode())
        at = end
    return ids + [i for piece in safe_pieces(text[at:]) for i in encoding.encode_ordinary(piece)]


def _with_column(df: DataFrame, name: str, source: str, ranks: str, pattern: str, convert, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and the binary column ``name``, made from ``source`` ROWS_AT_ONCE rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            encoding = encoding or load_encoding(ranks, pattern)
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                made = pa.array([convert(encoding, value) for value in some.column(source).to_pylist()], pa.binary())
                yield pa.record_batch([*(some.column(c) for c in keep), made], names=[*keep, name])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.BinaryType())])
    return df.select(*dict.fromkeys([*keep, source])).mapInArrow(run, schema)


def _ids(encoding, text: str) -> bytes:
    return np.array(encode_text(encoding, text), "<u4").tobytes()


def _bytes(encoding, ids: bytes | None) -> bytes:
    return encoding.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist())


def encode_pages(pages: DataFrame, ranks: str, pattern: str, *keep: str) -> DataFrame:
    """(page_id, the columns ``keep``, ids, n_tokens) for each row of ``pages(page_id, html)``.

    ``ranks`` is the path of the rank file, the same on every worker; ``pattern`` splits the text before merging.
    Special tokens are not known: their strings are ordinary text. ``ids`` holds little-endian unsigned 32-bit
    integers. Missing and empty texts have no ids, repeated rows repeated ids, an empty table gives an empty one. Very long
    texts are encoded whole, in pieces (:func:`encode_text`). Rows stay where they are: no shuffle; memory is one batch of
    texts and the ids of ROWS_AT_ONCE of them.
    """
    texts = page_texts(pages, *(c for c in keep if c != "html"))
    encoded = _with_column(texts, "ids", "html", ranks, pattern, _ids, ["page_id", *keep])
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_pages(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``: the raw bytes of ``ids``, which need not be valid UTF-8.

    Ids that the rank file doesn't have fail the task. Missing ids give no bytes.
    """
    return _with_column(encoded, "decoded", "ids", ranks, pattern, _bytes, encoded.columns)


def round_trip_pages(pages: DataFrame, ranks: str, pattern: str, *keep: str) -> DataFrame:
    """:func:`encode_pages` with ``decoded``, the bytes that :func:`decode_pages` gives for the ids, in one Python step.

    A task then has one Python process for both, and the ids cross to it once.
    """
    texts = page_texts(pages, *(c for c in keep if c != "html"))
    kept = ["page_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            encoding = encoding or load_encoding(ranks, pattern)
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                ids = [_ids(encoding, text) for text in some.column("html").to_pylist()]
                decoded = pa.array([_bytes(encoding, i) for i in ids], pa.binary())
                yield pa.record_batch([*(some.column(c) for c in kept), pa.array(ids, pa.binary()), decoded], names=[*kept, "ids", "decoded"])

    schema = T.StructType([
        *(texts.schema[c] for c in kept), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    both = texts.select(*dict.fromkeys([*kept, "html"])).mapInArrow(run, schema)
    return both.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
