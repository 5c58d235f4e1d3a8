"""Texts to token ids and back under a byte-level vocabulary of ranks, with the tiktoken library.

*Ranks.* The driver reads the rank file (some megabytes, whatever the corpus) and sends its bytes along, so executors need
no copy; each Python worker builds the encoder once. There are no special tokens: their strings are ordinary text.

*Splitting.* The pattern cuts a text into matches, and each match is merged by itself. A long text is first cut into
blocks at places that every left-to-right search with the pattern has to stop at, so the blocks' ids, joined, are those of
the whole text, and the encoder never holds more than about a block. Such a place follows
- a letter, before anything but a letter,
- a digit or other number, before anything but a number,
- another sign, before white space or a number.
No match reaches across it, as a class ends there and only a leading space or the contractions join classes; and the text
before it doesn't end in white space, so the one look-ahead of the pattern sees what it sees in the whole text. A stretch
of one class, or of white space, has no such place and goes to the encoder whole, as one match would anyway.

*Decoding* joins the bytes of the tokens; bytes needn't be valid UTF-8 before they are joined.

Cases: null text is empty and has no tokens; null ids decode to no bytes. Bytes that aren't UTF-8 are replaced by U+FFFD
before they are encoded. A token id outside the vocabulary is an error. Rows and other columns pass through, repeated rows
too; a column named like a result column is an error. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame

BLOCK_CHARS = 1 << 16

_STOPS = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])")
_ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}  # one or two for the life of a worker


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Ranks by token bytes, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def encoder(data: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, built once in a process."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return _ENCODERS[key]


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """``text`` in blocks of about ``size`` characters, cut only where every match of the pattern ends."""
    at = 0
    while len(text) - at > size:
        stop = _STOPS.search(text, at + size)
        if stop is None:
            break
        yield text[at : stop.start()]
        at = stop.start()
    yield text[at:]


def encode(encoding: tiktoken.Encoding, text: str, size: int = BLOCK_CHARS) -> bytes:
    """Ids of a text as unsigned 32-bit integers, least byte first."""
    ids = (np.asarray(encoding.encode_ordinary(block), "<u4").tobytes() for block in blocks(text, size))
    return b"".join(ids)


def decode(encoding: tiktoken.Encoding, packed: bytes, size: int = BLOCK_CHARS) -> bytes:
    """The bytes of packed ids."""
    ids = np.frombuffer(packed, "<u4")
    return b"".join(encoding.decode_bytes(ids[i : i + size].tolist()) for i in range(0, len(ids), size))


def _sent(df: DataFrame, ranks_path: str) -> Broadcast:
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str) -> DataFrame:
    """The rows of ``df`` through ``run``, which adds the columns ``more``. Columns travel by place: names may hold dots."""
    names, added = df.columns, [part.split()[0] for part in more.split(", ")]
    clash = {c.lower() for c in names} & set(added)
    if clash:
        raise ValueError(f"there is a column {', '.join(sorted(clash))} already")
    kinds = [f"c{i} {kind}" for i, (_, kind) in enumerate(df.dtypes)]
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, ", ".join([*kinds, more])).toDF(*names, *added)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``tokens``: the ids of every text as unsigned 32-bit integers, least byte first."""
    sent, place = _sent(docs, ranks_path), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(sent.value, pattern)
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            tokens = [encode(encoding, str(t.as_py() or b"", "utf-8", "replace"), block_chars) for t in texts]
            sizes = pa.array([len(t) // 4 for t in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, pa.array(tokens, pa.binary())], [*batch.schema.names, "n_tokens", "tokens"])

    return _mapped(docs, run, "n_tokens bigint, tokens binary")


def decoded(rows: DataFrame, ranks_path: str, pattern: str, tokens_col: str = "tokens") -> DataFrame:
    """``rows`` with ``decoded``: the bytes that the packed ids of ``tokens_col`` stand for."""
    sent, place = _sent(rows, ranks_path), rows.columns.index(tokens_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(sent.value, pattern)
        for batch in batches:
            found = [decode(encoding, t.as_py() or b"") for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return _mapped(rows, run, "decoded binary")
