"""Byte-level BPE: texts to ids by a local rank file, and ids back to raw bytes.

The library is tiktoken; the ranks and the pattern that splits a text before any merge are parameters. A long
text is cut into chunks first, only where a match of the pattern ends whatever stands around (``Ranks.chunks``),
so chunks encoded one by one give the ids of the whole text and the library sees at most a chunk, or one
longer match, at a time. Long runs of white space, which exhaust the library's pattern engine, are matches
that are known without it, and go to the merges directly. The rules of ``chunks`` hold for patterns in which white space starts
a match or is one, as in those of the public byte-level vocabularies; a text no longer than ``chunk`` is never cut.

Rows are encoded where they are read; nothing is shuffled. A batch holds some ``BATCH`` bytes of text, or one
longer text. Special tokens' strings are ordinary text. A null text counts as empty and has no ids; null ids
decode to no bytes. Rows repeat as they come; a null doc_id stays null; an empty table gives an empty result.
Extra columns are ignored, whatever their names. An id beyond the vocabulary fails loudly when decoded.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.words import pieces

CHUNK = 1 << 16
BATCH = 4 << 20
#: The code points of Unicode's White_Space, which is the pattern's ``\s``.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space longer than this doesn't go through the pattern.
LONG_RUN = 1 << 12
_COLUMNS = "doc_id long, n_tokens long, ids "


class Ranks:
    """Encodes and decodes by the rank file at ``path``; made anew in every task."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, long_run: int = LONG_RUN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunk = chunk
        self.run = re.compile(f"[{WHITE}]{{{long_run},}}")
        # Before white space; between an ASCII letter and a digit; before ASCII punctuation but after other punctuation, where a contraction may stand.
        self.safe = re.compile(f"[^{WHITE}](?=[{WHITE}])|[A-Za-z](?=[0-9!-/:-@\\[-`{{-~])|[0-9](?=[A-Za-z!-/:-@\\[-`{{-~])")

    def chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is one match as a whole). The parts joined are the text, and every cut ends a match."""
        if len(text) <= self.chunk:
            yield text, False
            return
        at = 0
        for run in self.run.finditer(text):
            # The last character of the run belongs to what follows, if anything does.
            stop = run.end() if run.end() == len(text) else run.end() - 1
            yield from self._between(text, at, run.start())
            yield text[run.start() : stop], True
            at = stop
        yield from self._between(text, at, len(text))

    def _between(self, text: str, at: int, stop: int) -> Iterator[tuple[str, bool]]:
        while stop - at > self.chunk:
            cut = self.safe.search(text, at + self.chunk, stop)
            if cut is None or cut.end() >= stop:
                break
            yield text[at : cut.end()], False
            at = cut.end()
        if stop > at:
            yield text[at:stop], False

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.chunk:
            return self._short(text)
        parts = [self._match(part.encode()) if match else self._short(part) for part, match in self.chunks(text)]
        return np.concatenate(parts)

    def _short(self, text: str) -> np.ndarray:
        # No run of a text this short can be too long for the pattern.
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def _match(self, data: bytes) -> np.ndarray:
        return np.array(self.encoding._encode_single_piece(data), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes side by side; they need not be whole code points."""
        return self.encoding.decode_bytes(ids.tolist())

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        return [self.encoding.decode_single_token_bytes(i) for i in range(self.encoding.n_vocab)]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``BATCH`` bytes of a binary column, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(sizes // BATCH)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _encoder(path, pattern, chunk, packed):
    kind = pa.binary() if packed else pa.list_(pa.int32())

    def run(batches):
        ranks = Ranks(path, pattern, chunk)
        for batch in pieces(batches, "text", BATCH):
            ids = [ranks.encode(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() if packed else x.view("<i4") for x in ids], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    return run


def _decoder(path, pattern):
    def run(batches):
        ranks = Ranks(path, pattern)
        for batch in _slices(batches, "ids"):
            texts = [ranks.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "data"])

    return run


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", packed: bool = True, chunk: int = CHUNK
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers side by side, which ``decode`` reads, or an array without ``packed``.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(_encoder(ranks_path, pattern, chunk, packed), _COLUMNS + ("binary" if packed else "array<int>"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` with ``data``, the raw bytes that their ids stand for."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(ranks_path, pattern), _COLUMNS + "binary, data binary")
