"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Every example is a vector (tokens, one segment, loss-bearing tokens); a sequence is a bin with a limit in each
dimension. The bin is filled by the dot-product heuristic: of the waiting examples that fit, the one whose
vector has the largest product with what is left of the bin, each dimension scaled by its limit. When none
fits whole and cutting is allowed, the longest waiting example is cut to fill the bin. A bin that still is not
full is cut into runs of a power of two tokens, which need no padding.

Packing happens where the texts are read: a task packs its rows in windows of ``WINDOW`` waiting examples and
closes what is left at its end, so nothing is shuffled, memory is bounded and a task leaves at most one bin
unfilled. A sequence id holds the task's number and the sequence's number in it.

The loss-bearing tokens of an example are its last ``n_loss`` ones (an answer after its prompt); of a document,
all. Null texts count as empty: one token, the end id. Repeated rows are packed each. A null doc_id stays null.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.words import pieces

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 256, 2048
WINDOW = 512
END_ID = 1
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PACKED.split(", ")])


class Encoder:
    """Ids of the byte-level BPE in ``json_path``. Special tokens' strings in a text are ordinary text.

    ``ranks_path`` holds the same vocabulary for the faster library; texts that one refuses go to the other.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        self.json_path, self.slow, self.fast = json_path, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except (ValueError, RuntimeError, UnicodeError):
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Bins:
    """Packs examples as they come. ``done`` gathers (key, start, stop, sequence, offset, loss) of the pieces."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool, window: int = WINDOW):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.cut, self.window = cut, window
        self.waiting: list[list] = []  # [key, start, stop, first loss-bearing position]
        self.sequence = 0
        self.done: list[tuple] = []

    def add(self, key, n: int, n_loss: int) -> None:
        tokens, _, loss = self.limits
        first, at = n - n_loss, 0
        while n - at > tokens or max(0, n - max(at, first)) > loss:
            stop = self._stop(at, n, first, int(tokens), int(loss))
            if (stop - at) & (stop - at - 1) and stop - at < tokens:
                break  # the loss limit cuts first: let the bin be filled by others
            self._emit([(key, at, stop, first)])
            at = stop
        while at < n:
            stop = self._stop(at, n, first, int(tokens), int(loss))
            self.waiting.append([key, at, stop, first])
            at = stop
        if len(self.waiting) >= self.window:
            self._pack(keep=self.window // 2)

    @staticmethod
    def _stop(at: int, n: int, first: int, tokens: int, loss: int) -> int:
        """The farthest end of a piece from ``at`` within the limits."""
        return min(n, at + tokens, max(at, first) + loss)

    def finish(self) -> None:
        self._pack(keep=0)

    def _pack(self, keep: int) -> None:
        items = self.waiting
        size = np.array([[s[2] - s[1], 1, max(0, s[2] - max(s[1], s[3]))] for s in items], float).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        while alive.sum() > keep:
            left, bin_ = self.limits.copy(), []
            while left[1] > 0 and left[0] > 0 and alive.any():
                fits = alive & (size <= left).all(1)
                i = -1
                if fits.any():
                    i = int(np.where(fits, size @ (left / self.limits**2), -1).argmax())
                    last = left[1] == 1 and size[i, 0] < left[0]
                    if last and self.cut and (alive & (size[:, 0] > left[0])).any():
                        i = -1  # the last segment: cut one that fills the bin instead
                if i >= 0:
                    bin_.append(tuple(items[i]))
                    left -= size[i]
                    alive[i] = False
                    continue
                if not self.cut:
                    break
                i = int(np.where(alive, size[:, 0], -1).argmax())
                key, at, stop, first = items[i]
                to = self._stop(at, stop, first, int(left[0]), int(left[2]))
                if to == at:
                    break
                bin_.append((key, at, to, first))
                left -= (to - at, 1, max(0, to - max(at, first)))
                items[i][1] = to
                size[i] = (stop - to, 1, max(0, stop - max(to, first)))
                alive[i] = to < stop
            self._close(bin_, int(left[0]))
        self.waiting = [x for x, a in zip(items, alive, strict=True) if a]

    def _close(self, bin_: list[tuple], left: int) -> None:
        if not self.cut or not left:
            self._emit(bin_)
            return
        total = sum(stop - at for _, at, stop, _ in bin_)
        queue = [list(x) for x in bin_][::-1]
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            room, run = 1 << bit, []
            while room:
                key, at, stop, first = queue[-1]
                to = min(stop, at + room)
                run.append((key, at, to, first))
                room -= to - at
                if to == stop:
                    queue.pop()
                else:
                    queue[-1][1] = to
            self._emit(run)

    def _emit(self, bin_: list[tuple]) -> None:
        offset = 0
        for key, at, stop, first in bin_:
            self.done.append((key, at, stop, self.sequence, offset, max(0, stop - max(at, first))))
            offset += stop - at
        self.sequence += 1


def _packer(json_path, ranks_path, pattern, end_id, max_tokens, max_segments, max_loss, cut):
    def run(batches):
        encode = Encoder(json_path, ranks_path, pattern)
        task = TaskContext.get().partitionId() << 40
        bins = Bins(max_tokens, max_segments, max_loss, cut)
        held: dict[int, tuple] = {}
        number = 0

        def rows():
            out = []
            for key, at, stop, sequence, offset, loss in bins.done:
                doc_id, ids = held[key]
                out.append((doc_id, at, stop - at, zlib.crc32(ids[at:stop].tobytes()), len(ids), task + sequence, offset, loss))
            bins.done = []
            live = {x[0] for x in bins.waiting}
            for key in [k for k in held if k not in live]:
                del held[key]
            columns = zip(*out, strict=True) if out else [[] for _ in _SCHEMA]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

        for batch in pieces(batches, "text"):
            names = batch.schema.names
            losses = batch.column("n_loss").to_pylist() if "n_loss" in names else [None] * batch.num_rows
            for doc_id, text, loss in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), losses, strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                held[number] = (doc_id, ids)
                bins.add(number, len(ids), len(ids) if loss is None else min(loss, len(ids)))
                number += 1
                if len(bins.done) >= 4096:
                    yield rows()
        bins.finish()
        yield rows()

    return run


def pack(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = END_ID, max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, cut: bool = True, doc_id: str = "doc_id", text: str = "text", n_loss: str | None = None,
) -> DataFrame:
    """One row per piece of a document: where it was cut and where it lies.

    ``n_loss`` names the column with an example's number of loss-bearing tokens at its end. Without ``cut``
    an example is cut only where it exceeds a limit by itself, and unfilled sequences stay as they are.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    columns += [F.col(n_loss).cast("long").alias("n_loss")] if n_loss else []
    run = _packer(json_path, ranks_path, pattern, end_id, max_tokens, max_segments, max_loss, cut)
    return docs.select(*columns).mapInArrow(run, PACKED)
