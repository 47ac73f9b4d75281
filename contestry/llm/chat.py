r"""Chat formatting in budgeted windows.

A turn's tokens are summed in turn order; a turn belongs to the window in whose stride of half the budget its
first token falls, so spans start and end at turns and a window needs only its own rows. Each window repeats
the conversation's opening system turn, then the last turns before the window as far as ``history`` tokens and
the budget reach, then its own turns. Only the window's own assistant texts bear loss; everything repeated is
masked. A window stays within the budget as long as no turn is longer than half of it less the system turn.

The prefix sums are taken by parts: turns are range-partitioned by (conversation, turn), summed inside a part,
and a conversation that spans parts gets the sums of the parts before. One conversation with a third of all
rows is so spread over many tasks.

A turn is ``<|im_start|>role\n text<|im_end|>\n``. Inside roles and texts every ``\``, ``<`` and ``[`` is
followed by a ``\``, so no control string of the usual templates can occur, and dropping them restores the text.

Null texts and roles count as empty; turns in the same place follow each other by role, then text; repeated rows
are turns of their own. A null conv_id is a conversation, null turns come first. A system turn elsewhere than at the opening
is an ordinary turn. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.session import Stage

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 512, 96
_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"([\\<\[])\\")
#: Letters of a text counted as one token.
LETTERS = 4


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_tokens(text: Column) -> Column:
    """An estimate that needs no tokenizer: a turn's marks and a token for every four letters."""
    return (F.ceil(F.char_length(text) / F.lit(float(LETTERS))) + 4).cast("long")


def _assembled(batches):
    """Windows from their turns: the formatted text and the spans under the loss mask, in code points."""
    for batch in batches:
        out = []
        for conv, window, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "turns")), strict=True):
            parts, spans, at, repeated = [], [], 0, 0
            for t in turns:
                head = f"{START}{escape(t['role'])}\n"
                body = escape(t["text"])
                if t["own"] and t["role"] == "assistant":
                    spans.append((at + len(head), at + len(head) + len(body)))
                repeated += not t["own"]
                parts += (head, body, END)
                at += len(head) + len(body) + len(END)
            out.append((conv, window, "".join(parts), repeated, [s for s, _ in spans], [e for _, e in spans], sum(t["tokens"] for t in turns)))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in _WINDOW]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _WINDOW.types, strict=True)], schema=_WINDOW)


_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("n_repeated", pa.int64()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())), ("n_tokens", pa.int64())])
WINDOWS = "conv_id long, window long, formatted string, n_repeated long, loss_starts array<long>, loss_ends array<long>, n_tokens long"


def format_windows(
    spark: SparkSession, turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss_starts, loss_ends, n_tokens), windows numbered in order."""
    stride = budget // 2
    stage = Stage(spark, "chat")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "conv_id", "turn", "role", F.xxhash64("text")).withColumns({"part": F.spark_partition_id(), "tokens": turn_tokens(F.col("text"))})
    rows = stage.write(rows, "turns")
    # At most one conversation spans each border of two parts, so this table has no more rows than there are parts.
    sums = rows.groupBy("conv_id", "part").agg(F.sum("tokens").alias("s"), F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.sum("s").over(earlier).alias("_s"), F.sum("c").over(earlier).alias("_c")).where("_c > 0")
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", F.xxhash64("text"), "text")
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long"), "stop": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(F.broadcast(sums), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    rows = rows.withColumns({"pos": F.col("pos") + F.coalesce("_c", F.lit(0)), "stop": F.col("stop") + F.coalesce("_s", F.lit(0))})
    opening = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumns({"opening": opening, "start": F.col("stop") - F.col("tokens")})
    rows = stage.write(rows.withColumn("window", F.floor(F.col("start") / F.lit(stride)).cast("long")).drop("part", "_conv", "_part", "_s", "_c", "turn"), "placed")

    own = rows.groupBy("conv_id", "window").agg(F.min("start").alias("w_start"), F.sum("tokens").alias("w_tokens"))
    own = stage.write(own, "windows")
    later = own.where("window > 0").select(F.col("conv_id").alias("_conv"), F.col("window").alias("_w"), "w_start", "w_tokens")
    system = rows.where("opening").select(F.col("conv_id").alias("_sys_conv"), F.col("tokens").alias("sys_tokens"), F.col("text").alias("sys_text"))
    later = later.join(system, F.col("_conv").eqNullSafe(F.col("_sys_conv")), "left").drop("_sys_conv")
    later = stage.write(later.withColumn("room", F.least(F.lit(history), F.lit(budget) - F.col("w_tokens") - F.coalesce("sys_tokens", F.lit(0)))), "later")

    entry = lambda own_, pos, role_, text_, tokens: F.struct(pos.alias("pos"), F.lit(own_).alias("own"), role_.alias("role"), text_.alias("text"), tokens.alias("tokens"))
    entries = [rows.select("conv_id", "window", entry(True, F.col("pos"), F.col("role"), F.col("text"), F.col("tokens")).alias("e"))]
    # A history turn stands in the window before: what starts earlier is out of reach.
    past = rows.where(~F.col("opening") & (F.col("start") >= (F.col("window") + 1) * stride - history)).withColumn("_next", F.col("window") + 1)
    past = past.join(later, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_next") == F.col("_w"))).where(F.col("start") >= F.col("w_start") - F.col("room"))
    entries.append(past.select("conv_id", F.col("_next").alias("window"), entry(False, F.col("pos"), F.col("role"), F.col("text"), F.col("tokens")).alias("e")))
    repeated = later.where("sys_text IS NOT NULL")
    entries.append(repeated.select(F.col("_conv").alias("conv_id"), F.col("_w").alias("window"), entry(False, F.lit(0).cast("long"), F.lit("system"), F.col("sys_text"), F.col("sys_tokens")).alias("e")))
    everything = entries[0].unionByName(entries[1]).unionByName(entries[2])
    grouped = everything.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("e")).alias("turns"))
    return grouped.mapInArrow(_assembled, WINDOWS)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out = []
    for part in formatted.split(START)[1:]:
        head, body = part[: -len(END)].split("\n", 1)
        out.append((unescape(head), unescape(body)))
    return out


def _read(batches):
    """Each window's own turns and its text under the loss mask, from the formatted text."""
    for batch in batches:
        out = []
        for conv, window, formatted, repeated, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "formatted", "n_repeated", "loss_starts", "loss_ends")), strict=True):
            own = read_back(formatted)[repeated:]
            loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
            out.append((conv, window, len(own), "".join(f"{r}\n{t}\n" for r, t in own), loss, len(formatted)))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in _TURNS]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TURNS.types, strict=True)], schema=_TURNS)


_TURNS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digests(batches):
    """A row for each conversation of a partition sorted by (conv_id, window); holds one window at a time."""
    out, now, state = [], None, None

    def close():
        if state is not None:
            n, turns, chars, loss, formatted, windows = state
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows))

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _DIGEST]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DIGEST.types, strict=True)], schema=_DIGEST)

    for batch in batches:
        for conv, n, turns, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "turns", "loss", "chars")), strict=True):
            if state is None or conv != now:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            state[0] += n
            state[1].update(turns.encode("utf-8", "surrogatepass"))
            state[2] += len(loss)
            state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += chars
            state[5] += 1
        if len(out) >= 4096:
            yield batch_of(out)
            out.clear()
    close()
    yield batch_of(out)


def digests(spark: SparkSession, windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted windows.

    A digest over a whole conversation is a sequential thing: its windows stream through one task, sorted.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = windows.mapInArrow(_read, "conv_id long, window long, n long, turns string, loss string, chars long")
    return own.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_digests, DIGEST)
