"""The whole grid of rating parameters in one pass over the contests a round: the candidates are the axis of a vector.

A rating needs the days before it, a candidate needs no other candidate. So the contests of a league are packed into
blocks of whole days in time order, and each group of ``width`` candidates walks a league's blocks from the first to the
last, holding one block and the ratings of the league's sides. Ratings are exact and never leave the task: what is
shuffled is the contests once to their blocks and the packed blocks once for each group of candidates.

Losses come from logistic fits in (rating difference / 100, home difference) for every candidate and validation
season: one Newton round of all of them is one walk that leaves a row of sums a league and group. Walking again costs less
than keeping a number for each contest and candidate. Fits that have settled stay as they are. The driver holds numbers of
the grid only.

Contests without a result get no update and are not scored; a null margin counts as none. An empty table is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.text import orientation_flip
from contestry.operators.elo import EloParams, games_before, season_index
from contestry.session import Stage

WIDTH = 40  # candidates that walk together
BLOCK = 1 << 16  # contests in a block, a day at least
SLICE = 2048  # contests whose vectors are worked at once
PACKED = "league {league}, block long, rows binary"
SUMS = "part int, sums binary"


def contests(m: DataFrame, params: Sequence[EloParams], seed: int = 42) -> DataFrame:
    """One row per contest with every part of an update that neither the ratings nor the candidates touch."""
    g = m.join(season_index(m), ["league", "season_year"])
    if any(p.early_season_k_boost for p in params):
        n = games_before(m)
        for i in (1, 2):
            g = g.join(n.selectExpr("league", "season_year", "day", f"team AS team{i}", f"played AS played{i}"), ["league", "season_year", "day", f"team{i}"])
    else:
        g = g.selectExpr("*", "7 AS played1", "7 AS played2")
    flip = orientation_flip(seed, F.col("date_raw"), F.col("team1"), F.col("team2"))
    return g.withColumn("flip", flip).selectExpr(
        "match_id", "league", "day", "season_year", "CAST(sidx AS int) AS sidx", "team1", "team2", "flip", "is_decided",
        "CAST(CAST(team1_home AS int) - CAST(team2_home AS int) AS double) AS home", "is_decided OR result_type = 'tie' AS rated",
        "CASE WHEN result_type = 'tie' THEN 0.5D WHEN winner = team1 THEN 1D ELSE 0D END AS score",
        "CAST(played1 AS double) AS played1", "CAST(played2 AS double) AS played2",
        """CAST(coalesce(CASE WHEN is_decided AND NOT coalesce(dls_flag, false) THEN
             CASE margin_type WHEN 'runs' THEN margin_value / 10D WHEN 'wickets' THEN margin_value / 2D END END, 0D) AS double) AS units""",
    )


def _columns(params: Sequence[EloParams]) -> dict[str, np.ndarray]:
    return {k: np.array([float(asdict(p)[k]) for p in params]) for k in asdict(params[0])}


def _packer(table: pa.Table) -> pa.Table:
    """A block's contests by day, compressed, as one row."""
    sink, rows = pa.BufferOutputStream(), table.drop_columns(["block"]).sort_by([("day", "ascending"), ("match_id", "ascending")])
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return pa.table([table.column("league").slice(0, 1), table.column("block").slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["league", "block", "rows"])


def packed(games: DataFrame, block: int = BLOCK) -> DataFrame:
    """(league, block, rows): a league's contests in blocks of whole days, numbered in time order."""
    before = F.sum("n").over(Window.partitionBy("league").orderBy("day")) - F.col("n")  # a row a league and day
    days = games.groupBy("league", "day").agg(F.count(F.lit(1)).alias("n")).select("league", "day", F.floor(before / block).alias("block"))
    kind = games.schema["league"].dataType.simpleString()
    return games.join(days, ["league", "day"]).groupBy("league", "block").applyInArrow(_packer, PACKED.format(league=kind))


def _update(p: dict[str, np.ndarray], get, gap: np.ndarray) -> np.ndarray:
    """(contests, candidates): what side 1 gains, ``gap`` being its rating less that of side 2."""
    score, units = get("score")[:, None], get("units")[:, None]
    expected = 1 / (1 + 10 ** (-(gap + p["home_bonus"] * get("home")[:, None]) / p["scale"]))
    lead = np.where(score == 1, gap, -gap)
    margin = np.where((p["use_margin"] > 0) & (units > 0), np.log(np.maximum(units, 0) + 1) * 2.2 / (0.001 * lead + 2.2), 1.0)
    boost = sum(1 + p["early_season_k_boost"] * np.maximum(0, 1 - get(f"played{i}")[:, None] / 7) for i in (1, 2)) / 2
    return np.where(get("rated")[:, None], p["k"] * boost * margin * (score - expected), 0.0)


class _League:
    """How far a league's sides are from the mean, for a group of candidates, as its days pass."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.decay = p, 1 - p["season_regression"]
        self.place: dict = {}
        self.away, self.season = np.zeros((0, len(self.decay))), np.zeros(0, np.int64)

    def _places(self, teams: np.ndarray) -> np.ndarray:
        known, which = np.unique(teams, return_inverse=True)
        at = np.array([self.place.setdefault(t, len(self.place)) for t in known.tolist()], np.int64)
        new = len(self.place) - len(self.season)
        self.away = np.concatenate([self.away, np.zeros((new, len(self.decay)))])
        self.season = np.concatenate([self.season, np.full(new, -1)])
        return at[which]

    def gaps(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """(contests, candidates): the rating of side 1 less that of side 2 before the day; the block's updates are made."""
        n = len(rows["day"])
        sides = self._places(np.concatenate([rows["team1"], rows["team2"]])).reshape(2, n)
        out = np.empty((n, len(self.decay)))
        edges = np.flatnonzero(np.diff(rows["day"], prepend=rows["day"][0] - 1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n], strict=True):
            both = sides[:, a:b].ravel()
            order = np.argsort(both, kind="stable")
            met, first = np.unique(both[order], return_index=True)
            season = rows["sidx"][a]
            turned = met[(self.season[met] >= 0) & (self.season[met] != season)]
            self.away[turned] *= self.decay ** (season - self.season[turned])[:, None]
            self.season[met] = season
            moves = np.empty((2, b - a, len(self.decay)))
            for i in range(a, b, SLICE):
                j = min(b, i + SLICE)
                out[i:j] = self.away[sides[0, i:j]] - self.away[sides[1, i:j]]
                moves[0, i - a : j - a] = _update(self.p, lambda c: rows[c][i:j], out[i:j])  # noqa: B023
            moves[1] = -moves[0]
            self.away[met] += np.add.reduceat(moves.reshape(2 * (b - a), -1)[order], first, axis=0)
        return out


def _add_sums(total: np.ndarray, rows: dict[str, np.ndarray], gaps: np.ndarray, folds: np.ndarray, beta: np.ndarray, losses: bool) -> None:
    """A block's share of Newton's five sums for every (fold, candidate), or of the losses and rows of each validation season."""
    turn = np.where(rows["flip"], -1.0, 1.0)
    won = rows["score"] == 1
    y, x2 = np.where(rows["flip"], ~won, won).astype(float), rows["home"] * turn
    for season in np.unique(rows["season_year"][rows["is_decided"]]):
        which = np.flatnonzero(folds == season if losses else folds > season)
        use = np.flatnonzero(rows["is_decided"] & (rows["season_year"] == season))
        for at in range(0, len(use) if len(which) else 0, SLICE):
            part = use[at : at + SLICE]
            u1, u2, t = gaps[part] * (turn[part] / 100)[:, None], x2[part][:, None], y[part][:, None]
            for i in which:
                q = 1 / (1 + np.exp(-(beta[i, 0] * u1 + beta[i, 1] * u2)))
                if losses:
                    q = np.clip(q, 1e-15, 1 - 1e-15)
                    total[i] += np.stack([-(t * np.log(q) + (1 - t) * np.log(1 - q)).sum(0), np.full(u1.shape[1], float(len(part)))])
                else:
                    r, v = q - t, q * (1 - q)
                    vu = v * u1
                    total[i] += np.stack([(r * u1).sum(0), (r * u2).sum(0), (vu * u1).sum(0), (vu * u2).sum(0), (v * (u2 * u2)).sum(0)])


def _walker(params: dict[str, np.ndarray], folds: np.ndarray, beta: np.ndarray, losses: bool, width: int):
    """Walks the blocks that arrive by (part, league, block); a row of sums leaves for every part and league."""

    def run(batches):
        at = league = total = None

        def sums():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        for batch in batches:
            for part, name, data in zip(*(batch.column(c) for c in ("part", "league", "rows")), strict=True):
                if at != (part.as_py(), name.as_py()):
                    if at is not None:
                        yield sums()
                    at = (part.as_py(), name.as_py())
                    own = slice(at[0] * width, (at[0] + 1) * width)
                    league = _League({k: v[own] for k, v in params.items()})
                    total = np.zeros((len(folds), 2 if losses else 5, len(league.decay)))
                table = pa.ipc.open_stream(data.as_buffer()).read_all()
                rows = {c: table.column(c).to_numpy() for c in table.schema.names if c != "league"}
                _add_sums(total, rows, league.gaps(rows), folds, beta[:, :, own], losses)
        if at is not None:
            yield sums()

    return run


def _collected(blocks: DataFrame, params: dict[str, np.ndarray], folds: np.ndarray, beta: np.ndarray, losses: bool, width: int) -> np.ndarray:
    """The sums over all leagues, added on executors: a row a group of candidates comes back."""

    def add(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("sums").to_pylist())  # the order of arrival must not matter
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([sum(map(np.frombuffer, parts)).tobytes()], pa.binary())})

    walked = blocks.mapInArrow(_walker(params, folds, beta, losses, width), SUMS)
    rows = sorted((r.part, r.sums) for r in walked.groupBy("part").applyInArrow(add, SUMS).collect())
    return np.concatenate([np.frombuffer(x).reshape(len(folds), 2 if losses else 5, -1) for _, x in rows], 2)


def search(m: DataFrame, params: Sequence[EloParams], folds: Sequence[int], seed: int = 42, C: float = 1.0, width: int = WIDTH, block: int = BLOCK) -> np.ndarray:
    """(candidates, folds): the loss of each validation season under a fit on the seasons before it."""
    spark, p = m.sparkSession, _columns(params)
    blocks = Stage(spark, "rating-search").write(packed(contests(m, params, seed), block), "blocks")
    n, folds, beta = len(params), np.array(sorted(folds)), np.zeros((len(folds), 2, len(params)))
    parts = -(-n // width)
    walks = parts * blocks.select("league").distinct().count()
    each = blocks.select("league", "block", "rows", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # Kept as sorted, so that every round reads it where it lies; four times as many tasks as walks hold few walks each.
    each = each.repartition(4 * walks, "league", "part").sortWithinPartitions("part", "league", "block").persist(StorageLevel.DISK_ONLY)
    try:
        for _ in range(50):
            g1, g2, a, b, c = np.moveaxis(_collected(each, p, folds, beta, False, width), 1, 0)
            g1, g2, a, c = g1 + beta[:, 0] / C, g2 + beta[:, 1] / C, a + 1 / C, c + 1 / C
            det = a * c - b * b
            step = np.stack([(c * g1 - b * g2) / det, (a * g2 - b * g1) / det], 1)
            beta = beta - step
            if np.abs(step).max(initial=0) <= 1e-10:
                break
        else:
            raise RuntimeError("Newton rounds did not settle")
        lost, count = np.moveaxis(_collected(each, p, folds, beta, True, width), 1, 0)
    finally:
        each.unpersist()
    if not count.all():
        raise ValueError("a validation season has no decided contests")
    return (lost / count).T
