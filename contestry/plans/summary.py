"""Headline analytics of a canonical table, each section a lazy DataFrame over the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contestry.operators import records as R
from contestry.operators import trends as T


def analytics_summary(m: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    toss, chase, home = R.toss_effect(m), R.chasing_advantage(m), R.home_advantage(m)
    return {
        "kpis": R.kpis(m), "team_table": R.team_table(m), "season_win_pct": R.season_win_pct(m), "head_to_head": R.head_to_head(m),
        **{f"toss_{k}": v for k, v in toss.items()}, **{f"chasing_{k}": v for k, v in chase.items()},
        **{f"home_{k}": v for k, v in home.items()}, "toss_by_venue": R.toss_by_venue(m), "field_first": R.field_first_share(m),
        "venues": R.venue_profiles(m), "scoring": T.scoring_by_season(m), "era_scoring": T.era_scoring_test(m),
        "margins": T.margin_summary(m), "closest": T.closest_finishes(m), "awards": T.potm_leaderboard(m, players),
        "appearances": T.appearances(players, m), "continuity": T.squad_continuity(players, m), "officials": T.officials_table(m),
    }
