"""Settings of a full run."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RunSettings:
    run_id: str = "run"
    levels: int = 10
    level_high: int = -1  # -1: the hottest of the ladder
    level_low: int = 0
    t_low: float = 1.0
    t_high: float = 1000.0
    thin: int = 1
    sweeps_per_draw: int = 100
    draws: int = 50_000
    burn_in: int = 5_000
    covariance_draws: int = 5_000
    p_no_jump: float = 0.3
    period: int = 20
    max_period: int = 320
    start_share: float = 0.20
    pool_capacity: int = 10_000
    groups: int = 8
    chains: int = 64
    hill_climbs: int = 0
    tuning_done: int = 0
    save_space: int = 0
    seed: int = 1

    @property
    def top(self) -> int:
        return self.levels - 1 if self.level_high < 0 else self.level_high


# Command-line spellings accepted for each setting.
FLAGS = {
    "run_id": ["--RunID"], "levels": ["--nLevel"], "level_high": ["--lHigh"], "level_low": ["--lLow"],
    "t_low": ["--T0"], "t_high": ["--TK"], "thin": ["--thin"], "sweeps_per_draw": ["--THIN"],
    "draws": ["--ndraws"], "burn_in": ["--nburnin", "--burnin"], "groups": ["--nInitial"],
    "hill_climbs": ["--HillClimb"], "tuning_done": ["--TuningDone"], "period": ["--pr"], "max_period": ["--mpr"],
    "p_no_jump": ["--pee"], "chains": ["--chains"], "seed": ["--seed"],
}


def parse_settings(argv: list[str]) -> RunSettings:
    parser = argparse.ArgumentParser()
    kinds = {f.name: type(f.default) for f in fields(RunSettings)}
    for name, flags in FLAGS.items():
        parser.add_argument(*flags, dest=name, type=kinds[name], default=argparse.SUPPRESS)
    given = vars(parser.parse_args(argv))
    if "period" in given and "max_period" not in given:
        given["max_period"] = 16 * given["period"]
    return RunSettings(**given)
