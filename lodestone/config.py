"""Constants that are part of the results, and the one clock value: the year that counts as now."""

from __future__ import annotations

from dataclasses import dataclass

#: Half-life in years of the seventeen business domains.
HALF_LIFE = {
    "1": 4.0, "2": 5.0, "3": 8.0, "4": 6.0, "5": 10.0, "6": 8.0, "7": 6.0, "8": 10.0, "9": 8.0,
    "10": 6.0, "11": 8.0, "12": 18.0, "13": 8.0, "14": 16.0, "15": 8.0, "16": 13.0, "17": 8.0,
}
#: What a title pattern multiplies a work's weight by.
TITLE_FACTORS = {
    "(survey|overview|review|handbook|textbook)": 0.1,
    "(data from:|dataset:|supplementary data)": 0.05,
}
#: Weights of the retrieval paths, and how many candidates of each bucket go on.
PATH_WEIGHTS = {"vector": 2.0, "label": 3.0, "collab": 1.0}
BUCKET_QUOTAS = {"A": 80, "B": 30, "C": 60, "D": 20, "E": 20, "F": 10}


@dataclass(frozen=True)
class Config:
    as_of_year: int = 2001
    recent_years: int = 5
    default_half_life: float = 10.0
    team_least: int = 2
    team_most: int = 99
    pair_least: float = 0.01
    indirect: float = 0.3
    decay: tuple[float, ...] = (1.0, 0.55, 0.30, 0.18, 0.10)
    decay_rest: float = 0.06
    rrf: int = 60
    melt: float = 0.05


DEFAULT = Config()
