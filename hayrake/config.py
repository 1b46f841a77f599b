"""Constants of the retrieval model, together, so that a plan can be parameterised."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    seed: int = 260926
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    word_cap: int = 240_000
    gram_cap: int = 220_000
    body_chars: int = 4000
    filter_chars: int = 1800
    pool_size: int = 500
    answer_size: int = 50
    rrf: int = 60
    geo_floor: float = 0.03
    class_floor: float = 0.2
    geo_weight: float = 0.7
    geo_km: float = 40.0
    earth_km: float = 6371.0
    transition_support: int = 20
    neighbours: int = 20
    neighbour_least: float = 0.2
    temperature: float = 0.05
    folds: int = 3
    bins: tuple = (15, 25)


CONFIG = Config()
