"""Settings of retrieval and chunking, with overrides from the environment or a ``.env`` file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Fixed values of the data model's operators; any field can be overridden."""

    topk_per_mode: int = 30
    top_n: int = 10
    rrf_k: int = 60
    weight_keyword: float = 1.0
    weight_fallback: float = 0.5
    weight_semantic: float = 1.0
    fallback_candidates: int = 300
    fallback_rank_constant: int = 10
    fallback_min_word: int = 3
    overfetch: int = 8
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_idf_floor: float = 1e-6
    bm25_title: float = 3.0
    bm25_body: float = 1.0
    chunk_target: int = 900
    chunk_overlap: int = 150
    chunk_max: int = 1600
    min_chunk: int = 120
    drop_shorter_than: int = 40
    front_seq: int = 8
    toc_line_ratio: float = 0.6
    miner_min_len: int = 3
    miner_min_count: int = 3
    h2_delta: float = 2.5
    h3_delta: float = 1.0
    heading_max_len: int = 70
    repeated_ratio: float = 0.4
    repeated_floor: int = 3
    repeated_max_len: int = 40
    context_budget: int = 3000
    gate_min_coverage: float = 0.8


def env_file(path: str) -> dict[str, str]:
    """``key=value`` lines of a file; ``#`` starts a comment line, the first ``=`` splits; a missing file is empty."""
    try:
        with open(path, encoding="utf-8") as lines:
            pairs = [line.strip().partition("=") for line in lines if "=" in line and not line.lstrip().startswith("#")]
    except FileNotFoundError:
        return {}
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def settings(path: str = ".env") -> Settings:
    """Defaults, overridden by a file, overridden by the environment (names in capitals)."""
    given = env_file(path) | dict(os.environ)
    found = {f.name: type(getattr(Settings, f.name))(given[f.name.upper()]) for f in fields(Settings) if f.name.upper() in given}
    return Settings(**found)
