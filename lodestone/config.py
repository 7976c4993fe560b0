"""Settings from the environment or the session: the session's ``lodestone.<name>`` goes before, then the variable, then the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    max_context_chars: int = 12_000
    candidates_per_list: int = 20
    sibling_neighbors: int = 1
    sibling_limit: int = 30
    rrf_k: int = 60
    enable_reranker: bool = False
    rerank_top_k: int = 5
    news_top_k: int = 4
    news_dense_k: int = 20
    news_max_context_chars: int = 9_000
    news_max_source_chars: int = 2_800
    news_min_score: float = 12.0


def settings(spark: SparkSession | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings; a value that its field's type can't read raises ValueError. Variables are LODESTONE_<NAME>."""
    env = os.environ if env is None else env
    given = {}
    for f in fields(Settings):
        value = (spark.conf.get(f"lodestone.{f.name}", None) if spark else None) or env.get(f"LODESTONE_{f.name.upper()}")
        if value is not None:
            kind = type(f.default)
            given[f.name] = value.strip().lower() == "true" if kind is bool else kind(value)
    return Settings(**given)
