"""Run configuration: small values that are settled on the driver before a plan is built."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def proportion(raw) -> list[float]:
    """[train, validation, test] of a list, a dictionary, dictionaries in a list, or a text with commas; not rescaled."""
    if isinstance(raw, str):
        values = [float(x) for x in raw.split(",") if x.strip()]
    elif isinstance(raw, dict):
        values = [float(raw.get(a, raw.get(b, 0)) or 0) for a, b in (("treino", "train"), ("validacao", "validation"), ("teste", "test"))]
    elif raw and isinstance(raw[0], dict):
        return proportion({k: v for d in raw for k, v in d.items()})
    else:
        values = [float(x) for x in raw or []]
    return (values + [0.0, 0.0, 0.0])[:3]


def parse_filter(raw) -> dict | None:
    """A dictionary or a JSON object as text; empty is None; anything else raises."""
    if raw is None or raw == "" or raw == {}:
        return None
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise ValueError("the filter is neither a dictionary nor a JSON object") from e
    if not isinstance(raw, dict):
        raise ValueError("the filter is neither a dictionary nor a JSON object")
    return raw


@dataclass
class Stage:
    """One stage of a curriculum."""

    alias: str
    file: str
    order: int
    pace_epochs: int = 1
    share: list[float] = field(default_factory=lambda: [0.8, 0.1, 0.1])
    filter: dict | None = None


def build_stages(config: list[dict]) -> list[Stage]:
    """Stage records with defaults; aliases must differ."""
    stages = [Stage(c.get("alias") or f"etapa_{i}", c.get("arquivo", ""), i, int(c.get("pace_epochs") or 1), proportion(c["proporcao"]) if c.get("proporcao") else [0.8, 0.1, 0.1], parse_filter(c.get("dataset_filtro"))) for i, c in enumerate(config, 1)]
    if len({s.alias for s in stages}) != len(stages):
        raise ValueError("stages with the same alias")
    return stages


def unique_labels(labels: list[str]) -> list[str]:
    """The labels, or an error that names those that occur twice."""
    if twice := sorted({x for x in labels if labels.count(x) > 1}):
        raise ValueError(f"labels that occur twice: {twice}")
    return labels


def config_hash(value) -> str:
    """A digest that does not depend on the order of keys; compared when a run is resumed."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def restore_offset(log: DataFrame) -> int:
    """The steps of all finished stages."""
    return log.filter(F.col("event") == "etapa_fim").agg(F.coalesce(F.sum("step_global"), F.lit(0))).first()[0]


def per_thousand(tokens: DataFrame, columns: list[str]) -> DataFrame:
    return tokens.withColumns({c: F.col(c) / 1000 for c in columns})


def merge_with_origin(df: DataFrame, origin: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the first key that both sides have."""
    key = next((k for k in keys if k in df.columns and k in origin.columns), None)
    if key is None:
        raise ValueError(f"no common key among {keys}")
    fresh = [c for c in origin.columns if c not in df.columns or c == key]
    return df.join(origin.select(*fresh).dropDuplicates([key]), key, "left")
