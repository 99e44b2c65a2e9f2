"""Settings: weights of the dimensions and their parameters, with defaults for all."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .errors import ConfigError, WeightError

DIMENSIONS = ("efficiency", "language", "alignment", "structure", "repetition", "overthinking", "verification", "length", "accuracy_efficiency")


@dataclass(frozen=True)
class Weights:
    efficiency: float = 0.20
    language: float = 0.12
    alignment: float = 0.18
    structure: float = 0.10
    repetition: float = 0.15
    overthinking: float = 0.10
    verification: float = 0.08
    length: float = 0.07
    accuracy_efficiency: float = 0.0

    def validate(self) -> None:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        for name, w in values.items():
            if isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or not 0 <= w <= 1:
                raise WeightError(f"weight of {name} must be a number from 0 to 1, not {w}")
        if abs(sum(values.values()) - 1) > 0.001:
            raise WeightError(f"weights must add up to 1, not {sum(values.values()):.4f}")


@dataclass(frozen=True)
class Config:
    weights: Weights = field(default_factory=Weights)
    strict: bool = False
    restart_penalty_per_1k: float = 8.0
    num_chunks: int = 10
    min_words_per_chunk: int = 20
    sweet_spot_min: int = 200
    sweet_spot_max: int = 3000
    token_min: int = 50
    token_max: int = 5000
    min_score: float = 70.0
    format: str = "parquet"

    def sane(self) -> Config:
        """Parameters as the dimensions use them: none negative or empty, bounds in order."""
        lo, hi = sorted((self.sweet_spot_min, self.sweet_spot_max))
        return replace(self, restart_penalty_per_1k=max(0.0, self.restart_penalty_per_1k), num_chunks=max(1, self.num_chunks), min_words_per_chunk=max(1, self.min_words_per_chunk), sweet_spot_min=lo, sweet_spot_max=hi, token_max=max(self.token_max, self.token_min + 1))


_PLACES = {
    ("input", "strict"): "strict",
    ("output", "min_score"): "min_score",
    ("output", "format"): "format",
    ("scoring", "efficiency", "restart_penalty_per_1k"): "restart_penalty_per_1k",
    ("scoring", "language", "num_chunks"): "num_chunks",
    ("scoring", "language", "min_words_per_chunk"): "min_words_per_chunk",
    ("scoring", "length", "sweet_spot_min"): "sweet_spot_min",
    ("scoring", "length", "sweet_spot_max"): "sweet_spot_max",
    ("scoring", "accuracy_efficiency", "token_min"): "token_min",
    ("scoring", "accuracy_efficiency", "token_max"): "token_max",
}


def parse(text: str) -> Config:
    """Reads TOML; unknown keys are ignored, weights are checked."""
    try:
        tree = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    given = {}
    for path, name in _PLACES.items():
        at = tree
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            given[name] = at
    weights = tree.get("scoring", {}).get("weights", {})
    w = Weights(**{f.name: weights[f.name] for f in fields(Weights) if f.name in weights})
    w.validate()
    if given.get("format", "parquet") not in ("parquet", "jsonl"):
        raise ConfigError(f"unknown output format {given['format']}")
    return Config(weights=w, **given)


def load(path: str | Path) -> Config:
    """The file's settings, or the defaults if there is none."""
    p = Path(path)
    if not p.exists():
        return Config()
    try:
        text = p.read_text()
    except OSError as e:
        raise ConfigError(str(e)) from e
    return parse(text)


def default_toml() -> str:
    """A file with every setting at its default."""
    c = Config()
    tree: dict[str, list[str]] = {}
    for path, name in _PLACES.items():
        v = getattr(c, name)
        tree.setdefault(".".join(path[:-1]), []).append(f"{path[-1]} = {str(v).lower() if isinstance(v, bool) else f'{chr(34)}{v}{chr(34)}' if isinstance(v, str) else v}")
    tree["scoring.weights"] = [f"{d} = {getattr(c.weights, d)}" for d in DIMENSIONS]
    return "\n\n".join("\n".join([f"[{k}]", *tree[k]]) for k in sorted(tree)) + "\n"
