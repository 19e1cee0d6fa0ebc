"""The signal catalog as a plug-in surface: registration, validated parameters, lineage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from quantloom.operators.grid import CATALOG, Params, parameter_hash, valid
from quantloom.operators.signals import SIGNALS
from quantloom.plans.engine import Stage, apply_stages


@dataclass(frozen=True)
class Strategy:
    """A named signal with parameters that its catalog entry allows."""

    name: str
    params: tuple[tuple[str, float], ...]

    def signals(self, bars: DataFrame) -> DataFrame:
        """``bars`` plus signal, within -1 and 1 and causal."""
        staged = apply_stages(bars, SIGNALS[self.name](**dict(self.params)))
        return staged.select(*bars.columns, "signal")

    @property
    def parameter_hash(self) -> str:
        return parameter_hash(dict(self.params))


def build(name: str, params: Params | None = None) -> Strategy:
    """The strategy, its defaults filled in; an unknown name or parameter, a value out of bounds or a wrong order is an error."""
    if name not in CATALOG:
        raise ValueError(f"no strategy is named {name!r}")
    bounds, given = CATALOG[name][1], dict(params or {})
    if unknown := sorted(set(given) - set(bounds)):
        raise ValueError(f"{name} has no parameters {unknown}")
    whole = {p: given.get(p, default) for p, (default, _, _) in bounds.items()}
    for p, value in whole.items():
        default, low, high = bounds[p]
        if isinstance(value, bool) or not low <= value <= high or (isinstance(default, int) and value != int(value)):
            raise ValueError(f"{p}={value!r} is not within {low} and {high}")
        whole[p] = int(value) if isinstance(default, int) else float(value)
    if not valid(name, whole):
        raise ValueError(f"{name} cannot have {whole}: the lengths must increase")
    return Strategy(name, tuple(sorted(whole.items())))


def register(name: str, category: str, params: dict[str, tuple[float, float, float]], stages: Callable[..., list[Stage]]) -> None:
    """Add a signal: its parameters with (default, least, greatest), and the stages that end in ``signal``."""
    if name in CATALOG:
        raise ValueError(f"{name!r} is registered already")
    if not any("signal" in stage for stage in stages(**{p: d for p, (d, _, _) in params.items()})):
        raise ValueError("the stages make no signal")
    CATALOG[name], SIGNALS[name] = (category, dict(params)), stages


@dataclass(frozen=True)
class Lineage:
    """What makes a result reproducible; JSON and back without loss."""

    code_version: str
    parameter_hash: str
    source: str
    adapter_version: str
    quality_passed: bool
    since: str
    until: str

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Lineage:
        return cls(**json.loads(text))


def search_version(names: Iterable[str], **how: object) -> str:
    """Identity of a search: its families whatever their order, and all settings."""
    return hashlib.sha256(json.dumps({"names": sorted(set(names)), **how}, sort_keys=True, default=str).encode()).hexdigest()
