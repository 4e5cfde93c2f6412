"""Settings of a curation, one group for each step that reads them; each group checks itself and stays on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

# Weights of the eight terms of a candidate's value, in the order in which they are added.
TERMS = ("quality", "match", "diversity", "pose", "expression", "appearance", "scene", "session")
PROFILES = {
    "balanced": (0.34, 0.16, 0.16, 0.10, 0.07, 0.07, 0.05, 0.05),
    "quality": (0.54, 0.19, 0.08, 0.05, 0.03, 0.04, 0.03, 0.04),
    "diversity": (0.21, 0.13, 0.20, 0.13, 0.08, 0.10, 0.08, 0.07),
}
# The least match of each named mode, and the bits by which near duplicates may differ at each strength.
LEAST_MATCH = {"high": 0.72, "normal": 0.65}
NEAR_BITS = {"strong": 8, "normal": 4, "exact": None}


@dataclass(frozen=True)
class Limits:
    """What an item must reach to be a candidate (operators.gates)."""

    match: float = LEAST_MATCH["high"]
    quality: float = 0.30
    alone: bool = True

    def __post_init__(self):
        if not (0 <= self.match <= 1):
            raise ValueError(f"the least match lies between 0 and 1, not at {self.match}")


@dataclass(frozen=True)
class Choice:
    """How many candidates are chosen in each collection, and by what weights (operators.selection, operators.review)."""

    count: int = 100
    weights: tuple[float, ...] = PROFILES["balanced"]

    def __post_init__(self):
        if len(self.weights) != len(TERMS):
            raise ValueError(f"{len(TERMS)} weights are needed")


@dataclass(frozen=True)
class Policy:
    """All settings of plans.curation; near_bits: None where only exact copies count (operators.duplicates)."""

    limits: Limits = field(default_factory=Limits)
    near_bits: int | None = NEAR_BITS["strong"]
    choice: Choice = field(default_factory=Choice)

    def text(self) -> str:
        """The same text for equal policies, to compare runs by."""
        return json.dumps(asdict(self), sort_keys=True)


def _known(table: dict, name: str, what: str):
    if name not in table:
        raise ValueError(f"no {what} named {name}; there are {', '.join(table)}")
    return table[name]


def named(profile: str = "balanced", strength: str = "strong", mode: str = "high", count: int = 100, bits: int = 8) -> Policy:
    """A policy by the names of its parts; ``bits`` bounds what the strength allows, and is what the strong one means."""
    near = _known(NEAR_BITS, strength, "strength")
    near = bits if strength == "strong" else near and min(near, bits)
    return Policy(Limits(match=_known(LEAST_MATCH, mode, "mode")), near, Choice(count, _known(PROFILES, profile, "profile")))
