"""Named decision types with priorities (lower wins) and pairs that exclude each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import ConfigError


@dataclass(frozen=True)
class DecisionType:
    id: str
    display_name: str = ""
    priority: int = 100


@dataclass
class DecisionTypes:
    types: list[DecisionType] = field(default_factory=list)  # by priority; of equal ones the newest first
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def add(self, id: str, display_name: str = "", priority: int = 100) -> DecisionTypes:
        if not id:
            raise ConfigError("InvalidDecisionType", "empty id")
        if self.find(id):
            raise ConfigError("InvalidDecisionType", f"duplicate id {id}")
        at = next((i for i, t in enumerate(self.types) if t.priority >= priority), len(self.types))
        self.types.insert(at, DecisionType(id, display_name, priority))
        return self

    def exclude(self, a: str, b: str) -> DecisionTypes:
        for x in (a, b):
            if not self.find(x):
                raise ConfigError("InvalidDecisionType", f"unknown id {x}")
        self.pairs.append((a, b))
        return self

    def find(self, id: str) -> DecisionType | None:
        return next((t for t in self.types if t.id == id), None)

    def losers(self) -> list[tuple[str, str]]:
        """(loser, winner) of every pair: the larger priority number loses, on a tie the second id."""
        out = []
        for a, b in self.pairs:
            out.append((b, a) if self.find(a).priority <= self.find(b).priority else (a, b))
        return out
