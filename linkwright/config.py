"""Folders and options of a run, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from enum import Enum


class Regime(Enum):
    """Candidate regimes: how dense the index is and how widely stateless records search."""

    PLAIN = ("", False, False, 5)
    HARD = ("hard", True, False, 5)
    HARD_WIDE = ("hard2", True, True, 20)
    WIDE = ("v2", False, True, 20)
    HARD_WIDEST = ("hard3", True, True, 50)
    WIDEST = ("v3", False, True, 50)

    def __init__(self, tag: str, drops_index: bool, word_view: bool, k_no_state: int):
        self.tag, self.drops_index, self.word_view, self.k_no_state = tag, drops_index, word_view, k_no_state

    @classmethod
    def of(cls, tag: str) -> Regime:
        return next(r for r in cls if r.tag == tag)

    def for_test(self) -> Regime:
        """The regime of the unlabelled split that goes with this one."""
        return {"hard": Regime.PLAIN, "hard2": Regime.WIDE, "hard3": Regime.WIDEST}.get(self.tag, self)


def _folder(variable: str, default: str):
    return field(default_factory=lambda: os.environ.get(variable, default))


@dataclass(frozen=True)
class Config:
    data: str = _folder("ER_DATA", "data")
    work: str = _folder("ER_WORK", "work")
    output: str = _folder("ER_OUTPUT", "output")
    regime: Regime = Regime.PLAIN
    k_no_state: int | None = field(default_factory=lambda: int(os.environ["ER_K_NOSTATE"]) if "ER_K_NOSTATE" in os.environ else None)
    french_pack: bool = field(default_factory=lambda: os.environ.get("ER_FR_PACK", "1") == "1")
