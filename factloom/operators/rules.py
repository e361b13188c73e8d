"""The extension point for rules (survey X1): functions from facts to findings, in registry order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.findings import PHASES, collect_findings

Facts = dict[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    id: str
    phase: str
    frameworks: tuple[str, ...]
    topic: str
    confidence: str
    run: Callable[[Facts], DataFrame]


@dataclass
class Registry:
    """Rules in order of phase, then of registration."""

    rules: list[Rule] = field(default_factory=list)

    def rule(self, id: str, phase: str, frameworks: tuple[str, ...], topic: str, confidence: str) -> Callable:
        if phase not in PHASES:
            raise ValueError(f"no phase {phase}")

        def register(run: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
            self.rules.append(Rule(id, phase, frameworks, topic, confidence, run))
            return run

        return register

    def applicable(self, framework: str, max_phase: str) -> list[Rule]:
        """F2, T5: the rules of a framework up to a phase; rules beyond it are never planned."""
        own = [r for r in self.rules if framework in r.frameworks and PHASES.index(r.phase) <= PHASES.index(max_phase)]
        return sorted(own, key=lambda r: PHASES.index(r.phase))

    def findings(self, facts: Facts, framework: str, max_phase: str = PHASES[-1]) -> DataFrame | None:
        """The findings of all applicable rules as one plan, with rule, topic and confidence filled in."""
        rules = self.applicable(framework, max_phase)
        outs = [r.run(facts).withColumns({"rule": F.lit(r.id), "topic": F.lit(r.topic), "confidence": F.lit(r.confidence)}) for r in rules]
        return collect_findings(outs) if outs else None
