"""Planners: what turns a question into a plan. A model-backed one plugs in through generate()."""

from __future__ import annotations

from typing import Protocol

from gristmill.plans.grammar import request_plan


class Planner(Protocol):
    name: str
    fallback_on_failure: bool

    def generate(self, question: str, retrieved: dict):
        """JSON text or an object; anything but a valid plan of the question is refused later."""


class RulePlanner:
    """The grammar alone."""

    name = "deterministic_rules"
    fallback_on_failure = False

    def generate(self, question: str, retrieved: dict) -> dict:
        return request_plan(question)


class UnavailablePlanner:
    """Stands for a model that could not be loaded; the rules answer in its place, labelled as such."""

    fallback_on_failure = True

    def __init__(self, reason: str, name: str = "unavailable_model"):
        self.reason, self.name = reason, name

    def generate(self, question: str, retrieved: dict):
        raise RuntimeError(self.reason)
