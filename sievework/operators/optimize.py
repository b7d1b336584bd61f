"""Reflective search for a prompt: evaluate, keep what is not dominated, mutate the cases that go worst."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import staged

from . import experiments


@dataclass
class Candidate:
    name: str
    prompt: str
    parent: str | None = None
    score: float = 0.0
    cases: dict[str, float] = field(default_factory=dict)


def evaluate(examples: DataFrame, prompt_id: str, cache: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(prompt_id, program_id, name, score)``: what the cache has, and ``score`` of what it lacks.

    ``score`` takes examples and returns ``(program_id, name, score)``; its answers are stored as they come.
    """
    keyed = examples.withColumn("prompt_id", F.lit(prompt_id))
    keys = ["prompt_id", "program_id", "name"]
    fresh = score(experiments.uncached(keyed, cache, keys)).select(F.lit(prompt_id).alias("prompt_id"), "program_id", "name", "score")
    known = cache.join(keyed.select(*keys), keys, "left_semi").select(*keys, "score")
    return staged(known.union(fresh), "scores")


def search(seed: str, run: Callable[[str], dict[str, float]], reflect: Callable[[str, list[str], int], list[str]], rounds: int, worst: int = 3, rng_seed: int = 0) -> tuple[Candidate, list[Candidate]]:
    """The best prompt found in ``rounds`` and all that were tried.

    ``run`` scores a prompt by case; it is where the cluster works. ``reflect(prompt, cases, k)`` proposes
    prompts from the ``worst`` + 1 cases; those of 40 characters or fewer are dropped. A parent is drawn by how many cases it is
    best at, plus one; a better score alone replaces the best.
    """
    rng = random.Random(rng_seed)

    def tried(name: str, prompt: str, parent: str | None) -> Candidate:
        cases = run(prompt)
        return Candidate(name, prompt, parent, sum(cases.values()) / len(cases) if cases else 0.0, cases)

    best = tried("seed", seed, None)
    front = [best]
    for _ in range(rounds):
        tops = {c: max(x.cases.get(c, 0.0) for x in front) for x in front for c in x.cases}
        weights = [1 + sum(1 for c, t in tops.items() if t > 0 and x.cases.get(c, 0.0) >= t) for x in front]
        parent = rng.choices(front, weights=weights)[0]
        low = sorted(parent.cases, key=lambda c: (parent.cases[c], c))[: worst + 1]
        for prompt in reflect(parent.prompt, low, worst):
            if len(prompt.strip()) > 40:
                new = tried(f"candidate{len(front)}", prompt.strip(), parent.name)
                front.append(new)
                best = new if new.score > best.score else best
    return best, front
