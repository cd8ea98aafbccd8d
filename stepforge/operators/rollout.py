"""Rollouts of action sequences in a small relational world, and grids of candidate tasks with reasons.

The simulator of real scenes is external; `Transition` is the interface it fills. The world here knows: walking
makes the target close; grabbing needs it close and empty hands; putting needs the object in hand and the
target close; opening and switching on need the target close."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepforge.session import ready


class Transition(Protocol):
    """A world that takes actions and knows which triples hold."""

    def act(self, verb: str, args: list[str]) -> bool: ...

    def holds(self, triple: tuple[str, str, str]) -> bool: ...


@dataclass
class World:
    close: str | None = None
    hand: str | None = None
    facts: set[tuple[str, str, str]] = field(default_factory=set)

    def act(self, verb: str, args: list[str]) -> bool:
        """Does the action if it can be done; false if not."""
        if verb == "walk" and len(args) == 1:
            self.close = args[0]
        elif verb == "grab" and len(args) == 1 and self.close == args[0] and self.hand is None:
            self.hand = args[0]
            self.facts = {f for f in self.facts if f[0] != args[0] or f[1] not in ("on", "inside")}
        elif verb in ("put", "putin") and len(args) == 2 and self.hand == args[0] and self.close == args[1]:
            self.facts.add((args[0], "on" if verb == "put" else "inside", args[1]))
            self.hand = None
        elif verb in ("open", "switchon") and len(args) == 1 and self.close == args[0]:
            self.facts.add((args[0], "is", "open" if verb == "open" else "on"))
        else:
            return False
        return True

    def holds(self, triple: tuple[str, str, str]) -> bool:
        s, r, o = triple
        return triple in self.facts or (s == "character" and ((r == "hold" and o == (self.hand or "none")) or (r == "close" and o == self.close)))


def rolled(actions: list[tuple[str, list[str]]], goal: tuple[str, str, str], world: Transition, most: int) -> tuple[bool, int, int, int]:
    """success, steps, invalid and executed actions: it ends at the goal (0 steps if it holds at once), or after `most` steps."""
    if world.holds(goal):
        return True, 0, 0, 0
    invalid = executed = 0
    for step, (verb, args) in enumerate(actions[:most], 1):
        if not world.act(verb, args):
            invalid += 1
            continue
        executed += 1
        if world.holds(goal):
            return True, step, invalid, executed
    return False, most, invalid, executed


def rollouts(actions: DataFrame, goals: DataFrame, most: int = 30, world: type = World) -> DataFrame:
    """episode, success, steps, invalid_actions, executed_actions; actions (episode, step, action), goals (episode, s, r, o).

    An episode runs in one task, step by step, of which it has `most` at most; parsing failures count as invalid."""
    ready(actions.sparkSession)
    first = Window.partitionBy("episode").orderBy("step")
    early = actions.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= most).drop("_at").join(goals, "episode")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        plan = [(w[0], w[1:]) if (w := (a or "").split()) else ("", []) for a in pdf["action"].head(most)]
        first = pdf.iloc[0]
        return pd.DataFrame([(first["episode"], *rolled(plan, (first["s"], first["r"], first["o"]), world(), most))], columns=["episode", "success", "steps", "invalid_actions", "executed_actions"])

    return early.groupBy("episode").applyInPandas(run, "episode long, success boolean, steps long, invalid_actions long, executed_actions long")


def candidate_reasons(tasks: DataFrame, scenes: DataFrame, present: DataFrame, scene: str, name: str, more: list[tuple[str, Column]]) -> DataFrame:
    """reason, n over every task in every scene: the first of `more` (reason, condition) that holds, 'ok', or 'missing_object'.

    tasks (task, name, ...), scenes and present (scene, name), what a scene holds. Tasks meet the scenes that hold their
    object; the others are counted by what is left of all pairs, which are never made."""
    reason = F.when(more[0][1], more[0][0]) if more else F.when(F.lit(False), "")
    for label, broken in more[1:]:
        reason = reason.when(broken, label)
    own = scenes.select(scene).distinct()
    held = present.select(scene, name).distinct().join(own, scene, "left_semi").join(tasks, name)
    counts = held.groupBy(reason.otherwise("ok").alias("reason")).agg(F.count("*").alias("n"))
    missing = counts.agg((F.lit(own.count() * tasks.count()) - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).filter("n > 0")
    return counts.unionByName(missing.select(F.lit("missing_object").alias("reason"), "n"))
