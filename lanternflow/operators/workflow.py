"""A screening workflow: steps, routes, a mandatory human gate, checkpoints, an audit trail. Plain Python on the driver; the
state holds DataFrames, which stay lazy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

State = dict[str, Any]
END = "end"
# Decisions that an analyst can take.
DECISIONS = ("escalate", "clear", "request_more_information")


class WorkflowError(ValueError):
    """A workflow that does not hold together, or a decision that is none."""


@dataclass
class Workflow:
    """Steps by name; edges lead from a step to the next, routers choose it: a function of the state gives the name of a way,
    and ways lead to steps. (Without ways, the function gives the step itself.) The walk pauses before the gate unless the
    state has a decision; a workflow without a gate never pauses."""

    start: str
    nodes: dict[str, Callable[[State], State]] = field(default_factory=dict)
    edges: dict[str, str] = field(default_factory=dict)
    routers: dict[str, Callable[[State], str]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    gate: str = ""
    escapes: tuple[str, ...] = ()
    ways: dict[str, dict[str, str]] = field(default_factory=dict)
    checkpoints: list[tuple[int, str, State]] = field(default_factory=list)

    def validate(self) -> None:
        targets = [*self.edges.values(), *(x for way in self.ways.values() for x in way.values())]
        for name in [self.start, *self.edges, *self.routers, *self.ways, *self.required, *(x for x in targets if x != END)]:
            if name not in self.nodes:
                raise WorkflowError(f"no step is named {name}")
        for name in self.nodes:
            if name not in self.edges and name not in self.routers:
                raise WorkflowError(f"nothing follows {name}")
            if name in self.edges and name in self.routers:
                raise WorkflowError(f"{name} has an edge and a router")
        unknown = [x for x in self.ways if x not in self.routers]
        if unknown:
            raise WorkflowError(f"{unknown[0]} has ways but no router")

    def following(self, at: str, state: State) -> str:
        if at not in self.routers:
            return self.edges[at]
        chosen = self.routers[at](state)
        if at not in self.ways:
            return chosen
        if chosen not in self.ways[at]:
            raise WorkflowError(f"{at} has no way named {chosen}")
        return self.ways[at][chosen]

    def stream(self, state: State, max_steps: int = 20) -> Iterator[State]:
        """The state after each step; the last one is that of the end, or of the pause before the gate ('paused' names it)."""
        self.validate()
        state = {"trail": [], "visited": [], **state}
        at = state.pop("paused", None) or self.start
        for _ in range(max_steps):
            if at == END:
                missing = [x for x in self.required if x not in state["visited"]]
                if missing and not set(self.escapes) & set(state["visited"]):
                    raise WorkflowError(f"the workflow ended without {', '.join(missing)}")
                yield state
                return
            if at == self.gate and "decision" not in state:
                yield {**state, "paused": at}
                return
            if at not in self.nodes:
                raise WorkflowError(f"no step is named {at}")
            state = {**state, **self.nodes[at](state)}
            following = self.following(at, state)
            state["visited"] = [*state["visited"], at]
            state["trail"] = [*state["trail"], (len(state["trail"]) + 1, at, following)]
            self.checkpoints.append((len(state["trail"]), at, state))
            at = following
            yield state
        raise WorkflowError(f"no end after {max_steps} steps")

    def run(self, state: State, max_steps: int = 20) -> State:
        """Walks from the start, or from where the state is paused, to the end or to the pause before the human gate."""
        last = state
        for last in self.stream(state, max_steps):
            pass
        return last

    def resume(self, state: State, decision: str, analyst: str, at: str, note: str = "") -> State:
        """Goes on from the pause with a decision."""
        if "paused" not in state:
            raise WorkflowError("the workflow is not paused")
        return self.run(record_decision(state, decision, analyst, at, note))

    def history(self) -> list[tuple[int, str, State]]:
        """Number, step and state after each step that was walked, over all runs."""
        return list(self.checkpoints)


def record_decision(state: State, decision: str, analyst: str, at: str, note: str = "") -> State:
    """state with an analyst's decision; a decision package in it is closed. No step of a workflow calls this."""
    if decision not in DECISIONS:
        raise WorkflowError(f"{decision} is none of {', '.join(DECISIONS)}")
    taken = {"decision": decision, "analyst": analyst, "at": at, "note": note}
    closed = {**state, "decision": taken}
    if "decision_package" in state:
        package = {"decision": decision, "decided_by": analyst, "decided_at": at, "note": note, "requires_human_decision": False}
        closed |= {"decision_package": {**state["decision_package"], **package}, "awaiting_human_decision": False}
    return closed


def audit_trail(spark: SparkSession, state: State) -> DataFrame:
    return spark.createDataFrame(state.get("trail", []), "step int, node string, following string")


def to_mermaid(w: Workflow) -> str:
    routed = [f"  {a} -->|{way}| {b}" for a, ways in w.ways.items() for way, b in ways.items()]
    return "\n".join(["graph TD", *(f"  {a} --> {b}" for a, b in w.edges.items()), *routed])
