"""State machines as command tables: each target's commands are folded in order into state, history and refusals.

The fold is one pass over the commands sorted by target (a native aggregate would copy the log at each command), so a
target can have any number of them. A refused command changes nothing and says why. Random ids and clocks of a record system become
columns of the command: seq, at, actor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import folded


@dataclass(frozen=True)
class Machine:
    """moves: states reachable from each state; None: any other state among ``states``. needs: columns that must not
    be blank, with the states entered for which they must not."""

    name: str
    first: str
    states: tuple[str, ...]
    moves: dict[str, tuple[str, ...]] | None = None
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    same_refused: bool = True


NOTICE = Machine(
    "notice", "draft", ("draft", "signed", "mailed", "receipt-hashed", "answered", "refused"),
    {"draft": ("signed",), "signed": ("draft", "mailed"), "mailed": ("receipt-hashed", "answered", "refused"), "receipt-hashed": ("answered", "refused"), "answered": (), "refused": ()},
    {"evidence": ("mailed", "receipt-hashed")},
)
TRIGGER = Machine("trigger", "waiting", ("waiting", "fired", "withdrawn"), {"waiting": ("fired", "withdrawn"), "fired": (), "withdrawn": ()})
AMENDMENT = Machine("amendment", "proposed", ("proposed", "approved", "incorporated", "dropped"))
DEADLINE = Machine("deadline", "open", ("open", "met", "superseded", "lapsed", "vacated"), None, {"reason": ("open", "met", "superseded", "lapsed", "vacated")})
AUTHORITY = Machine(
    "authority", "unverified", ("unverified", "resolved", "source-checked", "stale-flagged"), None,
    {"source": ("unverified", "resolved", "source-checked", "stale-flagged"), "evidence": ("source-checked", "stale-flagged")}, False,
)
OUTREACH = Machine(
    "outreach", "candidate", ("candidate", "shortlisted", "simulated", "response", "declined", "opted_out"),
    {"candidate": ("shortlisted", "declined", "opted_out"), "shortlisted": ("simulated", "declined", "opted_out"), "simulated": ("response", "declined", "opted_out"), "response": ("declined", "opted_out"), "declined": (), "opted_out": ()},
)
MACHINES = {m.name: m for m in (NOTICE, TRIGGER, AMENDMENT, DEADLINE, AUTHORITY, OUTREACH)}


def verdict(m: Machine, state: str, command: dict) -> str | None:
    """Why a command is refused in a state; null if it isn't."""
    to = command["to_state"]
    if to not in m.states:
        return f"unknown state: {'none' if to is None else to}"
    if m.moves is not None:
        if to not in m.moves.get(state, ()):
            return f"{state} can't become {to}"
    elif m.same_refused and to == state:
        return f"already {state}"
    for col, states in m.needs.items():
        if to in states and not (command[col] or "").strip():
            return f"{col} is missing"
    return None


def run(commands: DataFrame, m: Machine, current: DataFrame | None = None) -> DataFrame:
    """commands (target_id, seq, to_state and the columns that m needs), current (target_id, state): a row for each
    command with from_state, accepted and reason, in order of seq. One pass over sorted rows that keeps a state."""
    needed = [c for c in m.needs if c not in ("target_id", "seq", "to_state")]
    own = commands.select("target_id", F.col("seq").cast("bigint").alias("seq"), "to_state", *needed)
    if current is not None:
        own = own.join(current.select("target_id", F.col("state").alias("_s")), "target_id", "left")
    else:
        own = own.withColumn("_s", F.lit(None).cast("string"))

    def step(at: dict, c: dict) -> dict:
        state = at.setdefault("state", c["_s"] or m.first)
        why = verdict(m, state, c)
        if why is None:
            at["state"] = c["to_state"]
        return {"target_id": c["target_id"], "seq": c["seq"], "from_state": state, "to_state": c["to_state"], "accepted": why is None, "reason": why}

    key = own.schema["target_id"].dataType.simpleString()
    return folded(own, "target_id", ["seq", "to_state", *needed], dict, step, f"target_id {key}, seq bigint, from_state string, to_state string, accepted boolean, reason string")


def snapshot(log: DataFrame, m: Machine) -> DataFrame:
    """The state that each target ends in."""
    last = F.max_by("to_state", F.when(F.col("accepted"), F.col("seq")))
    return log.groupBy("target_id").agg(F.coalesce(last, F.min_by("from_state", "seq")).alias("state"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
