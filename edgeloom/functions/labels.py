"""State labels: fixed state machine values and column functions over label arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States.
STATES = (
    "bot:orchestrate", "bot:queued", "bot:fix", "bot:plan-draft", "bot:needs-discussion", "bot:plan-final", "bot:plan-approved",
    "bot:implementing", "bot:pr-created", "bot:pr-reviewable", "bot:premerged", "bot:pr-needs-fix", "bot:iterating", "bot:done",
)
# Healing priority, highest first.
PRIORITY = (
    "bot:needs-discussion", "bot:plan-draft", "bot:implementing", "bot:iterating", "bot:fix", "bot:premerged", "bot:pr-reviewable",
    "bot:done", "bot:orchestrate", "bot:queued", "bot:plan-final", "bot:plan-approved", "bot:pr-created", "bot:pr-needs-fix",
)
# Allowed transitions.
TRANSITIONS = {
    "bot:orchestrate": ("bot:queued",),
    "bot:queued": ("bot:fix",),
    "bot:fix": ("bot:plan-draft",),
    "bot:plan-draft": ("bot:needs-discussion", "bot:plan-final"),
    "bot:needs-discussion": ("bot:plan-final",),
    "bot:plan-final": ("bot:plan-approved", "bot:implementing"),
    "bot:plan-approved": ("bot:implementing",),
    "bot:implementing": ("bot:pr-created",),
    "bot:pr-created": ("bot:pr-reviewable", "bot:pr-needs-fix"),
    "bot:pr-reviewable": ("bot:pr-needs-fix", "bot:premerged", "bot:done"),
    "bot:premerged": ("bot:done", "bot:fix", "bot:queued", "bot:pr-needs-fix"),
    "bot:pr-needs-fix": ("bot:iterating",),
    "bot:iterating": ("bot:pr-created",),
    "bot:done": (),
}
NEEDS_HUMAN, CONFLICT, GATE_FAILED = "needs-human", "integration-conflict", "integration-gate-failed"
AUX_LABELS = (NEEDS_HUMAN, CONFLICT, GATE_FAILED)


def valid_pair(a: Column, b: Column) -> Column:
    pairs = [f"{x}>{y}" for x, targets in TRANSITIONS.items() for y in targets]
    return F.concat_ws(">", a, b).isin(*pairs)


def is_state_label(label: Column) -> Column:
    return F.trim(label).startswith("bot:")


def states(labels: Column) -> Column:
    """Valid states, distinct, in label order."""
    return F.array_distinct(F.filter(labels, lambda x: x.isin(*STATES)))


def invalid_states(labels: Column) -> Column:
    return F.filter(labels, lambda x: is_state_label(x) & ~x.isin(*STATES))


def other_labels(labels: Column) -> Column:
    return F.filter(labels, lambda x: ~is_state_label(x))


def current(labels: Column) -> Column:
    """none, one, multiple or invalid."""
    n = F.size(states(labels))
    return F.when(F.size(invalid_states(labels)) > 0, "invalid").when(n == 0, "none").when(n == 1, "one").otherwise("multiple")


def healed(labels: Column, priority: tuple[str, ...] = PRIORITY) -> Column:
    """State with the best priority; unknown ones last, first on ties; null without states."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), s), F.lit(0)), F.lit(len(priority) + 1))
    ranked = F.transform(states(labels), lambda s, i: F.struct(rank(s).alias("r"), i.alias("i"), s.alias("s")))
    return F.array_min(ranked)["s"]


def with_state(labels: Column, target: Column) -> Column:
    """Non-state labels in order, then the target state."""
    return F.array_append(other_labels(labels), target)


def removed(labels: Column, drop: tuple[str, ...]) -> Column:
    return F.array_distinct(F.filter(labels, lambda x: x.isin(*drop)))


def kept(labels: Column, drop: tuple[str, ...]) -> Column:
    return F.filter(labels, lambda x: ~x.isin(*drop))


def blocking(labels: Column, watch: tuple[str, ...] = (CONFLICT, GATE_FAILED)) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in watch]), lambda w: F.array_contains(labels, w))
