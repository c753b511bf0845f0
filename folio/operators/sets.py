"""Set and map logic inside rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The steps of a book in order, and those asked for unless others are.
STEPS = ("chunk", "synth", "assemble", "verify")
DEFAULT_STEPS = ("chunk", "synth", "assemble")


def map_union(left: Column, right: Column) -> Column:
    """ST-02: both maps' entries, the right one's value where both have a key."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k)), right)


def _steps(keep) -> Column:
    return F.filter(F.array(*(F.lit(s) for s in STEPS)), keep)


def chosen_steps(requested: Column) -> Column:
    """ST-04: known steps of a request, in order."""
    return _steps(lambda s: F.array_contains(requested, s))


def outstanding_steps(chunks: Column, report_ok: Column, dry_run: Column, outputs: Column) -> Column:
    """ST-04: what a book still needs."""
    narrated = F.coalesce(report_ok, F.lit(False)) & ~F.coalesce(dry_run, F.lit(False))
    needs = F.array(F.when(F.coalesce(chunks, F.lit(0)) == 0, "chunk"), F.when(~narrated, "synth"), F.when(~narrated | (F.coalesce(outputs, F.lit(0)) == 0), "assemble"))
    return F.filter(needs, lambda s: s.isNotNull())


def steps_for(outstanding: Column, requested: Column) -> Column:
    """ST-04: what is asked for and what it still needs, in order, up to the last step asked for."""
    asked = F.when(F.size(chosen_steps(requested)) > 0, chosen_steps(requested)).otherwise(F.array(*(F.lit(s) for s in DEFAULT_STEPS)))
    order = F.array(*(F.lit(s) for s in STEPS))
    last = F.array_max(F.transform(asked, lambda s: F.array_position(order, s)))
    return _steps(lambda s: (F.array_contains(asked, s) | F.array_contains(outstanding, s)) & (F.array_position(order, s) <= last))
