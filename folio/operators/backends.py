"""Plug-in points: engines that turn text to samples, and the actions a controller may start.

Synthesis itself is no query; an engine is any object with `sample_rate` and `speak`. Here stands the adapter that
runs one over a plan's partitions, with the engine made once for each task, and an engine of silence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RENDERED = "id string, ok boolean, error string, seconds double, peak double"


class Backend(Protocol):
    sample_rate: int

    def speak(self, text: str, language: str, voice: str) -> list[float]: ...


class Silence:
    """An engine that takes as long as narration would and says nothing."""

    sample_rate = 100

    def speak(self, text: str, language: str, voice: str) -> list[float]:
        return [0.0] * int(max(len(text) / 15.0, 0.2) * self.sample_rate)


ENGINES: dict[str, Callable[[], Backend]] = {"silence": Silence}


def backend_for(engine: str) -> Backend:
    """UD-01: the engine of that name; an unknown one is refused."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[engine]()


def render(plan: DataFrame, engine: str) -> DataFrame:
    """UD-01: what an engine makes of each chunk (id, text, language, voice); a failure costs its own row."""
    backend_for(engine)  # refuse before any task starts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = backend_for(engine)
        for frame in frames:
            out = []
            for chunk_id, text, language, voice in zip(frame["id"], frame["text"], frame["language"], frame["voice"]):
                try:
                    samples = backend.speak(text or "", language or "", voice or "")
                    out.append((chunk_id, True, None, len(samples) / backend.sample_rate, max(map(abs, samples), default=0.0)))
                except Exception as e:  # an engine may raise anything
                    out.append((chunk_id, False, f"{type(e).__name__}: {e}", 0.0, 0.0))
            yield pd.DataFrame(out, columns=["id", "ok", "error", "seconds", "peak"])

    return plan.select("id", "text", "language", "voice").mapInPandas(run, RENDERED)


#: Actions and the arguments each needs; all others are refused.
ACTIONS = {"ingest": ["source"], "chunk": ["slug"], "synth": ["slug"], "verify": ["slug"], "assemble": ["slug"], "label": ["voice"]}


def action_problems(requests: DataFrame) -> DataFrame:
    """UD-03: requests (id, action, args map) that may not start, with the reason."""
    needs = F.create_map(*(x for a, args in ACTIONS.items() for x in (F.lit(a), F.array(*(F.lit(n) for n in args)))))
    required = needs[F.col("action")]
    missing = F.filter(required, lambda n: F.coalesce(F.col("args")[n], F.lit("")) == "")
    unsafe = F.exists(F.map_values("args"), lambda v: v.rlike(r"(^|/)\.\.(/|$)|^/"))
    reason = F.when(required.isNull(), "unknown action").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(unsafe, "unsafe argument")
    return requests.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("id", "action", "reason")
