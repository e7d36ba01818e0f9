"""A small driver for pipelines of named tasks: topological order, retries, and tasks skipped whose inputs have not changed."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Task:
    """A task's function takes (spark, config, results of the tasks it needs) and returns something that JSON can hold."""

    name: str
    run: Callable
    needs: tuple[str, ...] = ()
    config: dict = field(default_factory=dict)
    retries: int = 0


def order(tasks: list[Task]) -> list[Task]:
    """Tasks after those they need; an unknown or circular need is an error."""
    by = {t.name: t for t in tasks}
    done: list[Task] = []

    def visit(t: Task, path: tuple[str, ...]) -> None:
        if t.name in path:
            raise ValueError("cycle: " + " > ".join((*path, t.name)))
        for n in t.needs:
            if n not in by:
                raise ValueError(f"{t.name} needs {n}, which is no task")
            visit(by[n], (*path, t.name))
        if t not in done:
            done.append(t)

    for t in tasks:
        visit(t, ())
    return done


def run(spark: SparkSession, tasks: list[Task], state: dict | None = None, pause: float = 0.0) -> dict:
    """Run all tasks; `state` (a plain dict, which the caller keeps) lets a second run skip what has the same inputs.

    Returns {name: {"status": done | skipped | failed | blocked, "result": ..., "seconds": ..., "attempts": ...}}.
    """
    state = {} if state is None else state
    out: dict[str, dict] = {}
    for t in order(tasks):
        if any(out[n]["status"] in ("failed", "blocked") for n in t.needs):
            out[t.name] = {"status": "blocked", "result": None, "seconds": 0.0, "attempts": 0}
            continue
        inputs = {n: out[n]["result"] for n in t.needs}
        key = hashlib.sha256(json.dumps([t.name, t.config, inputs], sort_keys=True, default=str).encode()).hexdigest()
        if state.get(t.name, {}).get("key") == key:
            out[t.name] = {"status": "skipped", "result": state[t.name]["result"], "seconds": 0.0, "attempts": 0}
            continue
        began, attempts = time.monotonic(), 0
        while True:
            attempts += 1
            try:
                result = t.run(spark, t.config, inputs)
            except Exception as e:
                if attempts > t.retries:
                    out[t.name] = {"status": "failed", "result": None, "error": str(e), "seconds": time.monotonic() - began, "attempts": attempts}
                    break
                time.sleep(pause * 2 ** (attempts - 1))
            else:
                out[t.name] = {"status": "done", "result": result, "seconds": time.monotonic() - began, "attempts": attempts}
                state[t.name] = {"key": key, "result": result}
                break
    return out
