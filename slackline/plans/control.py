"""Driver-side helpers around evaluation: loading potentials, candidate processes, parameters, selections."""

from __future__ import annotations

import functools
import importlib.util
import inspect
import json
import os
import resource
import signal
import subprocess
import time
from collections.abc import Callable
from pathlib import Path

#: Parameters of a candidate in bytes, at most; larger ones score 0.
KWARGS_BYTES = 51_200


def load_symbol(path: str, qualname: str):
    """A class or function of a Python file, by its dotted name."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    found = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(found)
    for part in qualname.split("."):
        found = getattr(found, part)
    return found


@functools.lru_cache(maxsize=64)
def _cached(path: str, qualname: str, changed: int, size: int):
    return load_symbol(path, qualname)


def cached_symbol(path: str, qualname: str):
    """``load_symbol``, once in a process for each state of the file: for tasks that score many batches."""
    at = os.stat(path)
    return _cached(path, qualname, at.st_mtime_ns, at.st_size)


def instance_paths(names: list[str], folders: list[str]) -> tuple[list[str], list[str]]:
    """Where named instances are (a path as it is, else the first folder that has it), and an error for each missing one."""
    found, errors = [], []
    for name in names:
        places = [name, *(str(Path(f) / name) for f in folders)]
        place = next((p for p in places if Path(p).exists()), None)
        if place is None:
            errors.append(f"no instance {name!r} (looked at {', '.join(places)})")
        else:
            found.append(place)
    return found, errors


def supported(options: dict, function: Callable) -> dict:
    """The options that the function has parameters for and that are not null."""
    known = inspect.signature(function).parameters
    anything = any(p.kind is p.VAR_KEYWORD for p in known.values())
    return {k: v for k, v in options.items() if v is not None and (anything or k in known)}


class Timer:
    """Seconds by phase: ``with timer("edges"): ...``; a phase that comes again adds up."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    def __call__(self, phase: str) -> Timer:
        self._phase = phase
        return self

    def __enter__(self):
        self._began = (self._phase, time.monotonic())

    def __exit__(self, *_):
        phase, began = self._began
        self.seconds[phase] = self.seconds.get(phase, 0.0) + time.monotonic() - began


def best_of(n: int, attempt: Callable[[int], float], log: str, retries: int = 2) -> tuple[int, float] | None:
    """(attempt, score) of the best of ``n`` attempts, the first of equal ones; none if all failed.

    An attempt that raises is tried ``retries`` times more. Each outcome is a line of ``log`` at once, and attempts
    that are there with a score are not made again.
    """
    path, done = Path(log), {}
    if path.exists():
        for line in path.read_text().splitlines():
            r = json.loads(line)
            if r["score"] is not None:
                done[r["attempt"]] = r["score"]
    for i in range(n):
        for tried in range(retries + 1):
            if i in done:
                break
            row = {"attempt": i, "try": tried, "score": None, "error": None}
            try:
                done[i] = row["score"] = attempt(i)
            except Exception as e:  # noqa: BLE001  an attempt may fail in any way
                row["error"] = repr(e)
            with path.open("a") as f:
                f.write(json.dumps(row) + "\n")
    return max(done.items(), key=lambda r: (r[1], -r[0])) if done else None


def parameters(text_or_path: str) -> dict:
    """JSON inline, or the file of that name."""
    text = text_or_path if text_or_path.lstrip().startswith("{") else Path(text_or_path).read_text()
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("parameters are a JSON object")
    return found


def public(output: dict) -> dict:
    """A candidate's parameters: under ``potential_kwargs``, else ``kwargs``, else all; names with a leading _ are private."""
    found = output.get("potential_kwargs") or output.get("kwargs") or output
    return {k: v for k, v in found.items() if not k.startswith("_")}


def small_enough(kwargs: dict, most: int = KWARGS_BYTES) -> bool:
    return len(json.dumps(kwargs, sort_keys=True).encode()) <= most


def selection(text: str) -> list[int]:
    """Numbers and ranges, as in 3,5,10-14: in order, once each."""
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        for n in range(int(low), int(high or low) + 1):
            out[n] = None
    return list(out)


def budget(workers: int, seconds: float, most_per_task: float) -> int:
    """Tasks that fit."""
    return int(workers * seconds / most_per_task)


def stage_c_seconds(proxy: float) -> float:
    """From 30 down to 10 as the proxy goes from 0 to 5."""
    return 30 - 20 * min(max(proxy, 0), 5) / 5


def candidate(command: list[str], seconds: float, grace: float = 10, memory_gb: float | None = None, cwd: str | None = None, cpu_seconds: int | None = None) -> tuple[int | None, str, str]:
    """Runs a candidate program in a session of its own: exit code (null if it was stopped), output, errors.

    After ``seconds`` it is asked to end, after ``grace`` more it is killed.
    """

    def limits():
        os.setsid()
        if memory_gb:
            resource.setrlimit(resource.RLIMIT_AS, (int(memory_gb * 1e9),) * 2)
        if cpu_seconds:
            resource.setrlimit(resource.RLIMIT_CPU, (cpu_seconds, cpu_seconds + 1))

    p = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, cwd=cwd, preexec_fn=limits)
    for wait, how in ((seconds, signal.SIGTERM), (grace, signal.SIGKILL)):
        try:
            out, err = p.communicate(timeout=wait)
            return (p.returncode if how == signal.SIGTERM else None), out, err
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, how)
    return None, *p.communicate()
