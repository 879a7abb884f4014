"""A typed pipeline of steps over DataFrames, run in order on the driver: conditions, placeholders, adapters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

ADAPTERS: dict[str, Callable[[dict], dict]] = {}


def adapter(name: str) -> Callable[[Callable[[dict], dict]], Callable[[dict], dict]]:
    """Registers a function (inputs) -> outputs under a name."""

    def add(fn: Callable[[dict], dict]) -> Callable[[dict], dict]:
        ADAPTERS[name] = fn
        return fn

    return add


@dataclass(frozen=True)
class Step:
    id: str
    use: str
    inputs: Mapping[str, Any] = field(default_factory=dict)
    when: Mapping[str, Any] | None = None


def lookup(env: Mapping, path: str) -> tuple[bool, Any]:
    """(found, value) at a dotted path."""
    at: Any = env
    for key in path.split("."):
        if isinstance(at, Mapping) and key in at:
            at = at[key]
        elif isinstance(at, list) and key.isdigit() and int(key) < len(at):
            at = at[int(key)]
        else:
            return False, None
    return True, at


def holds(when: Mapping[str, Any] | None, env: Mapping) -> bool:
    """exists, missing, nonempty, empty: a path; equals, not_equals: {path: value}; all of them together."""
    for op, arg in (when or {}).items():
        if op in ("exists", "missing"):
            ok = lookup(env, arg)[0] == (op == "exists")
        elif op in ("nonempty", "empty"):
            found, value = lookup(env, arg)
            ok = (found and bool(value)) == (op == "nonempty")
        elif op in ("equals", "not_equals"):
            ok = all((lookup(env, p)[1] == v) == (op == "equals") for p, v in arg.items())
        else:
            raise ValueError(f"unknown condition {op}")
        if not ok:
            return False
    return True


def filled(value: Any, env: Mapping) -> Any:
    """Placeholders ${path}: a value that is one placeholder becomes what it names, inside a text its string."""
    if isinstance(value, str):
        if value.startswith("${") and value.endswith("}") and value.count("${") == 1:
            found, v = lookup(env, value[2:-1])
            if not found:
                raise KeyError(value)
            return v
        out, rest = "", value
        while "${" in rest:
            head, _, tail = rest.partition("${")
            path, _, rest = tail.partition("}")
            found, v = lookup(env, path)
            if not found:
                raise KeyError(path)
            out += head + str(v)
        return out + rest
    if isinstance(value, Mapping):
        return {k: filled(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, env) for v in value]
    return value


def run(steps: list[Step], env: Mapping[str, Any]) -> dict[str, Any]:
    """The environment after all steps; a step's outputs stand under its id.  The first failing step ends the run with its id."""
    ids = [s.id for s in steps]
    if len(set(ids)) != len(ids):
        raise ValueError("two steps have one id")
    unknown = [s.use for s in steps if s.use not in ADAPTERS]
    if unknown:
        raise ValueError(f"no adapter {unknown[0]}")
    env = dict(env)
    for step in steps:
        if not holds(step.when, env):
            env[step.id] = {"skipped": True}
            continue
        try:
            env[step.id] = ADAPTERS[step.use](filled(dict(step.inputs), env))
        except Exception as e:
            raise RuntimeError(f"step {step.id}: {e}") from e
    return env
