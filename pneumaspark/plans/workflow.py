"""The workflow language: a YAML or JSON list of steps that becomes one lazy plan.

A document has ``version: 1``, ``inputs`` (constants), ``steps`` and ``outputs``.  A
step has ``step`` (a registered name), ``in`` (argument: context key), ``with``
(parameters; ``@name`` is an input, ``@@`` an at sign) and ``out`` (context key, or
result: key).  Running a workflow calls the steps' functions on lazy DataFrames;
only sinks start jobs.
"""

from __future__ import annotations

import dataclasses
import hashlib
import inspect
import json
import os
import tempfile
import time
from collections.abc import Callable, Mapping
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Step:
    name: str
    run: Callable[..., Any]
    reads: tuple[str, ...]
    params: dict[str, Any]
    required: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    choices: Mapping[str, tuple] = dataclasses.field(default_factory=dict)
    sink: bool = False


REGISTRY: dict[str, Step] = {}
_ALIASES: dict[str, str] = {}


def step(name: str, *aliases: str, choices: Mapping[str, tuple] | None = None, sink: bool = False) -> Callable:
    """Register a function as a step: its positional arguments are read from the context, keyword-only ones are parameters."""

    def put(f: Callable) -> Callable:
        found = inspect.signature(f).parameters.values()
        reads = tuple(p.name for p in found if p.kind is p.POSITIONAL_OR_KEYWORD)
        keyword = [p for p in found if p.kind is p.KEYWORD_ONLY]
        REGISTRY[name] = Step(name, f, reads, {p.name: p.default for p in keyword if p.default is not p.empty}, tuple(p.name for p in keyword if p.default is p.empty), aliases, choices or {}, sink)
        _ALIASES.update(dict.fromkeys(aliases, name))
        return f

    return put


def get_step(name: str) -> Step:
    """A step by name or alias; KeyError names the unknown one."""
    name = _ALIASES.get(name, name)
    if name not in REGISTRY:
        raise KeyError(f"unknown step {name!r}")
    return REGISTRY[name]


def describe_step(name: str) -> dict:
    s = get_step(name)
    return {"name": s.name, "aliases": list(s.aliases), "in": list(s.reads), "with": s.params | dict.fromkeys(s.required), "required": list(s.required), "doc": inspect.getdoc(s.run) or "", "sink": s.sink}


def load_spec(spec: str | dict) -> dict:
    """A document from a path, YAML or JSON text, or a dict; a bare list of steps is version 0."""
    if isinstance(spec, str):
        text = spec
        if "\n" not in spec and os.path.exists(spec):
            with open(spec, encoding="utf-8") as f:
                text = f.read()
        spec = yaml.safe_load(text)
    if isinstance(spec, list):
        spec = {"version": 0, "steps": spec}
    if not isinstance(spec, dict) or not isinstance(spec.get("steps"), list):
        raise ValueError("a workflow needs a list of steps")
    if spec.get("version", 0) not in (0, 1):
        raise ValueError(f"unknown version {spec['version']!r}")
    unknown = set(spec) - {"version", "name", "inputs", "steps", "outputs", "experiment"}
    if spec.get("version") == 1 and unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    return {"version": spec.get("version", 0), "name": spec.get("name", ""), "inputs": dict(spec.get("inputs") or {}), "steps": list(spec["steps"]), "outputs": dict(spec.get("outputs") or {})}


def dump_spec(spec: dict, form: str = "yaml") -> str:
    spec = load_spec(spec)
    return json.dumps(spec, indent=2, ensure_ascii=False) if form == "json" else yaml.safe_dump(spec, sort_keys=False, allow_unicode=True)


def resolve(value: Any, inputs: Mapping[str, Any]) -> Any:
    """Replace ``@name`` by an input, at any depth; ``@@`` stands for ``@``."""
    if isinstance(value, str) and value.startswith("@@"):
        return value[1:]
    if isinstance(value, str) and value.startswith("@"):
        return inputs[value[1:]]
    if isinstance(value, list):
        return [resolve(v, inputs) for v in value]
    if isinstance(value, dict):
        return {k: resolve(v, inputs) for k, v in value.items()}
    return value


def outputs_of(position: int, s: dict) -> dict[str, str]:
    """Result name -> context key of a step; a bare string names its only result."""
    out = s.get("out", f"step_{position}")
    return out if isinstance(out, dict) else {"result": out}


def diagnose(spec: dict, available: tuple[str, ...] = ()) -> list[dict]:
    """Every problem found without running: (code, step position, message)."""
    spec, known, found = load_spec(spec), set(available), []
    tell = lambda code, at, message: found.append({"code": code, "step": at, "message": message})
    for at, s in enumerate(spec["steps"]):
        try:
            kind = get_step(s.get("step", ""))
        except KeyError as e:
            tell("unknown_step", at, str(e.args[0]))
            continue
        ins, params = s.get("in") or {}, s.get("with") or {}
        for a in ins:
            if a not in kind.reads:
                tell("unknown_input", at, f"{kind.name} has no input {a!r}")
        for a in kind.reads:
            key = ins.get(a, a)
            if key not in known:
                tell("unproduced_context_key", at, f"nothing before gives {key!r}")
        for p, v in params.items():
            if p not in kind.params and p not in kind.required:
                tell("unknown_parameter", at, f"{kind.name} has no parameter {p!r}")
            elif isinstance(v, str) and v.startswith("@") and not v.startswith("@@"):
                if v[1:] not in spec["inputs"]:
                    tell("unknown_reference", at, f"no input {v!r}")
            elif p in kind.choices and v not in kind.choices[p]:
                tell("parameter_choice", at, f"{p} must be one of {list(kind.choices[p])}")
            elif isinstance(kind.params.get(p), (int, float)) and not isinstance(kind.params[p], bool) and (isinstance(v, bool) or not isinstance(v, (int, float))):
                tell("parameter_type", at, f"{p} must be a number")
        for p in kind.required:
            if p not in params:
                tell("missing_parameter", at, f"{kind.name} needs {p!r}")
        for key in outputs_of(at, s).values():
            if key in known and key not in available:
                tell("duplicate_output", at, f"{key!r} is given twice")
            known.add(key)
    for name, key in spec["outputs"].items():
        if key not in known:
            tell("unproduced_output", None, f"output {name!r} needs {key!r}")
    return found


@dataclasses.dataclass(frozen=True)
class Call:
    position: int
    step: Step
    reads: dict[str, str]
    params: dict[str, Any]
    writes: dict[str, str]


def compile_workflow(spec: dict | str, available: tuple[str, ...] = ()) -> list[Call]:
    """Calls with defaults and references filled in; ValueError lists every problem."""
    spec = load_spec(spec)
    problems = diagnose(spec, available)
    if problems:
        raise ValueError("; ".join(f"{p['code']} (step {p['step']}): {p['message']}" for p in problems))
    calls = []
    for at, s in enumerate(spec["steps"]):
        kind = get_step(s["step"])
        calls.append(Call(at, kind, {a: (s.get("in") or {}).get(a, a) for a in kind.reads}, kind.params | resolve(s.get("with") or {}, spec["inputs"]), outputs_of(at, s)))
    return calls


def to_graph(spec: dict | str, available: tuple[str, ...] = ()) -> dict:
    """Nodes and (producer, consumer, key) edges."""
    calls, giver, edges = compile_workflow(spec, available), {}, []
    for c in calls:
        edges += [{"producer": giver[k], "consumer": c.position, "key": k} for k in c.reads.values() if k in giver]
        giver.update(dict.fromkeys(c.writes.values(), c.position))
    return {"nodes": [{"position": c.position, "step": c.step.name} for c in calls], "edges": edges, "spec": load_spec(spec)}


def from_graph(graph: dict) -> dict:
    return load_spec(graph["spec"])


def downstream(edges: DataFrame, start: int) -> DataFrame:
    """(position): the steps that a change of ``start`` reaches, itself included; a recursive query over (producer, consumer)."""
    edges.createOrReplaceTempView("workflow_edges")
    return edges.sparkSession.sql(
        f"WITH RECURSIVE reach(position) AS (SELECT {int(start)} UNION ALL SELECT DISTINCT e.consumer FROM reach r JOIN workflow_edges e ON e.producer = r.position) SELECT DISTINCT position FROM reach"
    )


class Cancelled(RuntimeError):
    """A caller asked the run to stop."""


def run_workflow(spec: dict | str, context: Mapping[str, Any], on_event: Callable[[dict], None] | None = None, cancelled: Callable[[], bool] = lambda: False) -> dict[str, Any]:
    """Run the steps in order on a copy of ``context``; returns it with all results.

    The first failure ends the run and is raised with the step's position.
    """
    values, tell = dict(context), on_event or (lambda e: None)
    for c in compile_workflow(spec, tuple(context)):
        if cancelled():
            raise Cancelled(f"cancelled before step {c.position}")
        tell({"event": "step_started", "step": c.position, "name": c.step.name})
        try:
            result = c.step.run(*[values[k] for k in c.reads.values()], **c.params)
        except Exception as e:
            tell({"event": "step_failed", "step": c.position, "error": str(e)})
            raise RuntimeError(f"step {c.position} ({c.step.name}) failed: {e}") from e
        if len(c.writes) == 1 and not isinstance(result, dict):
            result = {next(iter(c.writes)): result}
        for name, key in c.writes.items():
            values[key] = result[name]
        tell({"event": "step_finished", "step": c.position})
    return values


def write_manifest(path: str, manifest: dict) -> None:
    """Write JSON by a temporary file that replaces the old one at once; secret-looking inputs are masked."""
    inputs = {k: "***" if any(w in k.lower() for w in ("password", "token", "secret", "key")) else v for k, v in (manifest.get("inputs") or {}).items()}
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(manifest | {"inputs": inputs}, f, indent=2, default=str)
    os.replace(temp, path)


def run_spec(spec: dict | str, context: Mapping[str, Any], manifest: str | None = None) -> dict[str, Any]:
    """Run a workflow and give its named outputs; writes a manifest of the run where a path is given."""
    document, began = load_spec(spec), time.time()
    record = {"name": document["name"], "inputs": document["inputs"], "steps": [s["step"] for s in document["steps"]], "spec_sha256": hashlib.sha256(dump_spec(document, "json").encode()).hexdigest()}
    try:
        values = run_workflow(document, context)
        record["status"] = "succeeded"
        return {name: values[key] for name, key in document["outputs"].items()} or values
    except Exception as e:
        record |= {"status": "failed", "error": str(e)}
        raise
    finally:
        if manifest:
            write_manifest(manifest, record | {"duration_seconds": time.time() - began})


def input_checksums(spark, path: str) -> DataFrame:
    """(path, sha256) of input files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
