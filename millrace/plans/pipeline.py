"""Pipelines from configs: input, buffer, processors, output, and the resources they name."""

from __future__ import annotations

import base64
import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from millrace.operators import batches, effects, formats, lookups, rows  # noqa: F401  (registration)
from millrace.operators.envelope import PROCESSORS, ConfigError, Resources, Stream, apply_all, named
from millrace.sources import inputs, outputs

_VARIABLE = re.compile(r"\$\{([A-Za-z0-9_.]+)(?::((?:[^}\\]|\\.)*)|\|([a-z0-9_]+))?\}")


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """Environment variables: ``${NAME}``, ``${NAME:default}``, either with ``|base64decode`` at the end; line breaks in a value stay on its line."""
    env = dict(os.environ) if env is None else env

    def one(m: re.Match) -> str:
        default, _, how = (m[2] or "").rpartition("|") if "|" in (m[2] or "") else (m[2] or "", "", m[3] or "")
        value = env.get(m[1], "") or default
        if how == "base64decode":
            try:
                value = base64.b64decode(value, validate=True).decode()
            except ValueError as e:
                raise ConfigError(f"variable {m[1]} is no base64 text: {e}") from None
        elif how:
            raise ConfigError(f"unknown function {how!r} of variable {m[1]}")
        return value.replace("\n", "\\n")

    return _VARIABLE.sub(one, text)


KINDS = {"cache": "caches", "processor": "processors", "input": "inputs", "output": "outputs", "rate_limit": "rate_limits"}
TOP = ("http", "input", "buffer", "pipeline", "output", "logger", "metrics", "tracer", "shutdown_delay", "shutdown_timeout", "error_handling", "tests", "allow_commands", *[f"{k}_resources" for k in KINDS])
BUFFERS = ("none", "memory", "system_window")
#: Exporters; what they would export is observed by the plan (``Resources.observed``).
METRICS, TRACERS = ("none", "json_api", "logger"), ("none",)


@dataclass
class Template:
    """A config macro: its fields go into a mapping that makes the config."""

    name: str
    kind: str
    fields: list[dict]
    mapping: str

    def expand(self, given: dict) -> Any:
        from millrace.lang.interp import Message, run_mapping
        from millrace.lang.parser import parse

        known = {f["name"]: f for f in self.fields}
        if unknown := set(given) - set(known):
            raise ConfigError(f"template {self.name}: unknown fields {sorted(unknown)}")
        values = {}
        for name, f in known.items():
            if name in given:
                values[name] = given[name]
            elif "default" in f:
                values[name] = f["default"]
            else:
                raise ConfigError(f"template {self.name}: field {name} is missing")
        out = run_mapping(parse(self.mapping), [Message(values)], 0)
        if out is None:
            raise ConfigError(f"template {self.name} deleted its config")
        return out.content


def load_template(text: str) -> Template:
    conf = yaml.safe_load(text)
    return Template(conf["name"], conf["type"], conf.get("fields", []), conf["mapping"])


def expand(conf: Any, templates: dict[str, Template]) -> Any:
    """A config with all templates expanded."""
    if isinstance(conf, list):
        return [expand(c, templates) for c in conf]
    if not isinstance(conf, dict):
        return conf
    for name, t in templates.items():
        if name in conf and set(conf) <= {name, "label"}:
            made = expand(t.expand(conf[name] or {}), templates)
            return made | ({"label": conf["label"]} if "label" in conf else {})
    return {k: expand(v, templates) for k, v in conf.items()}


@dataclass
class Pipeline:
    config: dict
    res: Resources = field(default_factory=Resources)

    @staticmethod
    def load(text: str, spark, env: dict[str, str] | None = None, templates: list[Template] = ()) -> Pipeline:
        config = expand(yaml.safe_load(substitute(text, env)) or {}, {t.name: t for t in templates})
        return Pipeline.of(config, spark)

    @staticmethod
    def of(config: dict, spark) -> Pipeline:
        problems = lint(config)
        if problems:
            raise ConfigError("; ".join(problems))
        res = Resources(spark=spark, allow_commands=bool(config.get("allow_commands")))
        for kind, place in KINDS.items():
            for c in config.get(f"{kind}_resources") or []:
                if "label" not in c:
                    raise ConfigError(f"a {kind} resource needs a label")
                getattr(res, place)[c["label"]] = {k: v for k, v in c.items() if k != "label"}
        return Pipeline(config, res)

    def source(self) -> Stream:
        return buffered(inputs.read(self.config["input"], self.res), self.config.get("buffer"), self.res)

    def process(self, stream: Stream) -> Stream:
        return apply_all(stream, (self.config.get("pipeline") or {}).get("processors"), self.res)

    def stream(self) -> Stream:
        """The plan up to the output; nothing runs yet."""
        return self.process(self.source())

    def run(self) -> Stream:
        out = self.stream()
        if (self.config.get("error_handling") or {}).get("strategy") == "reject":
            outputs.write(out, {"reject_errored": self.config["output"]}, self.res)
        else:
            outputs.write(out, self.config.get("output") or {"drop": {}}, self.res)
        return out


def buffered(stream: Stream, conf: dict | None, res: Resources) -> Stream:
    """none, memory (batches by a policy) or system_window."""
    if not conf:
        return stream
    kind, settings, _ = named(conf)
    if kind == "none":
        return stream
    if kind == "memory":
        policy = (settings or {}).get("batch_policy") or {}
        return batches.batched(stream, policy, res) if policy.get("enabled", bool(policy)) else stream
    if kind == "system_window":
        from millrace.streaming.windows import system_window

        return system_window(stream, settings)
    raise ConfigError(f"unknown buffer {kind!r}")


def lint(config: dict) -> list[str]:
    """What is wrong with a config, without running it."""
    out = [f"unknown field {k}" for k in config if k not in TOP]

    def component(conf: Any, kinds, what: str, at: str) -> None:
        if not isinstance(conf, dict):
            out.append(f"{at}: a {what} is an object")
            return
        try:
            kind, settings, _ = named({k: v for k, v in conf.items() if k != "processors"})
        except ConfigError as e:
            out.append(f"{at}: {e}")
            return
        if kind not in kinds:
            out.append(f"{at}: unknown {what} {kind}")
        for i, p in enumerate(conf.get("processors") or []):
            component(p, PROCESSORS, "processor", f"{at}.processors.{i}")
        if kind in ("mapping", "mutation") and what == "processor":
            from millrace.lang.parser import ParseError, parse

            try:
                parse(settings, lambda path: "")
            except ParseError as e:
                out.append(f"{at}: {e}")
        inner = settings.get("processors") if isinstance(settings, dict) else settings if kind in ("try", "catch", "for_each", "processors") else None
        for i, p in enumerate(inner or []):
            if isinstance(p, dict):
                component(p, PROCESSORS, "processor", f"{at}.{kind}.{i}")

    if "input" in config:
        component(config["input"], inputs.INPUTS, "input", "input")
    if "output" in config:
        component(config["output"], outputs.OUTPUTS, "output", "output")
    if config.get("buffer"):
        component(config["buffer"], BUFFERS, "buffer", "buffer")
    for name, kinds in (("metrics", METRICS), ("tracer", TRACERS)):
        if config.get(name):
            component({k: v for k, v in config[name].items() if k != "mapping"} or {"none": {}}, kinds, name, name)
    for i, p in enumerate((config.get("pipeline") or {}).get("processors") or []):
        component(p, PROCESSORS, "processor", f"pipeline.processors.{i}")
    labels = [c.get("label") for k in KINDS for c in config.get(f"{k}_resources") or []]
    out += [f"label {x} is used twice" for x in sorted({x for x in labels if x and labels.count(x) > 1})]
    return out


def run_tests(config: dict, spark) -> list[str]:
    """The config's own tests: what failed. Each test feeds batches to the processors and states conditions for the rows that come out."""
    from millrace.lang.interp import Context, Message, evaluate
    from millrace.lang.parser import parse_expression
    from millrace.lang.values import MappingError, equal, from_json

    failed = []
    for test in config.get("tests") or []:
        pipeline = Pipeline.of({k: v for k, v in config.items() if k != "tests"}, spark)
        sent = test.get("input_batches") or [test.get("input_batch") or []]
        rows_in = [(i * 1000 + j, str(i), m.get("content") if "content" in m else yaml_json(m["json_content"]), {k: str(v) for k, v in (m.get("metadata") or {}).items()}) for i, b in enumerate(sent) for j, m in enumerate(b)]
        df = spark.createDataFrame(rows_in, "_seq long, _batch string, _content string, _meta map<string,string>")
        out = pipeline.process(Stream(df)).ensure("_meta", "_seq", "_batch")
        got = out.df.select(out.content().alias("content"), "_meta", "_batch", "_seq").orderBy("_batch", "_seq").collect()
        want = [c for b in test.get("output_batches") or [] for c in b]
        name = test.get("name", "test")
        if len(got) != len(want):
            failed.append(f"{name}: {len(got)} rows came out, {len(want)} are expected")
            continue
        for i, (g, conditions) in enumerate(zip(got, want)):
            for kind, value in conditions.items():
                try:
                    ok = {
                        "content_equals": lambda: g["content"] == value,
                        "content_matches": lambda: re.search(value, g["content"]) is not None,
                        "json_equals": lambda: equal(from_json(g["content"]), value if not isinstance(value, str) else from_json(value)),
                        "json_contains": lambda: _holds(from_json(g["content"]), value),
                        "metadata_equals": lambda: all((g["_meta"] or {}).get(k) == str(v) for k, v in value.items()),
                        "mapping": lambda: evaluate(parse_expression(value), Context([Message(g["content"], dict(g["_meta"] or {}))], new_meta=dict(g["_meta"] or {}))) is True,
                        "file_equals": lambda: g["content"] == open(value, encoding="utf-8").read(),
                        "file_json_equals": lambda: equal(from_json(g["content"]), from_json(open(value, encoding="utf-8").read())),
                        "file_json_contains": lambda: _holds(from_json(g["content"]), from_json(open(value, encoding="utf-8").read())),
                    }[kind]()
                except MappingError:
                    ok = False
                if not ok:
                    failed.append(f"{name}: row {i}: {kind} does not hold for {g['content']!r}")
    return failed


def yaml_json(v: Any) -> str:
    from millrace.lang.values import to_json

    return to_json(v)


def _holds(whole: Any, part: Any) -> bool:
    from millrace.lang.values import equal

    if isinstance(whole, dict) and isinstance(part, dict):
        return all(k in whole and _holds(whole[k], v) for k, v in part.items())
    return equal(whole, part)
