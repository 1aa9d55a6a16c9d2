"""Registration of functions and methods, also for plug-ins."""

from __future__ import annotations

import inspect
from dataclasses import dataclass
from typing import Any, Callable

from millrace.lang.values import DELETE, NOTHING, MappingError, kind

FUNCTIONS: dict[str, Spec] = {}
METHODS: dict[str, Spec] = {}


@dataclass
class Spec:
    """One function or method. ``lazy`` arguments arrive unevaluated; a ``raw`` method gets its target unevaluated too."""

    name: str
    call: Callable
    lazy: frozenset[str] = frozenset()
    raw: bool = False
    wants_ctx: bool = False
    params: tuple = ()
    is_method: bool = False
    category: str = ""
    about: str = ""

    def run(self, ctx, target: Any, args: tuple, named: tuple) -> Any:
        from millrace.lang.interp import evaluate

        given: list = []
        if self.wants_ctx:
            given.append(ctx)
        if self.is_method:
            if self.raw:
                given.append(target)
            else:
                value = evaluate(target, ctx)
                if value is DELETE or value is NOTHING:
                    raise MappingError(f"cannot call {self.name} on a {kind(value)} value")
                given.append(value)
        out: dict = {}
        rest: list = []
        it = iter(args)
        for p in self.params:
            if p.kind is inspect.Parameter.VAR_POSITIONAL:
                rest = [a if p.name in self.lazy else evaluate(a, ctx) for a in it]
                break
            if (a := next(it, None)) is not None:
                out[p.name] = a if p.name in self.lazy else evaluate(a, ctx)
        if next(it, None) is not None:
            raise MappingError(f"too many arguments for {self.name}")
        known = {p.name.rstrip("_"): p.name for p in self.params}
        for name, a in named:
            if name not in known:
                raise MappingError(f"unknown parameter {name} of {self.name}")
            out[known[name]] = a if known[name] in self.lazy else evaluate(a, ctx)
        for p in self.params:
            if p.kind is not inspect.Parameter.VAR_POSITIONAL and p.name not in out:
                if p.default is inspect.Parameter.empty:
                    raise MappingError(f"missing parameter {p.name} of {self.name}")
                out[p.name] = p.default
        return self.call(*given, *[out[p.name] for p in self.params if p.name in out], *rest)


def _register(table: dict, is_method: bool, names: tuple, lazy, raw: bool, about: str):
    def put(f: Callable) -> Callable:
        params = list(inspect.signature(f).parameters.values())
        wants_ctx = bool(params) and params[0].name == "ctx"
        params = params[wants_ctx + is_method :]
        for name in names:
            table[name] = Spec(name, f, frozenset(lazy), raw, wants_ctx, tuple(params), is_method, f.__module__.rpartition(".")[2], about or (f.__doc__ or "").strip())
        return f

    return put


def function(*names: str, lazy=(), about: str = ""):
    """Register a function; a first parameter ``ctx`` receives the context."""
    return _register(FUNCTIONS, False, names, lazy, False, about)


def method(*names: str, lazy=(), raw: bool = False, about: str = ""):
    """Register a method; its first parameter (after ``ctx``) is the target."""
    return _register(METHODS, True, names, lazy, raw, about)


def alias(new: str, old: str) -> None:
    """Let configs call a function or method by a further name."""
    from millrace.functions.columns import FUNCTION_COLUMNS, METHOD_COLUMNS, PYTHON_METHODS

    for table in (FUNCTIONS, METHODS, FUNCTION_COLUMNS, METHOD_COLUMNS, PYTHON_METHODS):
        if old in table:
            table[new] = table[old]
