"""Where users plug in: extractors, resolvers, judges and whole backends, and settings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Extractor(Protocol):
    """Citation stubs (paper_id, cite_key, claim, section, begin, end, in_table) of papers (paper_id, kind, text)."""

    def extract(self, papers: DataFrame) -> DataFrame: ...


@runtime_checkable
class Resolver(Protocol):
    """candidates(refs): a row per candidate of each reference; resolve(refs): the one that stands for each (ref_id, cand_id, method, score)."""

    def candidates(self, refs: DataFrame) -> DataFrame: ...

    def resolve(self, refs: DataFrame) -> DataFrame: ...


@runtime_checkable
class RelevanceJudge(Protocol):
    """Verdicts (paper_id, cite_key, claim_id, v as operators.relevance.verdict() has it) of requests (operators.relevance.requests())."""

    def judge(self, requests: DataFrame) -> DataFrame: ...


@runtime_checkable
class CellJudge(Protocol):
    """Answers (row keys, col_index, ord, answer, justification, confidence) on rows of a comparison table (operators.verify.row_payloads())."""

    def answer(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class Backend(Protocol):
    """A whole verification: records of stubs."""

    def verify(self, stubs: DataFrame) -> DataFrame: ...


#: A stage takes records and gives records; stages are chained by DataFrame.transform.
Stage = Callable[[DataFrame], DataFrame]
_BACKENDS: dict[str, Callable[..., Backend]] = {}


def register(name: str) -> Callable:
    """Make a backend known by a name; a name that is taken is an error."""

    def add(factory: Callable[..., Backend]) -> Callable[..., Backend]:
        if name in _BACKENDS:
            raise ValueError(f"backend {name} is registered already")
        _BACKENDS[name] = factory
        return factory

    return add


def backend(name: str, **settings) -> Backend:
    if name not in _BACKENDS:
        raise ValueError(f"no backend {name}; there are {', '.join(sorted(_BACKENDS)) or 'none'}")
    return _BACKENDS[name](**settings)


def chain(records: DataFrame, *stages: Stage) -> DataFrame:
    """Records after all stages, each of which must keep the key."""
    for stage in stages:
        after = records.transform(stage)
        lost = {"paper_id", "claim_id", "cite_key"} & set(records.columns) - set(after.columns)
        if lost:
            raise ValueError(f"{getattr(stage, '__name__', stage)} loses {', '.join(sorted(lost))}")
        records = after
    return records


@contextmanager
def progress(report: Callable[[dict], None] | None, stage: str, **facts) -> Iterator[None]:
    """Tell report when a stage begins and ends, with the seconds it took; what report raises stops nothing."""

    def say(**more) -> None:
        try:
            if report is not None:
                report({"stage": stage, **facts, **more})
        except Exception:  # noqa: BLE001 — a listener must not stop the work
            pass

    began = time.monotonic()
    say(state="begun")
    try:
        yield
    finally:
        say(state="ended", elapsed_s=round(time.monotonic() - began, 3))


def env_settings(text: str) -> dict[str, str]:
    """KEY=VALUE lines, with 'export' and quotes or without; blank lines, comments and lines without a key don't count."""
    out: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.removeprefix("export ").split("=", 1))
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            if key:
                out[key] = value[1:-1] if quoted else value
    return out


def optional(value: str | None) -> str | None:
    """A setting, or None for a blank one."""
    return (value or "").strip() or None


def truthy(value: str | None, default: bool) -> bool:
    return default if optional(value) is None else value.strip().lower() in ("1", "true", "yes", "on")


def number(value: str | None, default: float) -> float:
    try:
        return default if optional(value) is None else float(value)
    except ValueError:
        return default
