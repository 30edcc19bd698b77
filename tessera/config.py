"""Settings: defaults, a user's file, a project's file, the environment, then what the caller says."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Fixed value: how many characters a describer may be given, workers, and so on, unless told otherwise.
DEFAULTS = {"context_size": 16384, "max_tokens": 16384, "concurrency": 1, "allow_fallback": False}


@dataclass(frozen=True)
class Options:
    """What a run does: first step (1 to 4) or one step alone, fast, steps to skip, everything anew, watching."""

    from_step: int = 1
    only_step: int | None = None
    fast: bool = False
    skip: tuple[int, ...] = ()
    force: bool = False
    watch: bool = False
    interval_s: float = 0.5
    language: str = "English"
    context_size: int = 16384
    max_tokens: int = 16384
    concurrency: int = 1
    allow_fallback: bool = False

    def steps(self) -> list[int]:
        """The steps to run, in order; ``fast`` stops after the symbols."""
        wanted = [self.only_step] if self.only_step else range(self.from_step, 2 if self.fast else 5)
        return [s for s in wanted if s not in self.skip]


def _typed(value: object, like: object) -> object:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(value)
    return float(value) if isinstance(like, float) else value


def read_settings(path: str | None) -> dict:
    """A JSON file's settings; none if it is missing or broken."""
    try:
        with open(path or "") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def load(user_file: str | None = None, project_file: str | None = None, environment: Mapping[str, str] | None = None, **said) -> Options:
    """Later sources win: defaults, the user's file, the project's, TESSERA_<NAME> of the environment, the arguments.
    Unknown names are left out; a value of a wrong kind is refused."""
    environment = os.environ if environment is None else environment
    known = {f.name: f.default for f in fields(Options)}
    merged = dict(DEFAULTS)
    for source in (read_settings(user_file), read_settings(project_file), {n: environment[f"TESSERA_{n.upper()}"] for n in known if f"TESSERA_{n.upper()}" in environment}, said):
        merged |= {k: v for k, v in source.items() if k in known and v is not None}
    return Options(**{k: _typed(v, known[k]) for k, v in merged.items()})
