"""Settings: built-in values, user TOML, project YAML, environment, arguments; later ones win."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "QUIRE_"


@dataclass(frozen=True)
class Settings:
    year_from: int | None = None
    year_to: int | None = None
    language: str = "en"
    output_dir: str = ""
    auto_name: bool = False
    journals_path: str = ""
    use_issn_filter: bool = False
    issn_subject_areas: str = ""
    issn_quartiles: str = ""
    issn_include_unranked: bool = True
    mailto: str = ""
    mailto_pool: str = ""
    auto_rotate: bool = False


def to_bool(value: Any) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "y", "on")


def to_csv(value: Any) -> str:
    return ", ".join(str(v).strip() for v in value if str(v).strip()) if isinstance(value, (list, tuple)) else str(value)


def _cast(name: str, value: Any) -> Any:
    kind = next(f.type for f in fields(Settings) if f.name == name)
    if kind == "bool":
        return to_bool(value)
    if kind.startswith("int"):
        return None if value in (None, "") else int(value)
    return to_csv(value)


def _known(values: Mapping[str, Any]) -> dict[str, Any]:
    names = {f.name for f in fields(Settings)}
    return {k: _cast(k, v) for k, v in values.items() if k in names and v is not None}


def read_toml(path: str | Path) -> dict[str, Any]:
    p = Path(path)
    return tomllib.loads(p.read_text(encoding="utf-8")).get("defaults", {}) if p.is_file() else {}


def read_yaml(path: str | Path) -> dict[str, Any]:
    """A flat project file: ``name: value`` lines, lists in brackets or as dashes below a name."""
    p = Path(path)
    out: dict[str, Any] = {}
    name = ""
    for raw in p.read_text(encoding="utf-8").splitlines() if p.is_file() else ():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and name:
            out[name] = [*(out[name] if isinstance(out[name], list) else []), line.strip()[2:].strip().strip("'\"")]
            continue
        name, _, value = (x.strip() for x in line.partition(":"))
        out[name] = [v.strip().strip("'\"") for v in value[1:-1].split(",")] if value.startswith("[") else value.strip("'\"")
    return out


def read_environment(environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    env = os.environ if environment is None else environment
    return {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX) and v != ""}


def resolve(user: Mapping[str, Any] = {}, project: Mapping[str, Any] = {}, environment: Mapping[str, Any] = {}, arguments: Mapping[str, Any] = {}) -> Settings:  # noqa: B006
    out = Settings()
    for layer in (user, project, environment, arguments):
        out = replace(out, **_known(layer))
    return out


@dataclass
class Accounts:
    """Named contact addresses; one is active."""

    mailtos: dict[str, str] = field(default_factory=dict)
    active: str = ""

    def add(self, name: str, mailto: str) -> None:
        self.mailtos[name] = mailto.strip()
        self.active = self.active or name

    def use(self, name: str) -> None:
        if name not in self.mailtos:
            raise KeyError(name)
        self.active = name

    def remove(self, name: str) -> bool:
        gone = self.mailtos.pop(name, None) is not None
        if self.active == name:
            self.active = next(iter(self.mailtos), "")
        return gone

    def effective(self, settings: Settings) -> str:
        return settings.mailto or self.mailtos.get(self.active, "")

    def pool(self, settings: Settings) -> list[str]:
        """The setting's pool, the active address, then the others; first occurrences."""
        every = [*settings.mailto_pool.split(","), self.effective(settings), *self.mailtos.values()]
        return list(dict.fromkeys(m.strip().lower() for m in every if m.strip()))


def rows(settings: Settings) -> list[tuple[str, str]]:
    return [(k, "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for k, v in asdict(settings).items()]
