"""Names and folders of output files."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Mapping
from datetime import datetime
from pathlib import Path

#: File extensions by format.
EXTENSIONS = {"bibtex": "bib", "bib": "bib", "ris": "ris", "csv": "csv", "jsonl": "jsonl", "json": "json", "md": "md", "markdown": "md"}

#: Extension by kind of result, name by kind of result, words that name a folder.
KIND_EXTENSIONS = {"search": "json", "filter": "json", "validate": "json", "export": "bib"}
KIND_NAMES = {"search": "search_results.json", "filter": "filtered.json", "validate": "validated.json"}
HERE, DATA = ("cwd", ".", "current"), ("user_data", "user-data", "data")


def slug(text: str, limit: int = 40) -> str:
    """``slugify`` for one driver-side string."""
    words = re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKC", text or "").lower()).strip("-")
    if len(words) > limit:
        head = words[:limit]
        words = (head.rpartition("-")[0] or head if "-" in head else head).strip("-")
    return words or "search"


def auto_name(kind: str, query: str | None = None, input_path: Path | None = None, format: str | None = None, extension: str | None = None, now: datetime | None = None) -> str:
    """``search_<slug>_<time>``, ``filter_<stem>_filtered_<time>``, ``export_<stem>_<format>_<time>``, ``validate_<time>``."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    default = KIND_EXTENSIONS.get(kind, "txt")
    suffix = extension.lstrip(".") if extension else EXTENSIONS.get(format.lower(), format.lower()) if format else default
    middle = slug(query or "")
    if kind == "filter" and input_path:
        middle = f"{input_path.stem}_filtered"
    elif kind == "export" and input_path:
        middle = f"{input_path.stem}_{format or 'bib'}"
    return f"validate_{stamp}.{suffix}" if kind == "validate" else f"{kind}_{middle}_{stamp}.{suffix}"


def default_name(kind: str, format: str | None = None, extension: str | None = None) -> str:
    if kind == "export":
        return f"references.{extension.lstrip('.') if extension else EXTENSIONS.get((format or 'bibtex').lower(), 'bib')}"
    return KIND_NAMES.get(kind, "output.txt")


def output_dir(explicit: str | None = None, configured: str = "", environment: Mapping[str, str] | None = None) -> Path:
    """Argument, environment, setting, or the current folder; made if missing."""
    env = os.environ if environment is None else environment
    asked = (explicit or env.get("QUIRE_OUTPUT_DIR") or configured or "cwd").strip()
    if asked.lower() in HERE:
        return Path.cwd()
    if asked.lower() in DATA:
        return Path(env.get("XDG_DATA_HOME") or Path.home() / ".local/share") / "quire"
    path = Path.cwd() / Path(asked).expanduser()
    path.mkdir(parents=True, exist_ok=True)
    return path


def auto_naming(flag: bool | None = None, configured: bool = False, environment: Mapping[str, str] | None = None) -> bool:
    env = (os.environ if environment is None else environment).get("QUIRE_AUTO_NAME", "")
    return flag if flag is not None else env.lower() in ("true", "1", "yes", "y") if env else configured


def output_path(output: str | None = None, folder: str | None = None, configured: str = "", auto: bool = False, kind: str = "search", query: str | None = None, input_path: Path | None = None, format: str | None = None, extension: str | None = None) -> Path:
    """A file given as such, or a named file in the folder that is given or configured."""
    if output and not output.endswith("/") and not Path(output).expanduser().is_dir():
        path = Path.cwd() / Path(output).expanduser()
        path.parent.mkdir(parents=True, exist_ok=True)
        return path
    name = auto_name(kind, query, input_path, format, extension) if auto else default_name(kind, format, extension)
    return output_dir(output or folder, configured) / name
