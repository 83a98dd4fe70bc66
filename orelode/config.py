"""Settings from layered maps: defaults, files, local overrides, the environment."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from enum import Enum
from pathlib import Path

#: Variables of the environment (behind a prefix that the caller chooses) and the settings that they override: fixed values.
ENVIRONMENT = {
    "ENVIRONMENT": "engine.environment", "REQUEST_TIMEOUT_SECONDS": "engine.request_timeout_seconds", "MAX_CONCURRENT_REQUESTS": "engine.max_concurrent_requests",
    "RESOURCES_DIR": "paths.resources_dir", "KNOWLEDGE_DIR": "paths.knowledge_dir", "PROMPTS_DIR": "paths.prompts_dir",
    "MODEL_PROVIDER": "model.provider", "MODEL_NAME": "model.name", "MODEL_TEMPERATURE": "model.temperature", "MODEL_TOP_P": "model.top_p", "MODEL_MAX_OUTPUT_TOKENS": "model.max_output_tokens", "MODEL_TIMEOUT_SECONDS": "model.timeout_seconds", "MODEL_MAX_RETRIES": "model.max_retries",
    "LOG_LEVEL": "logging.level", "LOG_FORMAT": "logging.format", "LOG_OUTPUT": "logging.output", "LOG_FILE_PATH": "logging.file_path",
    "SECRETS_PROVIDER": "security.secrets_provider", "SECRETS_FILE": "security.secrets_file",
}
FILES = ("engine", "model", "logging", "security")
MOST_HEAT = 2.0
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def merged(base: Mapping, over: Mapping) -> dict:
    """Maps are merged key by key; all else is replaced. A null counts as absent."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def from_environment(table: Mapping[str, str], environ: Mapping[str, str] | None = None) -> dict:
    """Values of the environment under the dotted keys that the table gives their names; blank ones count as absent."""
    out: dict = {}
    for name, key in table.items():
        value = (os.environ if environ is None else environ).get(name, "").strip()
        if value:
            at = out
            *path, last = key.split(".")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
    return out


def read_yaml(path: str | Path) -> dict:
    """A YAML file that holds a map, with its ``.local.yaml`` neighbour on top of it."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs PyYAML") from error
    path = Path(path)
    out: dict = {}
    for p in (path, path.with_suffix(".local.yaml")):
        if p.exists():
            made = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
            if not isinstance(made, dict):
                raise ValueError(f"{p} holds no map")
            out = merged(out, made)
    return out


def as_bool(value, default: bool = False) -> bool:
    if value is None:
        return default
    if isinstance(value, bool):
        return value
    token = str(value).strip().lower()
    if token not in TRUE | FALSE:
        raise ValueError(f"{value!r} is not a boolean")
    return token in TRUE


def as_number(value, kind: type = int, least=None, most=None, default=None):
    if value is None:
        return default
    if isinstance(value, bool):
        raise ValueError(f"{value!r} is not a number")
    made = kind(str(value).strip())
    if least is not None and made < least or most is not None and made > most:
        raise ValueError(f"{made} is out of range")
    return made


def as_text(value, default: str | None = None) -> str | None:
    """A string; nothing else is made one."""
    if value is None:
        return default
    if not isinstance(value, str):
        raise ValueError(f"{value!r} is not a string")
    return value


def as_path(value, base: str | Path | None = None, default: Path | None = None) -> Path | None:
    """A path, with the user's folder expanded, below ``base`` unless it is absolute."""
    if value is None:
        return default
    if not isinstance(value, (str, Path)) or not str(value).strip():
        raise ValueError(f"{value!r} is not a path")
    made = Path(value).expanduser()
    return made if made.is_absolute() or base is None else Path(base) / made


def as_enum(value, kind: type[Enum], default=None):
    """The member whose value this is, whatever its case."""
    if value is None or isinstance(value, kind):
        return default if value is None else value
    token = str(value).strip().lower()
    for member in kind:
        if str(member.value).lower() == token:
            return member
    raise ValueError(f"{value!r} is none of {', '.join(str(m.value) for m in kind)}")


def as_tuple(value) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(map(str, value))


def settings(folder: str | Path, prefix: str = "", environ: Mapping[str, str] | None = None) -> dict:
    """The files of a folder with their local overrides, then the environment; a file that isn't there is empty."""
    out: dict = {}
    for name in FILES:
        out = merged(out, read_yaml(Path(folder) / f"{name}.yaml"))
    return merged(out, from_environment({prefix + k: v for k, v in ENVIRONMENT.items()}, environ))


def faults(made: Mapping, paths_exist: bool = False) -> Iterator[tuple[str, str]]:
    """(key, message) of settings that can't be used; ones that aren't stated have their defaults and pass."""
    def value(key: str, default):
        at = made
        for part in key.split("."):
            at = at.get(part) if isinstance(at, Mapping) else None
        return default if at is None else at

    limits = (
        ("engine.request_timeout_seconds", 60.0, 0, None, False), ("engine.max_concurrent_requests", 1, 1, None, True), ("model.temperature", 0.0, 0, MOST_HEAT, True), ("model.top_p", 1.0, 0, 1, False), ("model.max_output_tokens", 8192, 0, None, False), ("model.timeout_seconds", 60.0, 0, None, False),
        ("model.max_retries", 3, 0, None, True), ("model.retry_backoff_seconds", 1.0, 0, None, True), ("logging.max_bytes", 1, 0, None, False), ("logging.backup_count", 0, 0, None, True),
    )
    for key in ("engine.name", "model.provider", "model.name"):
        if not str(value(key, "x")).strip():
            yield key, "must not be empty"
    for key, default, least, most, reached in limits:
        try:
            n = as_number(value(key, default), float)
        except ValueError:
            yield key, "is not a number"
            continue
        if n < least or not reached and n == least or most is not None and n > most:
            yield key, f"must be {'at least' if reached else 'above'} {least}" + (f" and at most {most:g}" if most is not None else "")
    for key, kind, needs in (("logging.output", "file", "logging.file_path"), ("security.secrets_provider", "file", "security.secrets_file")):
        if str(value(key, "")).lower() == kind and not value(needs, None):
            yield needs, f"is needed where {key} is {kind}"
    seen = set()
    for name in as_tuple(value("security.required_secrets", ())):
        if not name.strip() or name in seen:
            yield "security.required_secrets", "has an empty name" if not name.strip() else f"has {name} twice"
        seen.add(name)
    for key in ("paths.resources_dir", "paths.knowledge_dir", "paths.prompts_dir") if paths_exist else ():
        if (path := value(key, None)) is not None and not Path(path).is_dir():
            yield key, f"no folder {path}"


def checked(made: Mapping, paths_exist: bool = False) -> Mapping:
    """The settings; all their faults are one error."""
    if found := [f"{k}: {m}" for k, m in faults(made, paths_exist)]:
        raise ValueError("; ".join(found))
    return made
