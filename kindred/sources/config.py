"""Configuration: a YAML subset or a mapping, with defaults where a value is absent."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Database:
    type: str = ""
    filename: str = ""
    host: str = ""
    port: int = 5432
    user: str = ""
    password: str = ""
    dbname: str = ""
    table: str = ""
    fields: list[str] = field(default_factory=list)
    random_bits_percent: float = 0.0
    is_tokenized: bool = False
    tokenized_file: str = ""
    encryption_key: str = ""
    encryption_key_file: str = ""


# Thresholds, rate and time limits in seconds, log limits.
@dataclass
class Matching:
    hamming_threshold: int = 20
    jaccard_threshold: float = 0.32


@dataclass
class Peer:
    host: str = ""
    port: int = 0


@dataclass
class Security:
    allowed_ips: list[str] = field(default_factory=list)
    require_ip_check: bool = False
    max_connections: int = 0
    rate_limit_per_min: int = 5


@dataclass
class Timeouts:
    connection_timeout: float = 30
    read_timeout: float = 60
    write_timeout: float = 60
    idle_timeout: float = 300
    handshake_timeout: float = 30


@dataclass
class Logging:
    level: str = "info"
    file: str = ""
    max_size: int = 100
    max_backups: int = 3
    max_age: int = 30
    enable_syslog: bool = False
    enable_audit: bool = False
    audit_file: str = ""


@dataclass
class Config:
    database: Database = field(default_factory=Database)
    matching: Matching = field(default_factory=Matching)
    peer: Peer = field(default_factory=Peer)
    security: Security = field(default_factory=Security)
    timeouts: Timeouts = field(default_factory=Timeouts)
    logging: Logging = field(default_factory=Logging)
    listen_port: int = 0
    private_key: str = ""
    public_key: str = ""


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def parse_yaml(text: str) -> dict:
    """Nested mappings and lists of scalars, by indentation; no anchors, tags or multi-line scalars."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in map(_uncommented, text.splitlines()) if x.strip() and x.strip() != "---"]

    def block(at: int, indent: int) -> tuple[Any, int]:
        if at < len(lines) and lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                items.append(_scalar(lines[at][1][2:]))
                at += 1
            return items, at
        out: dict = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            key, colon, value = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"not a mapping: {lines[at][1]}")
            at += 1
            if value.strip():
                out[_scalar(key)] = _scalar(value)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                out[_scalar(key)], at = block(at, lines[at][0])
            else:
                out[_scalar(key)] = None
        return out, at

    got, at = block(0, lines[0][0] if lines else 0)
    if at != len(lines):
        raise ValueError(f"bad indentation at: {lines[at][1]}")
    return got


def _filled(kind: type, values: dict) -> Any:
    out = kind()
    known = {f.name for f in fields(kind)}
    for k, v in values.items():
        if k in known and v is not None:
            setattr(out, k, _filled(type(getattr(out, k)), v) if is_dataclass(getattr(out, k)) else v)
    return out


def load(source: str | dict) -> Config:
    """A config from YAML text or a mapping. Unknown keys are ignored; absent and null values take the default, 0 is 0."""
    return _filled(Config, parse_yaml(source) if isinstance(source, str) else source)


def load_file(path: str) -> Config:
    with open(path) as f:
        return load(f.read())
