"""Layered settings, merged on the driver: later layers win."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of the caption rewrite."""

    translation_only: bool = False
    position: str = "Forward"
    method: str = "Part"
    retries: int = 3
    wait_s: float = 0.5
    max_width: int = 40
    least_rows: int = 2
    max_encoded_length: int = 2400
    batch_rows: int = 120
    concurrency: int = 6
    queue_over: int = 24


def coerced(value):
    """Strings of settings as booleans, integers or lists; containers member by member."""
    if isinstance(value, dict):
        return {k: coerced(v) for k, v in value.items()}
    if isinstance(value, list):
        return [coerced(v) for v in value]
    if not isinstance(value, str):
        return value
    if value in ("true", "false"):
        return value == "true"
    if "," in value:
        return [coerced(v) for v in value.split(",")]
    return int(value) if value.isascii() and value.isdigit() else value


def argument_map(text: str) -> dict[str, str]:
    """``a=b&c="d"`` as a dict."""
    pairs = (part.split("=", 1) for part in text.split("&") if part)
    return {p[0]: (p[1] if len(p) > 1 else "").replace('"', "") for p in pairs}


def layered(*layers: dict) -> dict:
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return coerced(out)
