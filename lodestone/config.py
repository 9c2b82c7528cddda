"""Configuration: files from the most general place to the most particular, then the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from lodestone.errors import InvalidArgs

OUTPUTS = ("json", "table", "csv")


@dataclass
class Config:
    output: str | None = None
    threads: int | None = None


def _layer(path: Path) -> dict:
    import yaml

    if not path.is_file():
        return {}
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except (yaml.YAMLError, OSError) as e:
        raise InvalidArgs(f"malformed config at {path}", "fix its syntax or permissions") from e
    if not isinstance(data, dict) or data.get("output", OUTPUTS[0]) not in OUTPUTS or not isinstance(data.get("threads", 1), int):
        raise InvalidArgs(f"malformed config at {path}", f"output is one of {', '.join(OUTPUTS)}, threads a number")
    return data


def load(start: str | Path = ".", env: dict[str, str] | None = None) -> Config:
    env = dict(os.environ) if env is None else env
    paths = [Path(env[k]) / rest for k, rest in (("HOME", ".config/lodestone/config.yaml"), ("XDG_CONFIG_HOME", "lodestone/config.yaml")) if env.get(k)]
    out = Config()
    for path in [*paths, Path(start) / ".lodestone/config.yaml", Path(start) / "lodestone.yaml"]:
        data = _layer(path)
        out.output, out.threads = data.get("output", out.output), data.get("threads", out.threads)
    if env.get("LODESTONE_OUTPUT") in OUTPUTS:
        out.output = env["LODESTONE_OUTPUT"]
    if env.get("LODESTONE_THREADS", "").isdigit():
        out.threads = int(env["LODESTONE_THREADS"])
    return out
