"""Settings: a JSON file with defaults, literal environment files, keys with fallbacks. All of it is driver-side and small."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

#: What stands in templates where a key belongs.
PLACEHOLDERS = ("your-api-key", "your-api-key-here", "your-omlx-api-key", "your-omlx-api-key-here", "hf_replace_me")


@dataclass
class Settings:
    data: str = "data"
    collection: str = "frames"
    text_model: str | None = None
    vision_model: str | None = None
    base_url: str = "http://127.0.0.1:8000/v1"
    context: int = 32_768
    max_tokens: int = 32_768
    workers: int = 4
    options: dict[str, object] = field(default_factory=dict)


def load(path: str | None = None) -> Settings:
    """Of a JSON file, if there is one; keys that no field has are options."""
    if not path or not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    known = {x.name for x in fields(Settings)} - {"options"}
    return Settings(**{k: v for k, v in found.items() if k in known}, options={k: v for k, v in found.items() if k not in known})


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines as they stand: no substitution. Quotes around a value go; without quotes, a comment after white space does."""
    found: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        match = re.fullmatch(r"(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)", line, re.ASCII)
        if line.startswith("#") or not match:
            continue
        key, value = match.groups()
        quoted = re.fullmatch(r"(['\"])(.*)\1", value)
        found.setdefault(key, quoted[2] if quoted else re.sub(r"\s+#.*", "", value).strip())
    return found


def with_env_files(environment: Mapping[str, str], *paths: str) -> dict[str, str]:
    """The environment, with what the files add to it; what is set already wins, and of files the first."""
    merged = dict(environment)
    for path in dict.fromkeys(map(os.path.realpath, paths)):
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                merged = parse_env(f.read()) | merged
    return merged


def value_of(environment: Mapping[str, str], *names: str, placeholders: bool = True) -> str | None:
    """The first of these that is set; `placeholders`: those of templates count too."""
    unwanted = () if placeholders else PLACEHOLDERS
    told = [environment[n].strip() for n in names if environment.get(n)]
    return next(iter([v for v in told if v.lower() not in unwanted]), None)


@dataclass(frozen=True)
class Service:
    """Where the key of a kind of service stands: which of a role's own names are its, its common names, and what serves without any."""

    own: str
    common: tuple[str, ...]
    default: str | None


#: A local service of the first kind takes any key.
SERVICES = {"vllm": Service(r"VLLM_", ("VLLM_API_KEY",), "local")}
OTHER_SERVICE = Service(r"(?!VLLM_)", ("MLX_API_KEY", "OMLX_API_KEY"), None)


def role_key(environment: Mapping[str, str], configured: str | None, backend: str, *preferred: str) -> str | None:
    """The key of a role's service: as configured, or from the environment."""
    service = SERVICES.get(backend, OTHER_SERVICE)
    names = (*(n for n in preferred if re.match(service.own, n)), *service.common)
    return configured or value_of(environment, *names, placeholders=False) or service.default


def served_models(spark: SparkSession, fetch: Callable[[], dict]) -> DataFrame:
    """id: the models of a service, from the answer of its listing; none if it does not answer."""
    try:
        ids = [str(m["id"]) for m in fetch().get("data") or () if isinstance(m, dict) and m.get("id")]
    except (OSError, ValueError):
        ids = []
    return spark.createDataFrame([(x,) for x in ids], "id string")


def now() -> str:
    return datetime.now(UTC).isoformat()


def run_stamp(at: datetime | None = None) -> str:
    return (at or datetime.now()).strftime("%Y%m%d_%H%M%S")


def job_id() -> str:
    return f"sl-{uuid.uuid4().hex[:8]}"
