"""Options of a run, read from the environment on the driver only."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

LOOPBACK = ("localhost", "127.0.0.1", "::1")
# Settings and the variables that set them, the first that is set (even to nothing) counts.
BASE_URL = (("DEID_LLM_BASE_URL", "VLLM_BASE_URL", "OLLAMA_BASE_URL"), "http://localhost:11434/v1")
MODEL = (("DEID_LLM_MODEL", "VLLM_MODEL", "OLLAMA_MODEL"), "qwen3:8b")
API_KEY = (("DEID_LLM_API_KEY", "VLLM_INFERENCE_HUB_API_KEY", "OLLAMA_API_KEY"), "ollama")
TRUE = ("1", "true", "yes", "y", "on")


@dataclass(frozen=True)
class Options:
    base_url: str = BASE_URL[1]
    model: str = MODEL[1]
    api_key: str = API_KEY[1]
    provider: str = "ollama"
    allow_remote: bool = False
    low_confidence_threshold: float = 0.5
    timeout_seconds: float = 180.0

    @property
    def loopback(self) -> bool:
        return (urlsplit(self.base_url).hostname or "") in LOOPBACK


def first_set(env: Mapping[str, str], setting: tuple[tuple[str, ...], str]) -> str:
    names, default = setting
    return next((env[n] for n in names if n in env), default)


def from_env(env: Mapping[str, str] | None = None) -> Options:
    """The options, checked: the address is http or https; a host elsewhere must be allowed by DEID_ALLOW_REMOTE_LLM; models of a
    local provider that run in a cloud are refused. ValueError says what is wrong."""
    env = os.environ if env is None else env
    url = first_set(env, BASE_URL).rstrip("/")
    provider = (env.get("DEID_LLM_PROVIDER") or ("vllm" if env.get("VLLM_BASE_URL") else "ollama")).strip().lower()
    options = Options(url, first_set(env, MODEL), first_set(env, API_KEY), provider, env.get("DEID_ALLOW_REMOTE_LLM", "").strip().lower() in TRUE, float(env.get("DEID_LOW_CONFIDENCE_THRESHOLD", 0.5)), float(env.get("DEID_REQUEST_TIMEOUT_SECONDS", 180)))
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"the model's address must begin with http:// or https://: {url}")
    if not options.loopback and not options.allow_remote:
        raise ValueError("the model's address is on another host; set DEID_ALLOW_REMOTE_LLM=true to allow that")
    if provider == "ollama" and options.model.lower().endswith("-cloud"):
        raise ValueError("the model runs in a cloud; choose a local one")
    return options


def template(local: bool = False) -> str:
    """Contents of a settings file to start from."""
    if local:
        return "DEID_ALLOW_REMOTE_LLM=false\nOLLAMA_BASE_URL=http://localhost:11434/v1\nOLLAMA_MODEL=qwen3:8b\nOLLAMA_API_KEY=ollama\nDEID_REQUEST_TIMEOUT_SECONDS=180\nDEID_LOW_CONFIDENCE_THRESHOLD=0.5\n"
    return "DEID_ALLOW_REMOTE_LLM=true\nVLLM_BASE_URL=http://model-server.example/v1\nVLLM_MODEL=large\nVLLM_INFERENCE_HUB_API_KEY=replace-with-issued-key\nDEID_REQUEST_TIMEOUT_SECONDS=180\nDEID_LOW_CONFIDENCE_THRESHOLD=0.5\n"


def read_settings_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines and those beginning with # are skipped. A file that isn't there holds nothing."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {a.strip(): b.strip().strip("'\"") for a, b in pairs}
