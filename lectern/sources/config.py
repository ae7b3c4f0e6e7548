"""Settings from the environment, or a ``.env`` file where the environment has none."""

from __future__ import annotations

import os
from dataclasses import dataclass

ENGINES = ("dramabox", "chatterbox")  # fixed values; the first is the default


def dotenv(path: str) -> dict[str, str]:
    """``NAME=value`` lines of a file, quotes around values removed; a missing file has none."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.strip().removeprefix("export ").partition("=") for line in f)
        return {k.strip(): v.strip().strip("'\"") for k, eq, v in pairs if eq and not k.startswith("#")}


@dataclass(frozen=True)
class Settings:
    """Defaults as documented; ``read`` overrides them."""

    engine: str = ENGINES[0]
    llm_url: str = "http://127.0.0.1:1234/v1"
    llm_model: str = ""
    llm_key: str = ""
    response_format: str = "json_schema"
    context_tokens: int = 10_240
    output_tokens: int = 4_096
    llm_temperature: float = 0.1
    llm_timeout: float = 180.0
    reasoning_effort: str = ""
    tts_temperature: float = 0.8
    cfg_scale: float = 2.5
    stg_scale: float = 1.5
    steps: int = 30
    speed: float = 1.0
    seed: int = 0

    @classmethod
    def read(cls, env: dict[str, str] | None = None, file: str = ".env") -> Settings:
        env = dotenv(file) | dict(os.environ if env is None else env)
        names = {
            "engine": "TTS_ENGINE", "llm_url": "LLM_BASE_URL", "llm_model": "LLM_MODEL", "llm_key": "LLM_API_KEY", "response_format": "LLM_RESPONSE_FORMAT", "context_tokens": "LLM_CONTEXT_TOKENS",
            "output_tokens": "LLM_MAX_OUTPUT_TOKENS", "llm_temperature": "LLM_TEMPERATURE", "llm_timeout": "LLM_TIMEOUT_SECONDS", "reasoning_effort": "LLM_REASONING_EFFORT", "tts_temperature": "TTS_TEMPERATURE",
            "cfg_scale": "DRAMABOX_CFG_SCALE", "stg_scale": "DRAMABOX_STG_SCALE", "steps": "DRAMABOX_STEPS", "speed": "DRAMABOX_SPEED", "seed": "TTS_SEED",
        }
        made = cls(**{k: type(getattr(cls, k))(env[v]) for k, v in names.items() if v in env})
        if made.response_format not in ("json_schema", "json_object", "text"):
            raise ValueError("LLM_RESPONSE_FORMAT must be json_schema, json_object, or text")
        return cls(**(made.__dict__ | {"engine": engine_name(made.engine)}))


def engine_name(requested: str | None = None) -> str:
    """A known engine, whatever the case; the default for none."""
    name = (requested or ENGINES[0]).strip().lower()
    if name not in ENGINES:
        raise ValueError(f"TTS_ENGINE must be one of {', '.join(ENGINES)}")
    return name
