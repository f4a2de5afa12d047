"""Models behind an interface: called once per row in executor workers, with a deterministic stand-in."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Echo:
    """Canned replies by model name, else the first 100 characters of the prompt."""

    def __init__(self, canned: dict[str, str] | None = None):
        self.canned = canned or {}

    def chat(self, model: str, messages: list[dict], temperature: float = 0.0) -> str:
        return self.canned.get(model) or f"[{model}] {messages[-1]['content'][:100]}"


@dataclass
class Http:
    """A server that speaks one of the two usual chat formats; the key comes from the environment variable named in key_from."""

    url: str
    openai: bool = True
    key_from: str = "LLM_API_KEY"
    timeout: float = 300.0

    def chat(self, model: str, messages: list[dict], temperature: float = 0.0) -> str:
        body = {"model": model, "messages": messages} | ({"temperature": temperature} if self.openai else {"stream": False, "options": {"temperature": temperature}})
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[self.key_from]}"} if self.key_from in os.environ else {})
        path = "/chat/completions" if self.openai else "/api/chat"
        with urllib.request.urlopen(urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
            got = json.load(r)
        return got["choices"][0]["message"]["content"] if self.openai else got["message"]["content"]


@dataclass
class Settings:
    """Mode and models, from the environment unless given."""

    mode: str = field(default_factory=lambda: os.environ.get("LLM_MODE", "mock"))
    model: str = field(default_factory=lambda: os.environ.get("LLM_MODEL", "default"))
    url: str = field(default_factory=lambda: os.environ.get("LLM_URL", "http://localhost:11434"))

    def client(self):
        return Echo() if self.mode == "mock" else Http(self.url, openai=self.mode != "ollama")

    def model_of(self, stage: str) -> str:
        """The model of a stage: what the environment names for it, else that of all."""
        return os.environ.get(f"LLM_MODEL_{stage.upper()}") or self.model


def ask(client, model: str, text: str | None, retries: int = 2, accept: Callable[[str], bool] = bool, system: str | None = None, stricter: str = "", temperature: float = 0.0, pause: float = 0.0) -> tuple[str | None, int, str | None]:
    """(reply, attempts, error) of one request; after a failure, not a refusal, it waits `pause` seconds, twice as long each time, a minute at most."""
    reply, error, tried, failed = None, None, 0, 0
    while tried <= retries and (reply is None or not accept(reply)):
        tried += 1
        try:
            messages = [{"role": "user", "content": (text or "") + (stricter if tried > 1 else "")}]
            reply, error = client.chat(model, [{"role": "system", "content": system}, *messages] if system else messages, temperature), None
        except Exception as e:  # a failed call is a row's error, not the job's
            error = str(e)
            if tried <= retries and pause:
                time.sleep(min(pause * 2**failed, 60.0))
            failed += 1
    return reply, tried, error


def call(df: DataFrame, make_client: Callable[[], object], model: str, prompt: str = "prompt", retries: int = 2, accept: Callable[[str], bool] = bool, system: str | None = None, stricter: str = "", temperature: float = 0.0) -> DataFrame:
    """df with reply, attempts and error. One client per task; a reply that accept() refuses is asked for again, up to `retries` times, with the text `stricter` after the prompt. Write the result before using it twice, so that no call is made again."""
    others = [c for c in df.columns if c not in ("reply", "attempts", "error")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(frames):
        client = make_client()
        for frame in frames:
            made = [ask(client, model, text, retries, accept, system, stricter, temperature) for text in frame[prompt]]
            frame = frame[others].copy()
            frame["reply"], frame["attempts"], frame["error"] = ([m[k] for m in made] for k in range(3))
            yield frame

    return df.mapInPandas(run, f"{schema}, reply string, attempts int, error string")
