"""Model providers: configuration from the environment, and a transcriber over HTTP for both message styles."""

from __future__ import annotations

import base64
import json
import os
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass

from pagemill.plans.transcribe import Reply

#: Output limit, temperature, seconds for one request, and the models that take the newer name of the output limit; fixed values.
MAX_TOKENS, TEMPERATURE, REQUEST_SECONDS = 4096, 0.1, 120
NEWER_LIMIT_NAME = ("gpt-5", "o1", "o3", "o4")
#: First bytes of image formats and their MIME types.
SIGNATURES = ((b"\x89PNG", "image/png"), (b"\xff\xd8", "image/jpeg"), (b"GIF8", "image/gif"), (b"RIFF", "image/webp"))


@dataclass(frozen=True)
class Provider:
    """Where a model is reached. ``style`` is ``chat`` (choices with a message) or ``messages`` (content blocks).

    The key itself is never stored: ``key_name`` names the environment variable that holds it on the executors.
    """

    name: str
    base_url: str
    model: str
    key_name: str
    style: str = "chat"

    @classmethod
    def from_env(cls, name: str, env: Mapping[str, str] = os.environ) -> Provider:
        """Settings ``<NAME>_BASE_URL``, ``<NAME>_MODEL``, ``<NAME>_STYLE`` and ``<NAME>_API_KEY``; a missing one is an error that names it."""
        prefix = name.upper().replace("-", "_")
        missing = [k for k in (f"{prefix}_BASE_URL", f"{prefix}_MODEL", f"{prefix}_API_KEY") if not env.get(k)]
        if missing:
            raise ValueError(f"provider {name} needs {', '.join(missing)}")
        return cls(name, env[f"{prefix}_BASE_URL"].rstrip("/"), env[f"{prefix}_MODEL"], f"{prefix}_API_KEY", env.get(f"{prefix}_STYLE", "chat"))


def read_env(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """``env`` (the process's own by default) with the ``NAME=value`` lines of a file that it does not have yet, and without proxy settings, which reach local providers wrongly."""
    known = dict(os.environ if env is None else env)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, sep, value = line.strip().removeprefix("export ").partition("=")
                if sep and not name.startswith("#"):
                    known.setdefault(name.strip(), value.strip().strip("'\""))
    return {k: v for k, v in known.items() if k.lower() not in ("http_proxy", "https_proxy", "all_proxy")}


def mime_type(image: bytes) -> str:
    """The real type of image bytes, whatever a file's name says."""
    return next((t for start, t in SIGNATURES if image.startswith(start)), "application/octet-stream")


def limit_name(model: str) -> str:
    return "max_completion_tokens" if model.startswith(NEWER_LIMIT_NAME) else "max_tokens"


def chat_request(model: str, prompt: str, image: bytes, detail: str = "auto") -> dict:
    """Body of a request in chat style, the image as a data URL."""
    url = f"data:{mime_type(image)};base64,{base64.b64encode(image).decode()}"
    content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url, "detail": detail}}]
    return {"model": model, limit_name(model): MAX_TOKENS, "temperature": TEMPERATURE, "messages": [{"role": "user", "content": content}]}


def message_request(model: str, parts: list[dict]) -> dict:
    """Body of a request in messages style, from content parts in chat style."""

    def block(p: dict) -> dict:
        if p["type"] == "text":
            return p
        head, _, data = p["image_url"]["url"].partition(",")
        return {"type": "image", "source": {"type": "base64", "media_type": head.removeprefix("data:").partition(";")[0], "data": data}}

    return {"model": model, "max_tokens": MAX_TOKENS, "messages": [{"role": "user", "content": [block(p) for p in parts]}]}


def reply_of(style: str, answer: dict) -> Reply:
    """Text and token counts of an answer; what is missing is '' and 0."""
    usage = answer.get("usage") or {}
    if style == "messages":
        text = "".join(b.get("text", "") for b in answer.get("content") or [] if b.get("type") == "text")
        return Reply(text.strip(), usage.get("input_tokens") or 0, usage.get("output_tokens") or 0)
    choices = answer.get("choices") or [{}]
    text = (choices[0].get("message") or {}).get("content") or ""
    return Reply(text.strip(), usage.get("prompt_tokens") or 0, usage.get("completion_tokens") or 0)


@dataclass(frozen=True)
class HttpTranscriber:
    """Sends a job's ``image`` to a provider; usable as a ``Transcriber``."""

    provider: Provider
    detail: str = "auto"

    def __call__(self, job: dict, prompt: str) -> Reply:
        p = self.provider
        body = chat_request(p.model, prompt, bytes(job["image"]), self.detail)
        key = os.environ[p.key_name]
        if p.style == "messages":
            body = message_request(p.model, body["messages"][0]["content"])
            path, headers = "/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}
        else:
            path, headers = "/chat/completions", {"Authorization": f"Bearer {key}"}
        request = urllib.request.Request(p.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        direct = urllib.request.build_opener(urllib.request.ProxyHandler({}))
        with direct.open(request, timeout=REQUEST_SECONDS) as answer:
            return reply_of(p.style, json.load(answer))
