"""Remote embedders, language models and routing models, as request bodies and answers over a transport that is given.

The transport takes a URL, headers and a JSON body and returns the answer's JSON; ``post_json`` is one. Models of a provider
differ in where they send what and where the answer holds the text, which is all that a ``Provider`` says.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from .agents import parse_decision
from .base import InvalidArgument
from .contracts import LanguageModel, Post
from .retrieval import echo, stream


def post_json(url: str, headers: dict[str, str], body: dict[str, Any], seconds: float = 60) -> dict[str, Any]:
    """The answer to a JSON body; an answer that is no JSON object is an error, and so is silence of ``seconds``."""
    if not url.startswith(("http://", "https://")):
        raise InvalidArgument(f"not a web address: {url}")
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=seconds) as r:
        out = json.loads(r.read())
    if not isinstance(out, dict):
        raise InvalidArgument("the answer is no JSON object")
    return out


def _dig(answer: Any, *path: str | int) -> Any:
    for p in path:
        try:
            answer = answer[p]
        except (KeyError, IndexError, TypeError):
            return None
    return answer


def _vectors(items: list[Any]) -> list[list[float]]:
    if not all(isinstance(v, list) for v in items):
        raise InvalidArgument("an embedding is missing in the answer")
    return [[float(x) for x in v] for v in items]


@dataclass(frozen=True)
class OpenAI:
    """Also anything else that speaks this interface, at another ``base``."""

    key: str
    chat_model: str = "gpt-4o-mini"
    embedding_model: str = "text-embedding-3-small"
    base: str = "https://api.openai.com/v1"

    def __post_init__(self) -> None:
        if not self.key:
            raise InvalidArgument("a key is needed")

    def _send(self, post: Post, what: str, body: dict) -> dict:
        return post(f"{self.base.rstrip('/')}/{what}", {"Authorization": f"Bearer {self.key}"}, body)

    def embed(self, post: Post, texts: list[str]) -> list[list[float]]:
        data = _dig(self._send(post, "embeddings", {"model": self.embedding_model, "input": texts}), "data")
        if not isinstance(data, list):
            raise InvalidArgument("the answer has no data")
        return _vectors([_dig(x, "embedding") for x in data])

    def chat(self, post: Post, messages: list[dict], options: dict) -> str:
        answer = self._send(post, "chat/completions", {"model": self.chat_model, "messages": messages, **options})
        return str(_dig(answer, "choices", 0, "message", "content") or "")

    def routing_options(self) -> dict:
        return {"temperature": 0.1}


@dataclass(frozen=True)
class Azure:
    key: str
    endpoint: str
    deployment: str
    version: str = "2024-02-15-preview"

    def __post_init__(self) -> None:
        if not (self.key and self.endpoint and self.deployment):
            raise InvalidArgument("a key, an endpoint and a deployment are needed")

    def _send(self, post: Post, what: str, body: dict) -> dict:
        url = f"{self.endpoint.rstrip('/')}/openai/deployments/{quote(self.deployment, safe='')}/{what}?api-version={quote(self.version, safe='')}"
        answer = post(url, {"api-key": self.key}, body)
        if isinstance(error := _dig(answer, "error"), dict):
            raise InvalidArgument(f"the request failed ({error.get('code', 'unknown')}): {error.get('message', '')}")
        return answer

    def embed(self, post: Post, texts: list[str]) -> list[list[float]]:
        data = _dig(self._send(post, "embeddings", {"input": texts}), "data")
        if not isinstance(data, list):
            raise InvalidArgument("the answer has no data")
        return _vectors([_dig(x, "embedding") for x in data])

    def chat(self, post: Post, messages: list[dict], options: dict) -> str:
        return str(_dig(self._send(post, "chat/completions", {"messages": messages, **options}), "choices", 0, "message", "content") or "")

    def routing_options(self) -> dict:
        """Small deployments take no temperature but 1."""
        return {"temperature": 1 if any(x in self.deployment.lower() for x in ("mini", "nano")) else 0.1}


@dataclass(frozen=True)
class Ollama:
    chat_model: str = "llama3.1"
    embedding_model: str = "nomic-embed-text"
    base: str = "http://localhost:11434"

    def embed(self, post: Post, texts: list[str]) -> list[list[float]]:
        """A request for each text: the interface takes one."""
        url = f"{self.base.rstrip('/')}/api/embeddings"
        return _vectors([_dig(post(url, {}, {"model": self.embedding_model, "prompt": t}), "embedding") for t in texts])

    def chat(self, post: Post, messages: list[dict], options: dict) -> str:
        """Options aren't passed on."""
        return str(_dig(post(f"{self.base.rstrip('/')}/api/chat", {}, {"model": self.chat_model, "stream": False, "messages": messages}), "message", "content") or "")

    def routing_options(self) -> dict:
        return {}


Provider = OpenAI | Azure | Ollama


@dataclass(frozen=True)
class RemoteEmbedder:
    """``embed`` goes with ``retrieval.remote_embed`` for tables."""

    provider: Provider
    post: Post = post_json

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.provider.embed(self.post, texts)

    def embed_query(self, text: str) -> list[float]:
        return next(iter(self.embed([text])), [])


@dataclass(frozen=True)
class RemoteModel:
    provider: Provider
    post: Post = post_json

    def generate(self, prompt: str, temperature: float = 0.2, max_tokens: int = 700) -> str:
        return self.provider.chat(self.post, [{"role": "user", "content": prompt}], {"temperature": temperature, "max_tokens": max_tokens})


@dataclass(frozen=True)
class EchoModel:
    def generate(self, prompt: str, **options: Any) -> str:
        return echo(prompt)

    def stream(self, prompt: str, **options: Any) -> Iterator[str]:
        yield from stream(echo(prompt))


@dataclass(frozen=True)
class RemoteRouter:
    """A model that decides on tools, for ``agents.RoutingAgent``."""

    provider: Provider
    post: Post = post_json

    def __call__(self, messages: list[dict], tools: dict) -> dict:
        return parse_decision(self.provider.chat(self.post, routing_messages(messages, tools), self.provider.routing_options()))


def routing_messages(messages: list[dict], tools: dict) -> list[dict]:
    """The tools and the form of an answer first; results of tools come back as said by the assistant."""
    names = "\n".join(f"- {t.name}: {t.description}" for t in tools.values())
    form = '{"type": "tool_call", "tool": NAME, "input": {...}} or {"type": "final", "content": TEXT}'
    out = [{"role": "system", "content": f"Pick a tool or answer. Tools:\n{names}\n\nReply with one JSON object and nothing else: {form}"}]
    for m in messages:
        if m["role"] == "tool":
            out.append({"role": "assistant", "content": f"TOOL_RESULT: {m['content']}"})
        else:
            out.append({"role": m["role"] if m["role"] in ("system", "user", "assistant") else "user", "content": m["content"]})
    return out


def model_from(settings: Mapping[str, str] | None = None, provider: str | None = None, post: Post = post_json) -> LanguageModel:
    """The model that settings (the environment, if not given) name in RAG_LLM_PROVIDER: openai, azure or ollama, else the echo."""
    s = os.environ if settings is None else settings
    match (provider or s.get("RAG_LLM_PROVIDER", "") or "echo").strip().lower():
        case "openai":
            return RemoteModel(OpenAI(s.get("OPENAI_API_KEY", ""), s.get("OPENAI_CHAT_MODEL") or OpenAI.chat_model), post)
        case "azure":
            return RemoteModel(Azure(s.get("AZURE_OPENAI_API_KEY", ""), s.get("AZURE_OPENAI_ENDPOINT", ""), s.get("AZURE_OPENAI_CHAT_DEPLOYMENT", ""), s.get("AZURE_OPENAI_API_VERSION") or Azure.version), post)
        case "ollama":
            return RemoteModel(Ollama(s.get("OLLAMA_MODEL") or Ollama.chat_model, base=s.get("OLLAMA_BASE_URL") or Ollama.base), post)
        case _:
            return EchoModel()
