"""Models on the workers: loaded once in each, called in batches, with retries.

Embedders take a list of texts, rerankers questions and texts, generators (system, user)
pairs; each returns a list as long. A ``PerWorker`` wraps how one is made, so that the model
itself never travels. Calls to a service go to an address of the caller's choosing.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable

from filigree.config import SETTINGS, Settings
from filigree.operators.search import hashed_embedding

_LOADED: dict[str, Callable] = {}


class PerWorker:
    """A function that is made by make(**options) on its first call in a worker."""

    def __init__(self, make: Callable, **options) -> None:
        self.make, self.options = make, options
        self.key = f"{make.__module__}.{make.__qualname__}({sorted(options.items())!r})"

    def __call__(self, *args):
        if self.key not in _LOADED:
            _LOADED[self.key] = self.make(**self.options)
        return _LOADED[self.key](*args)


def with_retries(call: Callable, retries: int = SETTINGS.embed_max_retries, wait: float = 0.5) -> Callable:
    """call, tried again after a failure with waits that double; the last failure is raised."""

    def tried(*args):
        for attempt in range(retries + 1):
            try:
                return call(*args)
            except Exception:  # any failure of a service may pass
                if attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)

    return tried


def _post(url: str, body: dict, key_variable: str, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"}
    if key_variable:
        headers["Authorization"] = f"Bearer {os.environ[key_variable]}"
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def service_embedder(url: str, model: str, key_variable: str = "", retries: int = SETTINGS.embed_max_retries, wait: float = 0.5, timeout: float = 60.0) -> Callable:
    """Embeddings of a service that takes {model, input} and returns data with index and embedding."""

    def call(texts: list[str]) -> list[list[float]]:
        rows = _post(url, {"model": model, "input": texts}, key_variable, timeout)["data"]
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} embeddings for {len(texts)} texts")
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]

    return with_retries(call, retries, wait)


def sentence_embedder(path: str, prefix: str = "", batch: int = 32) -> Callable:
    """A local sentence model; prefix goes before each text, as some models want it for questions."""
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(path)
    return lambda texts: model.encode([prefix + t for t in texts], batch_size=batch, normalize_embeddings=True)


def pair_reranker(path: str, batch: int = 32) -> Callable:
    """A local cross encoder: scores of questions and texts."""
    from sentence_transformers import CrossEncoder

    model = CrossEncoder(path)
    return lambda questions, texts: model.predict(list(zip(questions, texts)), batch_size=batch)


def service_generator(url: str, model: str, key_variable: str = "", s: Settings = SETTINGS, retries: int = 3, wait: float = 0.5, timeout: float = 120.0) -> Callable:
    """Answers of a service that takes chat messages; the answer is a JSON object, usage gives the tokens."""

    def one(system: str, user: str) -> dict:
        body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "max_completion_tokens": s.generation_max_output_tokens, "response_format": {"type": "json_object"}}
        got = _post(url, body, key_variable, timeout)
        told, usage = json.loads(got["choices"][0]["message"]["content"]), got.get("usage", {})
        parts = {c: str(told.get(c) or "") for c in ("executive_summary", "comparison", "supporting_evidence", "confidence", "limitations")}
        return parts | {"citations": [str(c) for c in told.get("citations") or []], "input_tokens": usage.get("prompt_tokens", 0), "output_tokens": usage.get("completion_tokens", 0)}

    call = with_retries(one, retries, wait)
    return lambda prompts: [call(system, user) for system, user in prompts]


EMBEDDERS = {"hashing": lambda size=256: hashed_embedding(size), "service": service_embedder, "sentence": sentence_embedder}


def _made(kind: str, **options) -> Callable:
    return EMBEDDERS[kind](**options)


def embedder(kind: str = "hashing", **options) -> PerWorker:
    """An embedder by its kind (hashing, service or sentence), made on the workers."""
    if kind not in EMBEDDERS:
        raise ValueError(f"no embedder {kind!r}; there are {', '.join(EMBEDDERS)}")
    return PerWorker(_made, kind=kind, **options)
