"""Batch questions to a chat-completion server."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYSTEM_TEXT = "You answer questions about one codebase."
OUT = "question string, answer string, usage string, model string, error string"


def _post(url: str, body: dict, timeout: float) -> dict:
    req = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(req, timeout=timeout) as r:
        return json.load(r)


# The paths and keys of the wire format, /v1/chat/completions, /v1/models and /health.
class QueryClient:
    """One server; a failed call returns a record with an error, it does not raise."""

    def __init__(self, base_url: str = "http://localhost:8000", model: str = "default", timeout: float = 60, post: Callable[[str, dict, float], dict] = _post):
        self.base_url, self.model, self.timeout, self.post = base_url.rstrip("/"), model, timeout, post

    def query(self, question: str, max_tokens: int = 512, temperature: float = 0.3, top_p: float = 0.9) -> dict:
        messages = [{"role": "system", "content": SYSTEM_TEXT}, {"role": "user", "content": question}]
        body = {"model": self.model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature, "top_p": top_p}
        try:
            got = self.post(f"{self.base_url}/v1/chat/completions", body, self.timeout)
            return {"question": question, "answer": got["choices"][0]["message"]["content"], "usage": json.dumps(got.get("usage", {})), "model": got.get("model", self.model), "error": None}
        except Exception as e:  # noqa: BLE001  errors are part of the record
            return {"question": question, "answer": None, "usage": None, "model": None, "error": f"{type(e).__name__}: {e}"}

    def health_check(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.base_url}/health", timeout=5) as r:
                return r.status == 200
        except OSError:
            return False

    def get_models(self) -> list[str]:
        try:
            with urllib.request.urlopen(f"{self.base_url}/v1/models", timeout=5) as r:
                return [m["id"] for m in json.load(r).get("data", [])]
        except OSError:
            return []


def ask(prompts: DataFrame, make_client: Callable[[], QueryClient], column: str = "question", **options: float) -> DataFrame:
    """One record a prompt; a client a task, so the calls run in parallel."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for part in parts:
            rows = [client.query(q, **options) for q in part[column]]
            yield pd.DataFrame(rows, columns=["question", "answer", "usage", "model", "error"])

    return prompts.select(column).mapInPandas(run, OUT)
