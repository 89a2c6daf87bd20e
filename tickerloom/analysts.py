"""Planner and summariser over a local language-model server; both run on the driver, once a batch."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen

# Fixed values of the server's interface.
MODEL, BASE_URL, TIMEOUT = "gemma4:e4b", "http://127.0.0.1:11434", 60.0


def post_json(url: str, payload: dict, timeout: float) -> dict:
    request = Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})  # noqa: S310
    with urlopen(request, timeout=timeout) as response:  # noqa: S310
        return json.load(response)


class LocalAnalyst:
    """plan(prompt) and summarize(prompt): the server's reply to a prompt."""

    def __init__(self, model: str = MODEL, base_url: str = BASE_URL, timeout: float = TIMEOUT, post: Callable[[str, dict, float], dict] = post_json):
        self.model, self.base_url, self.timeout, self.post = model, base_url.rstrip("/"), timeout, post

    def _ask(self, prompt: str, temperature: float, **more) -> str:
        payload = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": temperature}, **more}
        return self.post(f"{self.base_url}/api/generate", payload, self.timeout).get("response", "")

    def plan(self, prompt: str) -> str:
        return self._ask(prompt, 0, format="json")

    def summarize(self, prompt: str) -> str:
        return self._ask(prompt, 0.2).strip()
