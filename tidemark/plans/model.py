"""A chat model behind HTTP, held by each task: loaded before its first prompt, unloaded after its last.

Requests that the server puts off (429, 5xx) or that get no answer are asked again after
1, 2, 4, ... seconds; any other refusal fails at once.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .. import ship_by_value
from .diagnose import UNAVAILABLE, require_local


@dataclass(frozen=True)
class Model:
    base_url: str
    name: str = "llama3.2:3b"
    system: str = ""
    num_predict: int = 512
    num_ctx: int = 8192
    tries: int = 5
    timeout: float = 240.0
    allow_remote: bool = False


def post(url: str, body: dict, timeout: float, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON answer; the last error if all tries fail."""
    last: Exception = RuntimeError("no try")
    for k in range(tries):
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as e:
            e.close()
            if e.code != 429 and e.code < 500:
                raise
            last = e
        except (urllib.error.URLError, OSError) as e:
            last = e
        if k < tries - 1:
            sleep(2.0**k)
    raise last


class Session:
    """``with Session(model) as s: s.chat(prompt)``; a model that can't be loaded or unloaded is no error by itself."""

    def __init__(self, model: Model, sleep: Callable[[float], None] = time.sleep):
        self.model, self.sleep = model, sleep
        self.url = require_local(model.base_url, model.allow_remote).rstrip("/") + "/api/chat"

    def _body(self, text: str, num_predict: int, num_ctx: int, keep_alive: int) -> dict:
        said = [{"role": "system", "content": self.model.system}] if self.model.system else []
        return {
            "model": self.model.name, "stream": False, "keep_alive": keep_alive, "messages": [*said, {"role": "user", "content": text}],
            "options": {"num_predict": num_predict, "num_ctx": num_ctx},
        }

    def _touch(self, keep_alive: int) -> bool:
        try:
            post(self.url, self._body("ok", 1, 256, keep_alive), self.model.timeout, 1)
            return True
        except (OSError, ValueError):
            return False

    def __enter__(self) -> Session:
        self.loaded = self._touch(-1)
        return self

    def __exit__(self, *_) -> None:
        self._touch(0)

    def chat(self, text: str) -> str:
        body = self._body(text, self.model.num_predict, self.model.num_ctx, -1)
        answer = post(self.url, body, self.model.timeout, self.model.tries, self.sleep)
        return ((answer.get("message") or {}).get("content") or "").strip()


def asked(prompts: DataFrame, model: Model) -> DataFrame:
    """``prompts`` (key, prompt, tag) with ``answer`` and ``failure``, one session a task.

    A prompt that fails for good gets the sentinel answer and a failure "<reason>: <detail>",
    which ``analysis.failure_reasons`` counts; an empty answer fails as "empty".  Tasks without prompts load nothing.
    """
    require_local(model.base_url, model.allow_remote)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = None
        try:
            for pdf in frames:
                if session is None and len(pdf):
                    session = Session(model).__enter__()
                answers, failures = [], []
                for prompt in pdf["prompt"]:
                    try:
                        text = session.chat(prompt or "")
                        failure = None if text else "empty: no text"
                    except (OSError, ValueError) as e:
                        text, failure = "", f"{type(e).__name__}: {str(e)[:200]}"
                    answers.append(text or f"{UNAVAILABLE} {failure.split(':')[0]})")
                    failures.append(failure)
                yield pdf.assign(answer=answers, failure=pd.Series(failures, dtype=object, index=pdf.index))
        finally:
            if session is not None:
                session.__exit__()

    return prompts.select("key", "prompt", "tag").mapInPandas(run, "key string, prompt string, tag string, answer string, failure string")


ship_by_value(__name__)
