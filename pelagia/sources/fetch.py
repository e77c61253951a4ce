"""Calls to remote backends, tried again when that can help. The transport is injected."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from ..errors import NotFound, ToolError

#: Statuses worth another try, number of tries, and the first pause in seconds; each next pause is twice as long.
RETRYABLE = (429, 500, 502, 503, 504)
TRIES, PAUSE = 3, 0.75


def detail(body: str) -> str:
    """The detail of a JSON error, or the text."""
    try:
        found = json.loads(body)
    except ValueError:
        return body
    return str(found["detail"]) if isinstance(found, dict) and "detail" in found else body


def retrying(get: Callable[[dict], tuple[int, str]], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Callable[[dict], str]:
    """``get`` returns a status and a body, or raises OSError; the result returns the body of a success."""

    def fetch(params: dict) -> str:
        said = ""
        for k in range(tries):
            try:
                status, body = get(params)
            except OSError as e:
                said = f"Backend request failed: {e}"
            else:
                if status < 400:
                    return body
                if status == 404:
                    raise NotFound(detail(body))
                said = f"Backend error ({status}): {detail(body)}"
                if status not in RETRYABLE:
                    raise ToolError(said, status)
            if k + 1 < tries:
                sleep(pause * 2**k)
        raise ToolError(said)

    return fetch
