"""LISTEN and NOTIFY between the engines of a process."""

from __future__ import annotations

import threading
from collections import defaultdict, deque
from typing import Any


class Bus:
    """Channels with a queue for each listening engine."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._listeners: dict[str, dict[int, deque]] = defaultdict(dict)

    def listen(self, who: Any, channel: str) -> None:
        with self._lock:
            queues = [q for channels in self._listeners.values() for i, q in channels.items() if i == id(who)]
            self._listeners[channel][id(who)] = queues[0] if queues else deque()

    def unlisten(self, who: Any, channel: str) -> None:
        with self._lock:
            self._listeners[channel].pop(id(who), None)

    def send(self, channel: str, payload: str) -> None:
        with self._lock:
            for queue in self._listeners[channel].values():
                queue.append((channel, payload))

    def take(self, who: Any) -> list[tuple[str, str]]:
        with self._lock:
            queues = {id(q): q for channels in self._listeners.values() for i, q in channels.items() if i == id(who)}
            out = [x for q in queues.values() for x in q]
            for q in queues.values():
                q.clear()
            return out


BUS = Bus()
