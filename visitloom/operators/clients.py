"""Calls of slow services from tasks: a bounded number in flight, retries that back off, replies in the order of the questions."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice


class Busy(Exception):
    """A reply that asks to come again, after ``wait`` seconds if it says so."""

    def __init__(self, message: str, wait: float | None = None):
        super().__init__(message)
        self.wait = wait


@dataclass(frozen=True)
class Retry:
    """Up to ``tries`` calls; the pause after each doubles from ``first`` to at most ``longest`` seconds, half of it at random so that tasks spread."""

    tries: int = 4
    first: float = 0.5
    longest: float = 30.0
    on: tuple[type[BaseException], ...] = (OSError, Busy)

    def pauses(self, seed: object = None) -> Iterator[float]:
        rng = random.Random(repr(seed))
        for k in range(self.tries - 1):
            yield min(self.longest, self.first * 2**k) * (0.5 + 0.5 * rng.random())

    def call(self, fn: Callable[[], object], seed: object = None, sleep: Callable[[float], None] = time.sleep):
        """What ``fn`` gives; the last error if no call succeeds. Errors other than those of ``on`` are not tried again."""
        for pause in self.pauses(seed):
            try:
                return fn()
            except self.on as e:
                wait = getattr(e, "wait", None)
                sleep(pause if wait is None else min(self.longest, wait))
        return fn()


def fetch(request: urllib.request.Request | str, timeout: float) -> bytes:
    """The body of a reply. A service that is overloaded or restarting (429 and 5xx) raises ``Busy``, any other refusal ``ValueError``."""
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.read()
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After", "")
        if e.code == 429 or e.code >= 500:
            raise Busy(f"status {e.code}", float(after) if after.isdigit() else None) from None
        raise ValueError(f"status {e.code}") from None


def in_order(ask: Callable[[str], object], questions: Iterable[str], in_flight: int) -> Iterator:
    """``ask`` of each question, at most ``in_flight`` at once, in the order of the questions; no more than twice as many are held."""
    if in_flight <= 1:
        yield from map(ask, questions)
        return
    waiting, rest = [], iter(questions)
    with ThreadPoolExecutor(in_flight) as pool:
        for q in islice(rest, 2 * in_flight):
            waiting.append(pool.submit(ask, q))
        while waiting:
            done = waiting.pop(0).result()
            for q in islice(rest, 1):
                waiting.append(pool.submit(ask, q))
            yield done


def healthy(url: str, wait: float = 60.0, every: float = 1.0, timeout: float = 5.0) -> bool:
    """Whether a service answers at ``url`` within ``wait`` seconds: asked before a stage that would call it from every task."""
    until = time.monotonic() + wait
    while True:
        try:
            fetch(url, timeout)
            return True
        except (OSError, Busy, ValueError):
            if time.monotonic() + every > until:
                return False
            time.sleep(every)
