"""What a driver keeps for a while: a dictionary whose entries expire, and results of functions that do."""

from __future__ import annotations

import functools
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, MutableMapping


class TtlDict(MutableMapping):
    """Entries leave ``seconds`` after they were set, and the oldest one when there are more than ``most``."""

    def __init__(self, seconds: float, most: int = 1024, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self._entries: OrderedDict = OrderedDict()

    def _expire(self) -> None:
        while self._entries and next(iter(self._entries.values()))[1] <= self.clock() - self.seconds:
            self._entries.popitem(last=False)

    def __setitem__(self, key, value) -> None:
        self._expire()
        self._entries.pop(key, None)
        self._entries[key] = value, self.clock()
        while len(self._entries) > self.most:
            self._entries.popitem(last=False)

    def __getitem__(self, key):
        self._expire()
        return self._entries[key][0]

    def __delitem__(self, key) -> None:
        del self._entries[key]

    def __iter__(self) -> Iterator:
        self._expire()
        return iter(list(self._entries))

    def __len__(self) -> int:
        self._expire()
        return len(self._entries)


def ttl_cache(seconds: float, most: int = 1024, clock: Callable[[], float] = time.monotonic):
    """A function's results are kept for ``seconds`` by its arguments, which must be hashable; failures are not kept."""

    def wrap(f):
        kept = TtlDict(seconds, most, clock)

        @functools.wraps(f)
        def call(*args, **named):
            key = args, tuple(sorted(named.items()))
            try:
                return kept[key]
            except KeyError:
                value = kept[key] = f(*args, **named)
                return value

        call.kept = kept
        return call

    return wrap


def first_that_works(*attempts: Callable):
    """The first attempt's result that comes without an exception and is not None; the last exception, if all fail."""
    failure: Exception | None = None
    for attempt in attempts:
        try:
            if (value := attempt()) is not None:
                return value
        except Exception as e:  # noqa: BLE001  any failure asks for the next attempt
            failure = e
    if failure is not None:
        raise failure
    return None
