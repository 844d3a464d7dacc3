"""What the stateful streams do with the rows of one key, one by one.

Sent to the workers by value: a stream's processors are also read by a Python process of the driver
that does not see files added to the session. So nothing of this package is used here.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def take_call(micros: int, count: int, expires: int, most: int, life_micros: int) -> tuple[bool, int, int]:
    """One call at a counter: whether it is allowed, and the counter after it."""
    if micros >= expires:
        count = 0
    if count >= most:
        return False, count, expires
    return True, count + 1, micros + life_micros


class Limiter(StatefulProcessor):
    """Allows ``most`` calls within the life of a counter, which every allowed call starts anew."""

    def __init__(self, most: int, life_micros: int, ttl_ms: int):
        self.most, self.life_micros, self.ttl_ms = most, life_micros, ttl_ms

    def init(self, handle) -> None:
        self.counter = handle.getValueState("counter", "count long, expires long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        count, expires = self.counter.get() or (0, 0)
        changed = False
        for row in rows:
            allowed, count, expires = take_call(row.micros, count, expires, self.most, self.life_micros)
            changed |= allowed
            yield Row(key=key[0], call_id=row.call_id, micros=row.micros, allowed=allowed)
        if changed:
            self.counter.update((count, expires))

    def close(self) -> None:
        pass


class LastScan(StatefulProcessor):
    """Drops a view that looks like the mailbox's scan before it."""

    def __init__(self, memory_days: int):
        self.memory_ms = memory_days * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "signature string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()
        before = last
        for row in rows:
            # the timer of a batch fires after its rows, so the end of the memory is looked at here too
            if last is None or row.signature != last[0] or row.micros // 1000 >= last[1]:
                yield Row(mailbox=row.mailbox, micros=row.micros, view_id=row.view_id, signature=row.signature)
            last = (row.signature, row.micros // 1000 + self.memory_ms)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before[1])
            self.last.update(last)
            self.handle.registerTimer(last[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Subscription(StatefulProcessor):
    """The newest key of a subscription, as long as it is active."""

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "licence_key string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.newest.get()
        newest = before
        for row in rows:
            if row.effect == "open":
                yield Row(licence_key=row.licence_key, subscription_id=row.subscription_id, status="active")
                newest = None if row.subscription_id is None else (row.licence_key,)
            elif newest is not None:
                yield Row(licence_key=newest[0], subscription_id=row.subscription_id, status="inactive")
                newest = None
        if newest != before:
            if newest is None:
                self.newest.clear()
            else:
                self.newest.update(newest)

    def close(self) -> None:
        pass
