"""The retry stream's state is accessed by the call, not by the request."""

from __future__ import annotations

import pandas as pd

from evalframe.operators.respond import RETRYABLE, DownResponder
from evalframe.streaming import retries as RT


class _Map:
    def __init__(self):
        self.held, self.accesses = {}, 0

    def iterator(self):
        self.accesses += 1
        return iter(list(self.held.items()))

    def _one(self, f):
        self.accesses += 1
        return f()

    def containsKey(self, k):
        return self._one(lambda: k in self.held)

    def updateValue(self, k, v):
        self._one(lambda: self.held.__setitem__(k, v))

    def removeKey(self, k):
        self._one(lambda: self.held.pop(k))


class _Handle:
    def __init__(self):
        self.map, self.timers = _Map(), []

    def getMapState(self, *_):
        return self.map

    def listTimers(self):
        return iter([(t,) for t in self.timers])

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class _At:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _lane(batch_size=100):
    p = RT.RetryProcessor(DownResponder, 10.0, 2.0, 0.001, batch_size, tuple(RETRYABLE))
    handle = _Handle()
    p.init(handle)
    return p, handle


def _requests(names, most=3, payload="{}"):
    return iter([pd.DataFrame({"request": names, "payload": [payload] * len(names), "most": [most] * len(names)})])


def _run_out(p, handle, out):
    while handle.timers:
        out += list(p.handleExpiredTimer(None, _At(handle.timers[0]), None))
    return pd.concat(out)


def test_accesses_grow_with_calls():
    names = [f"r{i}" for i in range(1_000)]
    p, handle = _lane(1_000)
    rows = _run_out(p, handle, list(p.handleInputRows(None, _requests(names), _At(0))))
    assert handle.map.accesses < 50 and not handle.map.held
    tries = rows[rows["kind"] == RT.ATTEMPT]
    assert len(tries) == 3_000 and sorted(set(tries["at_ms"])) == [0, 10, 30]
    dead = rows[rows["kind"] == RT.DEAD]
    assert sorted(dead["request"]) == sorted(names) and set(dead["attempts"]) == {3} and set(dead["waited_s"]) == {30.0}


def test_pending_requests_of_equal_key_are_one():
    p, handle = _lane(2)
    out = list(p.handleInputRows(None, _requests(["a", "b", "a", "c"]), _At(0)))
    out += list(p.handleInputRows(None, _requests(["c", "d"]), _At(5)))
    rows = _run_out(p, handle, out)
    assert sorted(zip(rows["request"], rows["attempt"])) == sorted((r, n) for r in "abcd" for n in (1, 2, 3, 3))


def test_entries_are_of_bounded_size(monkeypatch):
    monkeypatch.setattr(RT, "ENTRY_CHARS", 100)
    p, handle = _lane()
    out = list(p.handleInputRows(None, _requests([f"r{i}" for i in range(10)], 2, '{"prompt": "' + "x" * 60 + '"}'), _At(0)))
    assert len(handle.map.held) == 10
    assert (_run_out(p, handle, out)["kind"] == RT.DEAD).sum() == 10
