"""Timed sessions without Spark: what is kept, and how often state is asked for."""

import random

import pandas as pd

from kestrelq.streaming.timers import TimedSessions


class State:
    def __init__(self):
        self.rows, self.calls, self.timers = None, 0, []

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.rows is not None

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_calls_for_state_follow_buckets_and_not_users():
    rng, state = random.Random(4), State()
    rows = [(rng.choice([None, *range(300)]), pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rng.randrange(40_000))) for _ in range(3000)]
    frames = [pd.DataFrame(rows[k : k + 700], columns=["user_id", "ts"]) for k in range(0, 3000, 700)]
    sessions = TimedSessions(1800)
    sessions.init(state)
    for part in (frames[:2], frames[2:]):
        assert list(sessions.handleInputRows((0,), iter(part), None)) == []
    want, last = [], None
    for u, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if last and last[0] == u and t < last[2]:
            last[2], last[3] = t + sessions.gap, last[3] + 1
        else:
            last = [u, t, t + sessions.gap, 1]
            want.append(last)
    assert sorted(map(tuple, state.rows), key=str) == sorted(((u, a.to_pydatetime(), b.to_pydatetime(), n) for u, a, b, n in want), key=str)
    assert state.calls < 12 and min(state.timers) == int(min(w[2] for w in want).timestamp() * 1000) + 1
