"""How often a replay calls its state: each call is a message to another process."""

import datetime

from tallyforge.streaming.states import BoardStates, Replay


class Counted:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    put = update

    def clear(self):
        self.value = None


class Names(Counted):
    def __init__(self):
        super().__init__()
        self.value = {}

    def containsKey(self, key):
        self.calls += 1
        return key in self.value

    def updateValue(self, key, value):
        self.calls += 1
        self.value[key] = value


class Handle:
    def __init__(self):
        self.states = []

    def _new(self, state):
        self.states.append(state)
        return state

    def getValueState(self, *_):
        return self._new(Counted())

    def getListState(self, *_):
        return self._new(Counted())

    def getMapState(self, *_):
        return self._new(Names())

    def registerTimer(self, _):
        pass


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_calls_do_not_grow_with_events():
    handle, replay = Handle(), Replay(BoardStates, "k")
    replay.init(handle)
    start = datetime.datetime(2024, 1, 1)
    rows = [{"seq": n, "ts": start + datetime.timedelta(seconds=n), "kind": "lot", "page": 1, "at": n, "of": 500, "lot": f"lot {n % 3}", "message": ""} for n in range(500)]
    told = list(replay.handleInputRows((1,), iter(rows), At(0)))[0]
    assert told["lots"] == 3 and told["rows_landed"] == 499
    list(replay.handleExpiredTimer((1,), At(int(rows[-1]["ts"].timestamp() * 1000)), None))
    told = list(replay.handleInputRows((1,), iter([{**rows[0], "seq": 500, "ts": start + datetime.timedelta(days=1), "lot": "lot 1"}]), At(0)))[0]
    assert told["lots"] == 3 and sum(s.calls for s in handle.states) < 30
