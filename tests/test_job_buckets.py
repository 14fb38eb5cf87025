"""Jobs of one bucket share a state and a timer: calls go by bucket, expiry by job."""

from pyspark.sql import Row

from patchloom.streaming.job_stream import JobProcessor

MINUTE = 60_000_000


class Held:
    """A state of one bucket that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class Timer:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    def getCurrentWatermarkInMs(self):
        return self.ms + 1


def event(job, minute, status, stage=None):
    return Row(job_id=job, us=int(minute * MINUTE), status=status, stage=stage, stage_label=None)


def test_calls_go_by_bucket_and_jobs_leave_one_by_one():
    held, processor = Held(), JobProcessor(limit_s=1800, idle_s=86_400)
    processor.init(held)
    rows = [event(job, job / 100, "running") for job in range(500)] + [event(7, 6, "completed"), event(None, 1, "queued"), event(3, 1, None)]
    made = {r["job_id"]: r for r in processor.handleInputRows((0,), iter(rows), None)}
    assert len(made) == 501 and made[7]["end_us"] == 6 * MINUTE and made[None]["started_us"] is None
    assert held.calls == 3 and held.timers == {6 * 60_000 + 1}
    assert list(processor.handleInputRows((0,), iter(rows), None)) == [] and held.calls == 4

    # an ended job leaves without a word, one past its limit is reported, the timer goes to the next
    def expire():
        [at] = held.timers
        out = list(processor.handleExpiredTimer((0,), Timer(at), Timer(at)))
        held.timers.remove(at)
        return out

    assert expire() == [] and len(held.value[0]) == 500
    [late] = expire()
    assert (late["job_id"], late["limit_us"]) == (0, 30 * MINUTE) and len(held.value[0]) == 499
    assert held.timers == {(30 * MINUTE + MINUTE // 100) // 1000 + 1}
    # a late end comes before the limit, so the timer moves on
    [moved] = processor.handleInputRows((0,), iter([event(1, 2, "failed")]), None)
    assert moved["end_status"] == "failed" and held.timers == {2 * 60_000 + 1}
