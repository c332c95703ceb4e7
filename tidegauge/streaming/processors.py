"""Keyed state machines for Structured Streaming.

Each processor keeps a few numbers per key and handles the rows of a micro-batch in their own order, so the result does
not depend on how rows are cut into batches as long as they arrive in order.

Processors without timers (``KeyedWalk``, ``ReceiptLedger``) are called once for a bucket of many keys, whose states lie side by side in one
value: a call, a pandas table and each touch of the state cost milliseconds, which is too much for each key.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from heapq import nsmallest

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    frames = [r for r in rows if len(r)]
    return pd.concat(frames).sort_values(by, kind="stable") if frames else pd.DataFrame()


def _keys(pdf: pd.DataFrame, names: list[str]) -> list[tuple]:
    """Key of each row; a missing value is None and NaN equals NaN. Both never meet in one bucket (``streams._bucket``)."""
    return list(zip(*[pdf[n].tolist() if pdf[n].dtype.kind in "iub" else [None if v != v else v for v in pdf[n].tolist()] for n in names]))


def _load(state) -> dict:
    return pickle.loads(state.get()[0]) if state.exists() else {}


def _save(state, states: dict) -> None:
    state.update((pickle.dumps(states, pickle.HIGHEST_PROTOCOL),))


class KeyedWalk(StatefulProcessor):
    """Takes the rows of a bucket of keys one after the other, each with the state of its key.

    ``step(state, *inputs)`` gives the next state and what the row is told; ``inputs`` and ``columns`` name columns, ``made`` the new one.
    """

    def __init__(self, keys: list[str], order: list[str], inputs: list[str], columns: list[str], made: str):
        self.keys, self.order, self.inputs, self.columns, self.made = keys, order, inputs, columns, made

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getValueState("states", "packed binary")

    def step(self, state, *inputs):
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, self.order)
        if not len(pdf):
            return
        states, told = _load(self.states), []
        for k, inputs in zip(_keys(pdf, self.keys), zip(*[pdf[c].tolist() for c in self.inputs])):
            states[k], said = self.step(states.get(k), *inputs)
            told.append(said)
        _save(self.states, states)
        yield pdf[self.columns].assign(**{self.made: told})


class Spaced(KeyedWalk):
    """First row of a key and then each row at least ``gap`` after the last picked one (cooldown, first hit, thinning).

    A row whose ``reset`` flag is set is picked in any case and restarts the clock.
    """

    def __init__(self, gap: int, keys: list[str], order: list[str], columns: list[str], reset: str | None = None):
        super().__init__(keys, order, [order[0], *([reset] if reset else [])], columns, "picked")
        self.gap = gap

    def step(self, last, at, forced=False):
        take = bool(forced) or last is None or at - last >= self.gap
        return (at if take else last), take


class SpacedPicks(StatefulProcessor):
    """First row of a key and then each row at least ``gap`` after the last picked one (cooldown, first hit, thinning).

    A row whose ``always`` flag is set is picked in any case and restarts the clock. With ``forget`` (times are microseconds) a
    key's state goes as soon as the watermark is past the gap: any later row would be picked anyway.
    """

    def __init__(self, gap: int, order: list[str], columns: list[str], reset: str | None = None, forget: bool = False):
        self.gap, self.order, self.columns, self.reset, self.forget = gap, order, columns, reset, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def _armed(self, last: int) -> int:
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, self.order)
        if not len(pdf):
            return
        before = last = self.last.get()[0] if self.last.exists() else None
        always = pdf[self.reset].tolist() if self.reset else [False] * len(pdf)
        picked = []
        for at, forced in zip(pdf[self.order[0]].tolist(), always):
            take = bool(forced) or last is None or at - last >= self.gap
            if take:
                last = at
            picked.append(take)
        if last != before:
            self.last.update((int(last),))
            if self.forget:
                if before is not None:
                    self.handle.deleteTimer(self._armed(before))
                self.handle.registerTimer(self._armed(int(last)))
        yield pdf[self.columns].assign(picked=picked)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()


class FirstHit(KeyedWalk):
    """First hit per target and window since the last emitted one; a death clears it and is itself spaced."""

    def __init__(self, window: int):
        super().__init__(["target_id"], ["at", "hit_id"], ["at", "kind"], ["target_id", "at", "hit_id", "kind"], "emitted")
        self.window = window

    def step(self, state, at, kind):
        hit, death = state or (None, None)
        last = death if kind == "death" else hit
        fresh = last is None or at - last >= self.window
        if kind == "death":
            return (None, at if fresh else death), "killing_blow" if fresh else "none"
        return (at if fresh else hit, death), "first_hit" if fresh else "none"


class JournalState(KeyedWalk):
    """Applies a journal row only when its revision is above the current one; emits every row with its verdict."""

    def __init__(self, keys: list[str], order: list[str], revision: str, columns: list[str]):
        super().__init__(keys, order, [revision, "tombstone"], columns, "verdict")

    def step(self, top, revision, tombstone):
        if top is not None and revision <= top:
            return top, "stale_journal_revision"
        return revision, "tombstone" if tombstone else "delta"


class Intervals:
    """A set of whole numbers as sorted, separate ranges, first and last included."""

    def __init__(self, ranges):
        self.starts, self.ends = map(list, zip(*sorted(ranges))) if ranges else ([], [])

    def add(self, n: int) -> bool:
        """Whether ``n`` is new."""
        at = bisect_right(self.starts, n)
        if at and n <= self.ends[at - 1]:
            return False
        left, right = at > 0 and self.ends[at - 1] == n - 1, at < len(self.starts) and self.starts[at] == n + 1
        if left and right:
            self.ends[at - 1] = self.ends[at]
            del self.starts[at], self.ends[at]
        elif left:
            self.ends[at - 1] = n
        elif right:
            self.starts[at] = n
        else:
            self.starts.insert(at, n)
            self.ends.insert(at, n)
        return True


class ReceiptLedger(StatefulProcessor):
    """Receipts and acks of each (window, recipient): counts, gaps, pending, and shedding of the oldest pending rows.

    Rows of one kind and time ``us`` are one batch. A sequence acked twice in a batch counts once. If more than ``max_pending`` sequences wait
    after a batch of receipts, the oldest are shed, down to a tenth below the bound, and counted. What was seen is kept as
    ranges, so that state grows with the gaps and not with the sequences; pending ones are at most ``max_pending`` and one batch.

    A batch may go on in the next micro-batch: the state is kept as before its shedding, the status tells it as after. A recipient with
    up to ``few`` ranges has them as entries of the map ``seen``, one with more for good beside its counts, as each touch of a map is a call.
    """

    few = 4

    def __init__(self, max_pending: int):
        self.max_pending = max_pending

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: (window, recipient): counts, pending sequences, sequences named in the open batch of acks, ranges (None: in the map)
        self.ledgers = handle.getValueState("ledgers", "packed binary")
        self.seen = handle.getMapState("seen", "window_id bigint, recipient_id bigint, first bigint", "last bigint")

    def _excess(self, waiting: set) -> list[int]:
        over = len(waiting) - self.max_pending
        return nsmallest(over + max(1, self.max_pending // 10), waiting) if over > 0 else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["us", "kind", "seq", "line"])
        if not len(pdf):
            return
        touched: dict[tuple, list] = {}
        for k, row in zip(_keys(pdf, ["window_id", "recipient_id"]), zip(pdf["kind"].tolist(), pdf["seq"].tolist(), pdf["us"].tolist())):
            touched.setdefault(k, []).append(row)
        ledgers, mapped = _load(self.ledgers), {}
        if any(k in ledgers and ledgers[k][3] is None for k in touched):
            for (window, recipient, first), (last,) in self.seen.iterator():
                mapped.setdefault((window, recipient), {})[first] = last
        told = []
        for k, batch in touched.items():
            totals, waiting, named, ranges = ledgers.get(k) or ((0, 0, 0, 0, 0, None, None, 0, None, None), set(), set(), None)
            before = mapped.get(k, {}) if ranges is None else {}
            seen = Intervals(list(before.items()) if ranges is None else list(zip(*ranges)))
            totals, waiting, named = self._walk(batch, totals, set(waiting), set(named), seen)
            if ranges is None:
                ranges = None if len(seen.starts) <= self.few else ()
                now = dict(zip(seen.starts, seen.ends)) if ranges is None else {}
                _replace(self.seen, {(*k, first): last for first, last in before.items()}, {(*k, first): last for first, last in now.items()})
            ledgers[k] = totals, waiting, named, None if ranges is None else (seen.starts, seen.ends)
            receipts, duplicates, acked, unknown, shed, low, high, distinct, us, kind = totals
            excess = len(self._excess(waiting)) if kind == "receipt" else 0
            told.append((*k, receipts, distinct, duplicates, acked, unknown, shed + excess, len(waiting) - excess, low, high, max(0, (high or 0) - distinct), us))
        _save(self.ledgers, ledgers)
        names = ["window_id", "recipient_id", "receipts", "distinct_seq", "duplicates", "acked", "unknown_acks", "shed", "pending", "min_seq", "max_seq", "missing", "batch_us"]
        yield pd.DataFrame({n: pd.Series(v, dtype="Int64") for n, v in zip(names, zip(*told))})

    def _walk(self, batch: list, totals: tuple, waiting: set, named: set, seen: Intervals) -> tuple[tuple, set, set]:
        receipts, duplicates, acked, unknown, shed, low, high, distinct, open_us, open_kind = totals
        for kind, seq, us in batch:
            if (us, kind) != (open_us, open_kind):
                if open_kind == "receipt":
                    for old in self._excess(waiting):
                        waiting.discard(old)
                        shed += 1
                named, open_us, open_kind = set(), us, kind
            if kind == "ack":
                if seq not in named:
                    named.add(seq)
                    known = seq in waiting
                    waiting.discard(seq)
                    acked, unknown = acked + known, unknown + (not known)
                continue
            receipts += 1
            low, high = seq if low is None else min(low, seq), seq if high is None else max(high, seq)
            new = seen.add(seq)
            distinct, duplicates = distinct + new, duplicates + (not new)
            waiting.add(seq)
        return (receipts, duplicates, acked, unknown, shed, low, high, distinct, open_us, open_kind), waiting, named


def _replace(state, before: dict, now: dict) -> None:
    """Brings a map state from ``before`` to ``now``, touching only what changed; keys are numbers or tuples."""
    row = lambda k: k if isinstance(k, tuple) else (int(k),)
    for k in before.keys() - now.keys():
        state.removeKey(row(k))
    for k, v in now.items():
        if before.get(k) != v:
            state.updateValue(row(k), (int(v),))


class WitnessMerge(StatefulProcessor):
    """Reports of one basis from different witnesses close in time share an action number.

    Only the witnesses of the open action are kept; they go when another action opens or, by a timer, when the watermark
    (times are microseconds) is past the window, as any later report opens another one. Then a number is left per basis.
    """

    def __init__(self, window: int, columns: list[str]):
        self.window, self.columns = window, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at bigint, action bigint")
        self.heard = handle.getMapState("heard", "witness bigint", "action bigint")

    def _armed(self, at: int) -> int:
        return (at + self.window) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["at", "report_id"])
        if not len(pdf):
            return
        at_first, action = self.state.get() if self.state.exists() else (None, 0)
        before, kept = at_first, {k[0]: v[0] for k, v in self.heard.iterator()}
        witnesses, numbers = set(kept), []
        for at, witness in zip(pdf["at"].tolist(), pdf["witness"].tolist()):
            if before is None or at - before > self.window or witness in witnesses:
                action, witnesses = action + 1, set()
            before = at
            witnesses.add(witness)
            numbers.append(action)
        _replace(self.heard, kept, dict.fromkeys(witnesses, action))
        self.state.update((int(before), int(action)))
        if at_first is not None:
            self.handle.deleteTimer(self._armed(at_first))
        self.handle.registerTimer(self._armed(int(before)))
        yield pdf[self.columns].assign(action=numbers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, action = self.state.get()
        self.heard.clear()
        self.state.update((None, action))
        yield from ()


class Hysteresis(KeyedWalk):
    """Relevance of one (object, peer): enter at one radius, leave beyond a larger one. ``tick_no`` counts the object's ticks."""

    def __init__(self, enter: float, slack: float):
        super().__init__(["object_id", "peer_id"], ["tick"], ["tick_no", "distance"], ["object_id", "peer_id", "tick"], "transition")
        self.enter, self.slack = enter, slack

    def step(self, state, n, d):
        within, at = state or (False, None)
        had = within and (at is None or n - at <= 1)
        finite = d is not None and d == d and 0 <= d < float("inf")
        within = finite and d <= (self.enter + self.slack if had else self.enter)
        return (within, n), "retained" if within and had else "entered" if within else "left" if had else "outside"


class Lease(StatefulProcessor):
    """Ownership of one object: issue, validate, complete and reclaim with reasons in a fixed order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getValueState("states", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["at", "op_id"])
        if not len(pdf):
            return
        leases, epochs, reasons = _load(self.states), [], []
        for (k,), row in zip(_keys(pdf, ["object_id"]), pdf.itertuples(index=False)):
            lease, reason = self.step(leases.get(k), row)
            if lease:
                leases[k] = lease
            epochs.append(lease[0] if lease else 0)
            reasons.append(reason)
        _save(self.states, leases)
        yield pdf[["object_id", "op_id", "at", "op"]].assign(lease_epoch=epochs, reason=reasons)

    @staticmethod
    def step(lease: list | None, row) -> tuple[list | None, str]:
        if row.op == "issue":
            return [(lease[0] if lease else 0) + 1, row.run_id, row.holder, row.at + row.duration, "active"], "issued"
        if lease is None:
            return None, "lease_missing"
        epoch, run_id, holder, expires, state = lease
        if row.op == "reclaim":
            if holder == row.holder and state == "active":
                return [epoch, run_id, holder, expires, "reclaimed"], "reclaimed"
            return lease, "not_reclaimed"
        for wrong, reason in ((run_id != row.run_id, "run_mismatch"), (holder != row.holder, "holder_mismatch"),
                              (epoch != row.epoch, "epoch_mismatch"), (state != "active", "lease_" + state)):
            if wrong:
                return lease, reason
        if row.at >= expires:
            return [epoch, run_id, holder, expires, "expired"], "lease_expired"
        return [epoch, run_id, holder, expires, "completed" if row.op == "complete" else state], "accepted"


class TickWindow(StatefulProcessor):
    """Closes a window each ``n`` ticks of a stream; fewer than ``n`` ticks wait in the state."""

    def __init__(self, n: int, budget: float, order: list[str]):
        self.n, self.budget, self.order = n, budget, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = handle.getListState("ticks", "at bigint, total_ms bigint, sent bigint")
        self.count = handle.getValueState("count", "windows bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, self.order)
        if not len(pdf):
            return
        waiting = list(self.ticks.get()) if self.ticks.exists() else []
        waiting += list(zip(pdf["us"].tolist(), pdf["total_ms"].tolist(), pdf["sent"].tolist()))
        done = self.count.get()[0] if self.count.exists() else 0
        made = []
        while len(waiting) >= self.n:
            part, waiting = waiting[:self.n], waiting[self.n:]
            totals = sorted(p[1] for p in part)
            rank = lambda q: totals[max(1, -(-int(q * 100) * self.n // 100)) - 1]
            made.append((key[0], done, self.n, part[-1][0], rank(0.5), rank(0.99), totals[-1],
                         sum(t > self.budget for t in totals), sum(p[2] for p in part)))
            done += 1
        self.ticks.clear()
        for tick in waiting:
            self.ticks.appendValue(tuple(int(v) for v in tick))
        self.count.update((done,))
        yield pd.DataFrame(made, columns=["stream", "window", "samples", "end_at", "total_ms_p50", "total_ms_p99", "total_ms_max", "overruns", "sent"])


class Liveness(StatefulProcessor):
    """Life of a key: it begins with a touch and ends when its lease runs out before the next one.

    An end is told by the next touch or by an event-time timer, whichever comes first, so it does not depend on how batches are
    cut. A touch exactly at the end of the lease comes too late to prolong it and begins another life.
    """

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touches = sorted({int(ms) for r in rows for ms in r["ms"].tolist()})
        old = last = self.last.get()[0] if self.last.exists() else None
        told = []
        for ms in touches:
            if last is not None and ms <= last:
                continue
            if last is not None and ms - last >= self.lease_ms:
                told.append((key[0], last + self.lease_ms, False))
                last = None
            if last is None:
                told.append((key[0], ms, True))
            last = ms
        if last != old:
            if old is not None:
                self.handle.deleteTimer(old + self.lease_ms)
            self.handle.registerTimer(last + self.lease_ms)
            self.last.update((last,))
        if told:
            yield pd.DataFrame(told, columns=["key", "ms", "live"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame([{"key": key[0], "ms": last + self.lease_ms, "live": False}])
