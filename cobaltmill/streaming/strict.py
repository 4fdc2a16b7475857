"""The strict payment fold as the states of references, kept by buckets of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql.streaming.state import GroupState

FOLDED = ("reference string, status string, paid_at long, amount long, payer_chat_id long, payer_email string, "
          "already_processed long, n_events long")
#: For each reference of a bucket: the fold so far, the time of the newest event, and the events the watermark has not passed.
STATE = "references string"
_START = {"status": None, "paid_at": None, "amount": None, "chat": None, "email": None, "again": 0, "n": 0}


def _fold(state: dict, events: list[dict]) -> dict:
    """The state after further events in order of time and id."""
    state = dict(state)
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        if not state["n"]:
            state["amount"] = e.get("amount")
        state["n"] += 1
        if not e["is_success"]:
            state["status"] = "failed"
        elif state["status"] == "paid":
            state["again"] += 1
        else:
            state.update(status="paid", paid_at=e["ts"])
            state["chat"] = e.get("chat_id") if state["chat"] is None else state["chat"]
            state["email"] = e.get("payer_email") if state["email"] is None else state["email"]
    return state


def strict_folder(idle_ms: int | None) -> Callable:
    """The state function of a stream (bucket, reference, event); it forgets references idle for ``idle_ms``."""

    def settle(folded: dict, newest: int, waiting: list[dict], passed: int) -> tuple | None:
        """The state of one reference once the watermark has passed some of its events; None if it leaves."""
        if waiting:
            folded = _fold(folded, [e for e in waiting if e["ts"] <= passed * 1000])
            waiting = [e for e in waiting if e["ts"] > passed * 1000]
        if not waiting and idle_ms is not None and newest // 1000 + idle_ms <= passed:
            return None
        return folded, newest, waiting

    def due(kept: dict, passed: int) -> int | None:
        """When the bucket is looked at again without events: all that wait can settle, or a reference is idle."""
        times = [newest // 1000 + idle_ms for _, newest, _ in kept.values()] if idle_ms is not None else []
        waiting = [newest // 1000 for _, newest, events in kept.values() if events]
        times += [max(waiting) + 1] if waiting else []
        return max(min(times), passed + 1) if times else None

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        kept = json.loads(state.get[0]) if state.exists else {}
        fresh: dict[str, list[dict]] = {}
        for part in rows if not state.hasTimedOut else ():
            for reference, event in zip(part["reference"], json.loads(f"[{','.join(part['event'])}]")):
                if event["ts"] > passed * 1000:  # Spark itself drops only what the watermark of the batch before has passed
                    fresh.setdefault(reference, []).append(event)
        changed = []
        for reference, events in fresh.items():
            folded, newest, waiting = kept.get(reference, (_START, 0, []))
            waiting += events
            kept[reference] = folded, max(newest, *(e["ts"] for e in events)), waiting
            changed.append({"reference": reference, **_fold(folded, waiting)})
        if changed:
            now = pd.DataFrame(changed)
            yield pd.DataFrame({
                "reference": now["reference"], "status": now["status"],
                **{name: pd.array([c[k] for c in changed], "Int64") for name, k in (
                    ("paid_at", "paid_at"), ("amount", "amount"), ("payer_chat_id", "chat"))},
                "payer_email": now["email"], "already_processed": now["again"], "n_events": now["n"]})
        settled = ((r, settle(*own, passed)) for r, own in kept.items())
        kept = {r: own for r, own in settled if own is not None}
        if not kept:
            if state.exists:
                state.remove()
            return
        state.update((json.dumps(kept),))
        again = due(kept, passed)
        if again is not None:
            state.setTimeoutTimestamp(again)

    return step
