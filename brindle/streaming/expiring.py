"""Keyed state with expiry over a stream of commands (key, seq, ts_ms, op, value, arg_ms)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

REPLIES = "key string, seq bigint, op string, reply bigint, value string"
STATE = "value string, expires bigint"


def expiring_state(commands: DataFrame, drop_idle: bool = False) -> DataFrame:
    """Replies to SET, GET, DEL, EXPIRE (milliseconds from the command's time), TTL and PERSIST, in order of seq.

    State is one row per key. It is dropped when a command deletes the key or finds it expired. With ``drop_idle`` a
    timeout in processing time also drops keys that expire and get no command; such a query polls for ever, so leave it
    out of runs over what is available now.
    """
    import pandas as pd

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        there, value, expires = state.exists, *(state.get if state.exists else (None, None))
        rows = pd.concat(list(frames)).sort_values("seq")
        out, latest = [], 0
        for seq, ts, op, new, arg in zip(rows["seq"], rows["ts_ms"], rows["op"], rows["value"], rows["arg_ms"]):
            latest = int(ts)
            if there and expires is not None and expires <= latest:
                there, value, expires = False, None, None
            reply, shown = None, None
            if op == "SET":
                there, value, expires, reply = True, new, None, 1
            elif op == "GET":
                reply, shown = int(there), value
            elif op == "DEL":
                reply, there, value, expires = int(there), False, None, None
            elif op == "TTL":
                reply = -2 if not there else -1 if expires is None else expires - latest
            elif op == "PERSIST":
                reply, expires = int(there and expires is not None), None
            elif op == "EXPIRE":
                reply = int(there)
                if there:
                    expires = latest + int(arg)
                    if expires <= latest:
                        there, value, expires = False, None, None
            out.append((key[0], int(seq), op, reply, shown))
        if there:
            state.update((value, expires))
            if drop_idle and expires is not None:
                state.setTimeoutDuration(max(1, expires - latest))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "seq", "op", "reply", "value"]).astype({"reply": "Int64"})

    return commands.groupBy("key").applyInPandasWithState(handle, REPLIES, STATE, "append", "ProcessingTimeTimeout" if drop_idle else "NoTimeout")
