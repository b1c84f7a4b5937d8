"""Records of calls: how long they took, whether they succeeded, and with which parameters."""

from __future__ import annotations

import functools
import inspect
import time
from collections.abc import Callable, Collection
from typing import Any

Sink = Callable[[dict[str, Any]], None]


def recorded(name: str, sink: Sink, parameters: Collection[str] = ()) -> Callable:
    """Wrap a function, or a coroutine function, so that ``sink`` gets one record a call: tool_name, success, duration_ms,
    error_message, and in metadata the named parameters that aren't None. Errors go on to the caller. A sink that fails
    doesn't make the call fail.

    Frames are lazy: wrap what runs the action, not what builds the plan."""

    def wrap(f: Callable) -> Callable:
        shape = inspect.signature(f)

        def tell(began: float, error: BaseException | None, args: tuple, kwargs: dict) -> None:
            given = shape.bind_partial(*args, **kwargs).arguments if parameters else {}
            record = {
                "tool_name": name, "success": error is None, "duration_ms": (time.perf_counter() - began) * 1000,
                "error_message": None if error is None else str(error), "metadata": {k: given[k] for k in parameters if given.get(k) is not None},
            }
            try:
                sink(record)
            except Exception:  # noqa: BLE001, S110 - a record isn't worth a call
                pass

        if inspect.iscoroutinefunction(f):

            @functools.wraps(f)
            async def later(*args, **kwargs):
                began = time.perf_counter()
                try:
                    out = await f(*args, **kwargs)
                except BaseException as e:
                    tell(began, e, args, kwargs)
                    raise
                tell(began, None, args, kwargs)
                return out

            return later

        @functools.wraps(f)
        def now(*args, **kwargs):
            began = time.perf_counter()
            try:
                out = f(*args, **kwargs)
            except BaseException as e:
                tell(began, e, args, kwargs)
                raise
            tell(began, None, args, kwargs)
            return out

        return now

    return wrap
