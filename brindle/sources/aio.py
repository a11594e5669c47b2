"""The connection for asyncio: calls run in threads, as Spark jobs run elsewhere anyway."""

from __future__ import annotations

import asyncio

from brindle.sources import catalog


class _Async:
    """Awaitable methods of a wrapped object; tables and connections that they return are wrapped too."""

    def __init__(self, held):
        self._held = held

    def __getattr__(self, name: str):
        found = getattr(self._held, name)
        if not callable(found):
            return found

        async def call(*args, **how):
            return _wrapped(await asyncio.to_thread(found, *args, **how))

        return call


def _wrapped(value):
    return _Async(value) if isinstance(value, (catalog.Connection, catalog.Handle)) else value


async def connect(spark, root: str) -> _Async:
    return _wrapped(await asyncio.to_thread(catalog.connect, spark, root))
