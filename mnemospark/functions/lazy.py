"""pandas, imported where it is first used: most queries never do, and a driver's memory is theirs."""

from __future__ import annotations

import importlib


class _Pandas:
    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(importlib.import_module("pandas"), name)


pd = _Pandas()
