"""Things that a Python worker keeps from one task to the next: automata, tokenizers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(key: tuple, make: Callable):
    """make() once per worker process and key; the last few keys are held."""
    box = sys.modules.setdefault("_kilnmark_worker", types.ModuleType("_kilnmark_worker")).__dict__.setdefault("kept", {})
    if key not in box:
        while len(box) >= 4:
            box.pop(next(iter(box)))
        box[key] = make()
    return box[key]
