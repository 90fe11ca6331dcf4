"""The library's messages: a bounded log in the driver's memory that can be read and emptied."""

from __future__ import annotations

import logging
from collections import deque

#: Messages that are kept.
KEPT = 1000
_lines: deque[str] = deque(maxlen=KEPT)


class _Keeper(logging.Handler):
    def emit(self, record: logging.LogRecord) -> None:
        _lines.append(self.format(record))


logger = logging.getLogger("vecquill")
if not any(isinstance(h, _Keeper) for h in logger.handlers):
    _keeper = _Keeper()
    _keeper.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    logger.addHandler(_keeper)
    logger.setLevel(logging.INFO)
    logger.propagate = False


def get_log() -> str:
    return "\n".join(_lines)


def reset_log() -> None:
    _lines.clear()
