"""Logs as lines of JSON. Messages of the library name files, counts and codes, never texts."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime

#: What every log record has; the rest are fields of the caller.
_PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        row |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row, ensure_ascii=False, default=str)


def to_json_lines(logger: str = "maskwerk", level: int = logging.INFO, stream=None) -> logging.Logger:
    """The logger, set to write lines of JSON."""
    handler, out = logging.StreamHandler(stream), logging.getLogger(logger)
    handler.setFormatter(JsonLines())
    out.handlers, out.propagate = [handler], False
    out.setLevel(level)
    return out
