"""Structured logs: one JSON object a line on stderr."""

from __future__ import annotations

import json
import logging
import sys


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        extra = getattr(record, "fields", {})
        data = {"at": self.formatTime(record), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()} | extra
        if record.exc_info:
            data["error"] = self.formatException(record.exc_info)
        return json.dumps(data, default=str)


def configure(level: str = "INFO", as_json: bool = True) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(_Lines() if as_json else logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    root = logging.getLogger("runsieve")
    root.handlers[:] = [handler]
    root.setLevel(level)
    root.propagate = False


def event(logger: str, name: str, **fields) -> None:
    logging.getLogger(f"runsieve.{logger}").info(name, extra={"fields": fields})
