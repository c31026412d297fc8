"""Logging of workflows on the driver: lines on the console and, if a folder is given, in a file of their own."""

from __future__ import annotations

import logging
from datetime import UTC, datetime
from pathlib import Path

LINE = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")


def get(name: str, folder: str | None = None) -> logging.Logger:
    """The logger of that name. Asked for again it is the same, and a folder adds its file once."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not any(isinstance(h, logging.StreamHandler) and not isinstance(h, logging.FileHandler) for h in log.handlers):
        console = logging.StreamHandler()
        console.setFormatter(LINE)
        log.addHandler(console)
    if folder is not None and not any(isinstance(h, logging.FileHandler) for h in log.handlers):
        Path(folder).mkdir(parents=True, exist_ok=True)
        file = logging.FileHandler(Path(folder) / f"{name.rsplit('.', 1)[-1]}_{datetime.now(UTC):%Y%m%d_%H%M%S}.log")
        file.setFormatter(LINE)
        log.addHandler(file)
    return log
