"""Logging on the driver."""

from __future__ import annotations

import logging
import os


class RankFormatter(logging.Formatter):
    """Adds the place where a line comes from: ``driver``, or the partition in a task."""

    def format(self, record: logging.LogRecord) -> str:
        from pyspark import TaskContext

        context = TaskContext.get()
        record.place = "driver" if context is None else f"partition {context.partitionId()}"
        return super().format(record)


def setup_logger(name: str = "porelith", folder: str | None = None) -> logging.Logger:
    """A logger to the console and, with a folder, to a file there; handlers are not doubled."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, f"{name}.log")))
    for h in handlers:
        h.setFormatter(RankFormatter("%(asctime)s %(place)s %(levelname)s %(message)s"))
        logger.addHandler(h)
    return logger


def get_logger() -> logging.Logger:
    return logging.getLogger("porelith")
