"""Logs of a session on the driver (S14): a folder a run, files that come into being with their first line."""

from __future__ import annotations

import logging
from datetime import datetime
from pathlib import Path


class Session:
    """``<root>/run_YYYYMMDD_HHMMSS``, made when something is first written there."""

    def __init__(self, root: str | Path, now: datetime | None = None):
        self.folder = Path(root) / f"run_{now or datetime.now():%Y%m%d_%H%M%S}"

    def path(self, name: str) -> Path:
        self.folder.mkdir(parents=True, exist_ok=True)
        return self.folder / name

    def logger(self, name: str, file: str = "translation.log", level: int = logging.INFO, console: int = logging.WARNING) -> logging.Logger:
        """A logger to the console and to a file of this session; asked for again, the same one."""
        found = logging.getLogger(f"{name}@{self.folder}")
        if not found.handlers:
            found.setLevel(min(level, console))
            found.propagate = False
            for handler, least in ((_Lazy(self, file), level), (logging.StreamHandler(), console)):
                handler.setLevel(least)
                handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
                found.addHandler(handler)
        return found


class _Lazy(logging.Handler):
    """Opens its file with the first record."""

    def __init__(self, session: Session, file: str):
        super().__init__()
        self.session, self.file, self.to = session, file, None

    def emit(self, record: logging.LogRecord) -> None:
        if self.to is None:
            self.to = self.session.path(self.file).open("a", encoding="utf-8")
        self.to.write(self.format(record) + "\n")
        self.to.flush()

    def close(self) -> None:
        if self.to is not None:
            self.to.close()
            self.to = None
        super().close()
