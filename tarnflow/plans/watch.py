"""Live settings: a file is read again when it may have changed, and taken if its steps accept it."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Any

from tarnflow.plans.config import load


class LiveSettings:
    """Settings of one file.

    The file is read when ``changed`` has said so, and otherwise every ``poll_s``, or every ``watched_s`` while
    ``watched`` holds, that is, while something tells of changes.  A file that cannot be read is tried at each check.
    Contents are told apart by their digest; contents that were refused are remembered and not tried
    again, and the settings before stay in force.
    """

    def __init__(
        self, read: Callable[[], str], apply: Callable[[dict[str, Any]], bool], *, poll_s: float = 0.5, watched_s: float = 30.0,
        watched: Callable[[], bool] = lambda: False, clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self.read, self.apply, self.clock, self.watched = read, apply, clock, watched
        self.poll_s, self.watched_s = poll_s, watched_s
        self.taken: str | None = None
        self.refused: str | None = None
        self.at: float | None = None
        self.due = True

    def changed(self) -> None:
        """The file may have changed: the next check reads it."""
        self.due = True

    def check(self) -> bool:
        """Whether new settings came into force."""
        now = self.clock()
        wait = self.watched_s if self.watched() else self.poll_s
        if not self.due and self.at is not None and now - self.at < wait:
            return False
        # a change that comes while the file is read makes it due again
        self.due = False
        try:
            text = self.read()
        except OSError:
            self.due = True
            return False
        self.at = now
        digest = hashlib.sha256(text.encode()).hexdigest()
        if digest in (self.taken, self.refused):
            return False
        try:
            done = self.apply(load(text))
        except Exception:  # settings come from outside: whatever is wrong with them, the old ones stay
            done = False
        if done:
            self.taken, self.refused = digest, None
        else:
            self.refused = digest
        return done
