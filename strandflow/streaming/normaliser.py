"""The rolling scale of a channel: values come in, and go out scaled to a target by what the channel's last ``length`` values show.

It goes on over the reads of a channel. A value is scaled by the statistics at the time it is taken out, so a chunk's
events are scaled by a window that ends with the chunk.
"""

from __future__ import annotations

import numpy as np


class RollingScale:
    def __init__(self, mean: float, stdv: float, length: int = 6000):
        self.mean, self.stdv, self.length = mean, stdv, length
        self.window = np.empty(0)
        self.waiting = np.empty(0)

    def push(self, values: np.ndarray) -> int:
        """Take values in; how many fit: those that are still waiting may not be pushed out of the window."""
        taken = values[: max(0, self.length - len(self.waiting))]
        self.window = np.concatenate((self.window, taken))[-self.length :]
        self.waiting = np.concatenate((self.waiting, taken))
        return len(taken)

    def unread(self) -> int:
        return len(self.waiting)

    def skip_unread(self, keep: int = 0) -> int:
        """Forget waiting values but the last ``keep``; how many went."""
        gone = max(0, len(self.waiting) - keep)
        self.waiting = self.waiting[gone:]
        return gone

    def pop(self) -> np.ndarray:
        """All waiting values, scaled. A window without spread gives the target mean."""
        out, self.waiting = self.waiting, np.empty(0)
        sd = self.window.std() if len(self.window) else 0.0
        return (out - self.window.mean()) * (self.stdv / sd) + self.mean if sd > 0 else np.full(len(out), self.mean)

    def reset(self, length: int | None = None) -> None:
        """An empty window, of a new length if one is given."""
        self.length = self.length if length is None else length
        self.window = self.waiting = np.empty(0)
