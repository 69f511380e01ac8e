"""Parses of texts that are nested more deeply than the usual stack is."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable
from typing import TypeVar

#: Frames and bytes of the stack on which a deep text is parsed again.
FRAMES, STACK = 400_000, 512 << 20


T = TypeVar("T")


def deeply(parse: Callable[[], T], otherwise: T) -> T:
    """What parse returns; where the usual stack is too small for it, it is called once more on a large one.

    Depth is no error of a text: if the large stack is too small as well, nothing is said of it (otherwise).
    """
    try:
        return parse()
    except RecursionError:
        pass
    done: list = []

    def run():
        try:
            done.append(parse())
        except RecursionError:
            done.append(otherwise)
        except BaseException as e:  # goes on in the caller
            done.append(e)

    frames, stack = sys.getrecursionlimit(), threading.stack_size(STACK)
    sys.setrecursionlimit(max(frames, FRAMES))
    try:
        t = threading.Thread(target=run)
        t.start()
        t.join()
    finally:
        threading.stack_size(stack)
        sys.setrecursionlimit(frames)
    if isinstance(done[0], BaseException):
        raise done[0]
    return done[0]
