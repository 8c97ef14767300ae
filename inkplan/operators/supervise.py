"""Recognizers in processes of their own, so that one that hangs or dies costs only the crop it was given.

A worker holds one child process for each recognizer, at most MOST of them. The child makes the recognizer from its class path, asks it whether it is
available and warms it up, where it has such methods, and then answers one call at a time. A call over its time limit ends the child by its process
number; the next call starts another. settled() halves a batch that failed until the bad crops stand alone: some 2 log n calls for each of them
instead of n, and at most log n time limits for one that hangs.

Defined cases: no crops need no child; a recognizer that can't be made, isn't available or doesn't warm up in time gives its error for every crop,
without halving; as many answers as crops must come back, or the batch has failed; a child whose worker has gone ends by itself.
"""

from __future__ import annotations

import atexit
import contextlib
import importlib
import os
import pickle
import queue
import select
import struct
import subprocess
import sys
import threading
import time

#: Children that a worker holds; beyond that the one unused for longest goes.
MOST = 4
_HEAD = struct.Struct("<Q")


class NotStarted(Exception):
    """The recognizer can't be used at all."""


class Child:
    """A recognizer in another process."""

    def __init__(self, path: str, options: tuple, start_s: float = 600.0):
        self.path, self.options, self.start_s = path, options, start_s
        self.process: subprocess.Popen | None = None
        self.size: int | None = None  # crops of a call that are known to fit its time limit; None: any number
        self.broken: str | None = None

    def start(self) -> None:
        if self.broken:
            raise NotStarted(self.broken)
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.process = subprocess.Popen([sys.executable, "-m", __name__], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env)
        for pipe in (self.process.stdin, self.process.stdout):
            os.set_blocking(pipe.fileno(), False)
        try:
            self.call((self.path, self.options), self.start_s)
        except Exception as e:
            self.stop()
            self.broken = f"{type(e).__name__}: {e}"[:200]
            raise NotStarted(self.broken) from e

    def stop(self) -> None:
        if self.process:
            self.process.kill()
            self.process.wait()
            for pipe in (self.process.stdin, self.process.stdout):
                with contextlib.suppress(OSError):
                    pipe.close()
            self.process = None

    def _move(self, end: float, out: memoryview | None, want: int = 0) -> bytes:
        """Sends all of out, or receives so many bytes, before `end`."""
        pipe = self.process.stdin if out is not None else self.process.stdout
        poll, got = select.poll(), bytearray()
        poll.register(pipe.fileno(), select.POLLOUT if out is not None else select.POLLIN)
        while len(out) if out is not None else len(got) < want:
            left = end - time.monotonic()
            if left <= 0 or not poll.poll(1000 * left):
                raise TimeoutError("over its time limit")
            try:
                if out is not None:
                    out = out[os.write(pipe.fileno(), out[: 1 << 16]) :]
                    continue
                part = os.read(pipe.fileno(), min(want - len(got), 1 << 20))
            except BlockingIOError:
                continue
            except BrokenPipeError:
                part = b""
            if not part:
                raise ChildProcessError("the recognizer's process ended")
            got += part
        return bytes(got)

    def call(self, what, limit_s: float):
        end, sent = time.monotonic() + limit_s, pickle.dumps(what)
        self._move(end, memoryview(_HEAD.pack(len(sent)) + sent))
        (size,) = _HEAD.unpack(self._move(end, None, _HEAD.size))
        ok, got = pickle.loads(self._move(end, None, size))
        if not ok:
            raise RuntimeError(got)
        return got

    def read(self, crops: list[bytes], limit_s: float) -> list[tuple[str, float]]:
        if self.process is None or self.process.poll() is not None:
            self.stop()
            self.start()
        try:
            got = self.call(crops, limit_s)
        except (TimeoutError, ChildProcessError):
            self.stop()
            raise
        if len(got) != len(crops):
            raise ValueError(f"{len(got)} readings of {len(crops)} crops")
        return got


def settled(child: Child, crops: list[bytes], limit_s: float) -> list[tuple[str | None, float, str | None]]:
    """(text, confidence, error) of each crop."""
    if not crops:
        return []
    if child.size and len(crops) > child.size:
        return [r for k in range(0, len(crops), child.size) for r in settled(child, crops[k : k + child.size], limit_s)]
    try:
        return [(t, c, None) for t, c in child.read(crops, limit_s)]
    except NotStarted as e:
        return [(None, 0.0, str(e))] * len(crops)
    except Exception as e:
        if len(crops) == 1:
            return [(None, 0.0, (str(e) if isinstance(e, RuntimeError) else f"{type(e).__name__}: {e}")[:200])]
        half = len(crops) // 2
        out = [r for part in (crops[:half], crops[half:]) for r in settled(child, part, limit_s)]
        if isinstance(e, TimeoutError) and all(r[2] is None for r in out):
            child.size = half  # nothing hangs: the batch was too large for its time limit
        return out


_children: dict[tuple, Child] = {}


def child(path: str, options: tuple, start_s: float = 600.0) -> Child:
    """The worker's own for these options; it starts with its first call."""
    got = _children.pop((path, options), None) or Child(path, options, start_s)
    got.broken = None  # another task may try again
    _children[path, options] = got  # used last
    while len(_children) > MOST:
        _children.pop(next(iter(_children))).stop()
    return got


def available(path: str, options: dict | None = None, start_s: float = 600.0) -> bool:
    """REC14: whether the recognizer starts here; if so it is warm afterwards."""
    try:
        child(path, tuple(sorted((options or {}).items())), start_s).read([], start_s)
    except Exception:
        return False
    return True


def running() -> list[str]:
    return [c.path for c in _children.values() if c.process and c.process.poll() is None]


def close() -> None:
    """Ends all children of this process."""
    while _children:
        _children.popitem()[1].stop()


atexit.register(close)


def made(path: str, options: tuple):
    """REC15: the recognizer, available and warm."""
    module, name = path.rsplit(".", 1)
    recognizer = getattr(importlib.import_module(module), name)(**dict(options))
    if hasattr(recognizer, "available") and not recognizer.available():
        raise RuntimeError("not available")
    if hasattr(recognizer, "warm_up"):
        recognizer.warm_up()
    return recognizer


def serve() -> None:
    """The child's loop. Its standard output belongs to the answers, so what recognizers print goes to standard error."""
    answers, asked = os.fdopen(os.dup(1), "wb"), queue.Queue()
    os.dup2(2, 1)

    def listen() -> None:
        calls = sys.stdin.buffer
        while len(head := calls.read(_HEAD.size)) == _HEAD.size:
            asked.put(pickle.loads(calls.read(*_HEAD.unpack(head))))
        os._exit(0)  # the worker has gone, even if a call hangs

    threading.Thread(target=listen, daemon=True).start()
    recognizer = None
    while True:
        what = asked.get()
        try:
            if recognizer is None:
                recognizer, got = made(*what), None
            else:
                got = [(t, float(c)) for t, c in recognizer.read(what)] if what else []
            answer = pickle.dumps((True, got))
        except Exception as e:
            answer = pickle.dumps((False, f"{type(e).__name__}: {e}"[:200]))
        answers.write(_HEAD.pack(len(answer)) + answer)
        answers.flush()


if __name__ == "__main__":
    serve()
