"""Block-compressed text read in parts (SRC-5, SRC-6, SRC-13): bytes by range, counted and retried; splits of fixed size; lines that cross them.

A compressed file is a chain of members.  A split owns the members that begin in
it, and finds the first by its header and by the chain of sizes that leads on
from there.  A line belongs to the split in which the line break before it lies: a split
drops what comes before its first line break and reads on to the end of its last
line.  Memory is bounded by what is read at once and by the longest line.
"""

from __future__ import annotations

import http.client
import os
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterable, Iterator

#: Largest block, compressed or not; compressed bytes read at once; compressed bytes of a split.
BLOCK, CHUNK, SPLIT = 1 << 16, 1 << 20, 32 << 20
HEADER = b"\x1f\x8b\x08\x04"


class ByteFile:
    """A file, local or over HTTP, by byte ranges; ``sent`` counts the bytes that came, those of failed tries too."""

    def __init__(self, path: str, tries: int = 4, pause: float = 1.0):
        self.path, self.tries, self.pause, self.sent = path, tries, pause, 0
        self.remote = path.startswith(("http://", "https://"))

    def size(self) -> int | None:
        """Bytes of the whole file; None if the server doesn't say."""
        if not self.remote:
            return os.path.getsize(self.path.removeprefix("file://"))
        length = self._asked(lambda: self._open(method="HEAD"), lambda got: got.headers.get("Content-Length"))
        return int(length) if length else None

    def read(self, start: int = 0, end: int | None = None) -> bytes:
        """The bytes from ``start`` to before ``end``, or all that follow."""
        if not self.remote:
            with open(self.path.removeprefix("file://"), "rb") as f:
                f.seek(start)
                data = f.read(-1 if end is None else max(0, end - start))
            self.sent += len(data)
            return data
        ranged = start > 0 or end is not None
        if end is not None and end <= start:
            return b""

        def body(got) -> bytes:
            if ranged and got.status != 206:
                raise ValueError(f"{self.path}: the server ignores byte ranges")
            return self._body(got)

        return self._asked(lambda: self._open({"Range": f"bytes={start}-{'' if end is None else end - 1}"} if ranged else {}), body)

    def _open(self, headers: dict | None = None, method: str = "GET"):
        return urllib.request.urlopen(urllib.request.Request(self.path, headers=headers or {}, method=method), timeout=60)

    def _body(self, got) -> bytes:
        try:
            data = got.read()
        except http.client.IncompleteRead as e:
            self.sent += len(e.partial)
            raise
        self.sent += len(data)
        return data

    def _asked(self, ask, take):
        """``take`` of what ``ask`` opens; busy servers, lost connections and time-outs are tried again, each time after twice the pause."""
        for k in range(self.tries):
            if k:
                time.sleep(self.pause * 2 ** (k - 1))
            try:
                with ask() as got:
                    return take(got)
            except urllib.error.HTTPError as e:
                self._body(e)
                if e.code != 429 and e.code < 500:
                    raise
                last = e
            except (http.client.HTTPException, OSError) as e:  # URLError, time-outs and resets among them
                last = e
        raise last


def pieces(file: ByteFile, at: int, size: int | None) -> Iterator[tuple[int, int, bytes]]:
    """(start of the member, place in the member, inflated bytes) from the member at ``at`` on.

    What follows the last member and is none is left out; a member that the
    file's end cuts gives what it has; one that is damaged raises.
    """
    buffer, pos, start, within = b"", at, at, 0
    member = None
    while True:
        if not buffer:
            if size is not None and pos >= size:
                return
            buffer = file.read(pos, pos + CHUNK if size is None else min(size, pos + CHUNK))
            pos += len(buffer)
            if not buffer:
                return
        if member is None:
            start, within = pos - len(buffer), 0
            if len(buffer) == 1 and (size is None or pos < size):
                more = file.read(pos, pos + 1)
                buffer, pos = buffer + more, pos + len(more)
            if buffer[:2] != HEADER[:2]:
                return
            member = zlib.decompressobj(wbits=31)
        data = member.decompress(buffer, CHUNK)
        if data:
            yield start, within, data
            within += len(data)
        if member.eof:
            buffer, member = member.unused_data, None
        else:
            buffer = member.unconsumed_tail


def block_size(data: bytes, at: int) -> int | None:
    """Bytes of the block whose header is at ``at``; None if there is no whole header of a block."""
    if data[at : at + 4] != HEADER or len(data) < at + 12:
        return None
    k, end = at + 12, at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    while k + 6 <= min(end, len(data)):
        n = int.from_bytes(data[k + 2 : k + 4], "little")
        if data[k : k + 2] == b"BC" and n == 2:
            return int.from_bytes(data[k + 4 : k + 6], "little") + 1
        k += 4 + n
    return None


def is_blocked(file: ByteFile) -> bool:
    """Whether a file begins with a block, so that it can be split."""
    return block_size(file.read(0, 64), 0) is not None


def first_block(file: ByteFile, at: int, size: int) -> int | None:
    """Where the first block at or after ``at`` starts; None if none does before the file ends.

    Compressed bytes may look like a header, so the sizes must lead from header to
    header as far as three blocks reach, or to the end of the file.
    """
    data = file.read(at, min(size, at + 4 * BLOCK))
    k = data.find(HEADER)
    while k >= 0:
        to = k
        while to + 12 <= len(data) and (n := block_size(data, to)):
            to += n
        if to == len(data) or (to > k and to + 12 > len(data)) or (to > k and at + to >= size):
            return at + k
        if to > k and block_size(data, to) is None and len(data) - to < 64 and at + len(data) < size:
            return at + k  # the last header is cut by what was read
        k = data.find(HEADER, k + 1)
    return None


def lines(parts: Iterable[tuple[bytes, bool]], skip: bool) -> Iterator[bytes]:
    """The lines of (bytes, whether they are one's own); ``skip``: what comes before the first line break is another's.

    The last line goes on in what isn't one's own, up to its line break or the end of all.
    """
    rest: list[bytes] = []
    for data, own in parts:
        at = 0
        if skip:
            at = data.find(b"\n") + 1
            if not own:
                return
            if not at:
                continue
            skip = False
        if not own:
            cut = data.find(b"\n")
            rest.append(data if cut < 0 else data[:cut])
            if cut >= 0:
                yield b"".join(rest)
                return
            continue
        cut = data.rfind(b"\n")
        if cut < at:
            rest.append(data[at:])
            continue
        head, *others = data[at:cut].split(b"\n")
        yield b"".join([*rest, head])
        yield from others
        rest = [data[cut + 1 :]]
    if not skip and any(rest):
        yield b"".join(rest)


def lines_of_split(file: ByteFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """SRC-6: the lines of the split of bytes ``start`` to before ``end``."""
    at = 0 if not start else first_block(file, start, size)
    if at is None or at >= end:
        return
    yield from lines(((data, member < end) for member, _, data in pieces(file, at, size)), start > 0)


def lines_of_range(file: ByteFile, size: int | None, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin at virtual offsets from ``begin``, where one does, to before ``end``."""
    first, skipped = begin >> 16, begin & 0xFFFF

    def parts() -> Iterator[tuple[bytes, bool]]:
        for member, within, data in pieces(file, first, size):
            if member == first and within < skipped:
                within, data = max(within, min(skipped, within + len(data))), data[max(0, skipped - within) :]
            own = len(data) if member < end >> 16 else max(0, (end & 0xFFFF) - within) if member == end >> 16 else 0
            if data[:own]:
                yield data[:own], True
            if data[own:]:
                yield data[own:], False

    # a range ends with a line: what follows is read only where one goes on
    def until_whole() -> Iterator[tuple[bytes, bool]]:
        whole = True
        for data, own in parts():
            if not own and whole:
                return
            yield data, own
            whole = data.endswith(b"\n") if own else whole

    yield from lines(until_whole(), False)


def splits(size: int, split: int = SPLIT) -> list[tuple[int, int]]:
    """A file's bytes in parts of at most ``split``."""
    return [(s, min(size, s + split)) for s in range(0, size, split)]


def inflated(data: bytes) -> bytes:
    """SRC-5: members one after another, of a small file; what a cut one has counts too."""
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        if not member.eof:
            break
        data = member.unused_data
    return b"".join(out)
