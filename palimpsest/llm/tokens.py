"""Exact token ids of a vocabulary file, by batch encoding of segments cut at safe boundaries.

A text is cut only at safe boundaries: before one space or line feed that stands between two characters that aren't
white space.  The byte-level pre-tokenizer ends a token there whatever stands on either side, so the tokens of the segments,
one after the other, are the tokens of the text.  The distinct segments of a batch of texts that no batch before had are encoded together, in
calls balanced by bytes; a bounded number of them is remembered.  A text in which some boundary isn't safe (runs of
white space, white space at an end) goes to the library in segments of a bounded size, each cut at a safe boundary where there is one.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: For these characters the pre-tokenizers of both libraries can't differ; all else goes to `tokenizers`.
PLAIN = re.compile(r"[ \n]?[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: Segments remembered by a worker: about 150 MB.
REMEMBERED = 600_000
SEGMENT = 1 << 18
#: Marks the first segment of a text; no other one has two line feeds.
FIRST = "\n\n"
#: Bytes that one call of the library encodes.
CALL_BYTES = 1 << 18


def balanced(pieces: Iterable[str], max_bytes: int = CALL_BYTES) -> Iterator[list[str]]:
    """Calls of about equal bytes; a larger piece has one of its own."""
    out, held = [], 0
    for p in pieces:
        size = 4 * len(p)
        if out and held + size > max_bytes:
            yield out
            out, held = [], 0
        out.append(p)
        held += size
    if out:
        yield out


def safe_segments(text: str, limit: int = SEGMENT) -> list[str]:
    """Segments of about ``limit`` characters, cut at safe boundaries only; one that has none stays whole."""
    out, start, n = [], 0, len(text)
    while n - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def _same_ids(path: str):
    """The vocabulary in the form that `tiktoken` reads, where it lies beside the file: for plain Latin segments it gives the ids of
    the library in a third of the time.  Only packing uses it, whose ids cost more than lengths do."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Pieces:
    """What the ids of texts give: their bytes (4 each, little-endian), or their number."""

    def __init__(self, path: str, count: bool, share: int = 1):
        """``share``: one in so many of `REMEMBERED` segments is remembered."""
        self.share = share
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.count = Tokenizer.from_file(path), count
        self.fast = None if count else _same_ids(path)
        #: Segment -> value.  Keys: a segment after a space, without it; one after a line feed, with it; two line feeds and the first one of a text.
        #: None marks one with which the boundary isn't safe.
        self.known: dict[str, int | bytes | None] = {}

    def encoded(self, pieces: Iterable[str]) -> Iterator[int | bytes]:
        for some in balanced(pieces):
            if self.count:
                yield from map(len, self.library.encode_batch_fast(some, add_special_tokens=False))
                continue
            plain = [self.fast is not None and "<|" not in p and PLAIN.fullmatch(p) is not None for p in some]
            others = iter(self.library.encode_batch_fast([p for p, x in zip(some, plain, strict=True) if not x], add_special_tokens=False))
            for p, x in zip(some, plain, strict=True):
                yield array("I", self.fast.encode_ordinary(p) if x else next(others).ids).tobytes()

    def learn(self, keys: set[str]) -> dict[str, int | bytes | None]:
        """Values of segments that aren't remembered; as many as there is room for are, from now on."""
        rest = {k: k.lstrip("\n") for k in keys}
        safe = [k for k, r in rest.items() if r and not r[0].isspace() and not r[-1].isspace()]
        out: dict[str, int | bytes | None] = dict.fromkeys(keys)
        out.update(zip(safe, self.encoded(rest[k] if k[:2] == FIRST else k if k[0] == "\n" else " " + k for k in safe), strict=True))
        for k in keys:
            if len(self.known) >= REMEMBERED // self.share:
                break
            if len(k) < 48:
                self.known[k] = out[k]
        return out

    def of_all(self, texts: list[str]) -> list[int | bytes]:
        """The values of some texts."""
        add, none = (sum, 0) if self.count else (b"".join, b"")
        cut = []
        for text in texts:
            keys = text.replace("\n", " \n").split(" ") if text else []
            if keys:
                keys[0] = FIRST + keys[0]
            cut.append(keys)
        new = set().union(*cut)
        new.difference_update(self.known)
        # Views of the memory and of what is new, so that a full memory costs nothing but encoding again.
        fresh = self.learn(new) if new else {}
        out: list[int | bytes] = []
        for text, keys in zip(texts, cut, strict=True):
            if not keys:
                out.append(none)
                continue
            values = [fresh[k] if k in fresh else self.known[k] for k in keys] if fresh else list(map(self.known.__getitem__, keys))
            out.append(add(self.encoded(safe_segments(text)) if None in values else values))
        return out


@lru_cache(maxsize=2)
def pieces(path: str, count: bool, share: int = 1) -> Pieces:
    """One memory for all tasks of a Python worker."""
    return Pieces(path, count, share)
