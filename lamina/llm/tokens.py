"""Token ids by the tokenizers library, one encoding per distinct chunk of text.

Both vocabularies are applied chunk by chunk: a cut in front of a chunk never changes the ids on
either side, so the ids of a text are the ids of its chunks, joined. Chunks repeat very often;
each worker keeps the first ``CACHE`` that it meets, and of later ones a batch's worth.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np

END = 1
CACHE = 800_000
#: Chunks that are encoded in one go.
JOINED = 200
#: Characters with the Unicode property White_Space, which the tokenizers' own patterns mean by \s.
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: With the byte-level pattern a single blank belongs to the word after it, and of a run of white
#: space the last one stands alone or leads that word.
KEEPS_SPACE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
DROPS_SPACE = re.compile(f"[^{SPACE}]+")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        keeps = self.raw("a b") != self.raw("a") + self.raw("b")
        self.pattern = KEEPS_SPACE if keeps else DROPS_SPACE
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps = keeps
        self.known: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}  # ids of a blank and the word
        line_end = self.raw("\n")
        self.line_end = int.from_bytes(line_end, "little") if len(line_end) == 4 else None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None  # which ids end a word
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def cut(self, text: str) -> tuple[dict[str, bytes], list[str]]:
        """Chunks of a text and the table that knows them. In ``after_blank`` a word stands for a blank and itself."""
        words = text.split()
        if self.keeps:
            # Equal only if single blanks and line ends are all the white space that there is.
            if " ".join(words) == text.replace("\n", " "):
                return self.after_blank, text.replace("\n", " \n").split(" ")
            return self.known, self.pattern.findall(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these four for white space
            return self.known, self.pattern.findall(text)
        return self.known, words

    def joined(self, whole: list[str]) -> Iterable[bytes]:
        """Ids of chunks by one encoding for ``JOINED`` of them, cut at what parts them: a line end, or each word's last token."""
        gap = "\n" if self.keeps else " "
        groups = [whole[at : at + JOINED] for at in range(0, len(whole), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([gap.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            last = np.flatnonzero(ids == self.line_end) if self.keeps else np.flatnonzero(self.ends[ids]) + 1
            begin = [0, *(4 * (last + 1) if self.keeps else 4 * last[:-1]).tolist()]
            after = [*(4 * last).tolist(), *([4 * len(ids)] if self.keeps else [])]
            if len(begin) != len(group):  # parted otherwise than expected: one by one
                yield from map(self.raw, group)
                continue
            data = ids.tobytes()
            yield from (data[i:j] for i, j in zip(begin, after, strict=True))

    def may_join(self, known: dict[str, bytes], chunk: str) -> bool:
        """Whether the chunk's ids can be told apart from those beside it."""
        if self.keeps:
            return known is self.after_blank and self.line_end is not None and chunk[0] != "\n"
        return self.ends is not None and chunk.isascii() and chunk.isalpha()

    def learn(self, known: dict[str, bytes], new: set[str]) -> list[str]:
        """Add the ids of new chunks; returns those to forget after this batch, if the cache is full."""
        room = max(0, CACHE - len(self.known) - len(self.after_blank))
        easy = [c for c in new if self.may_join(known, c)]
        known.update(zip(easy, self.joined([" " + c for c in easy] if self.keeps else easy), strict=True))
        rest = [c for c in new if not self.may_join(known, c)]
        whole = rest if known is self.known else [c if c[0] == "\n" else " " + c for c in rest]
        for at in range(0, len(rest), 20_000):
            for c, e in zip(rest[at : at + 20_000], self.tokenizer.encode_batch_fast(whole[at : at + 20_000], add_special_tokens=False), strict=True):
                known[c] = array("I", e.ids).tobytes()
        return [*easy, *rest][room:]

    def encode(self, texts: list[str | None]) -> Iterable[bytes]:
        """Ids of each text. A text that holds a special token's string is encoded whole: it is cut there first."""
        rows, new, new_after = [], set(), set()
        for t in texts:
            if not t:
                rows.append(([], [], [], self.known))
            elif any(s in t for s in self.special):
                rows.append(([], [self.raw(t)], [], self.known))
            else:
                known, chunks = self.cut(t.lower() if not self.keeps and t.isascii() else t)  # such vocabularies lower-case
                ids = list(map(known.get, chunks))
                if known is self.after_blank:  # but no blank leads the first word
                    ids[0] = self.known.get(chunks[0])
                    if ids[0] is None:
                        new.add(chunks[0])
                gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
                missing = new if known is self.known else new_after
                missing.update([chunks[i] for i in gaps if i or known is self.known])
                rows.append((chunks, ids, gaps, known))
        spare, spare_after = self.learn(self.known, new), self.learn(self.after_blank, new_after)
        for chunks, ids, gaps, known in rows:
            for i in gaps:
                ids[i] = (known if i else self.known)[chunks[i]]
            yield b"".join(ids)
        for known, keys in ((self.known, spare), (self.after_blank, spare_after)):
            for c in keys:
                del known[c]


def resolved(vocabulary: str) -> str:
    """The file of a vocabulary: a name without a folder is looked up where this very process has the public ones."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary; workers are reused, so the file is read once in each."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(resolved(vocabulary))
    return _encoders[vocabulary]


#: Characters of text that are cut into chunks at a time.
AT_ONCE = 2_000_000


def documents(texts: Iterable[str | None], vocabulary: str, end: int = END, at_once: int | None = None) -> Iterable[np.ndarray]:
    """Ids of each text with the end id; null counts as empty. The worker keeps its cache; ``forget`` gives it back."""
    at_once = at_once or AT_ONCE
    e, tail, part, size = encoder(vocabulary), np.array([end], dtype="<u4").tobytes(), [], 0
    collects = gc.isenabled()
    gc.disable()  # hundreds of thousands of strings and no cycles among them: looking for some costs a tenth of the time
    try:
        for t in chain(texts, [...]):
            if part and (t is ... or size >= at_once):
                for ids in e.encode(part):
                    yield np.frombuffer(ids + tail, dtype="<u4")
                part, size = [], 0
            if t is not ...:
                part.append(t)
                size += len(t or "")
    finally:
        if collects:
            gc.enable()


def forget(vocabulary: str) -> None:
    """Give the memory of the worker's cache back to the system, where other steps need it more than the next task of this one."""
    if vocabulary not in _encoders:
        return
    _encoders[vocabulary].known.clear()
    _encoders[vocabulary].after_blank.clear()
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # free pages stay with the process otherwise
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def vocabulary(name: str) -> str:
    """A public vocabulary by its name: each process finds the file where it has it, so nothing of the driver's paths travels."""
    return name
