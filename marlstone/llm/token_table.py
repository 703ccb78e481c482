"""Distinct-word tables over public tokenizers.

A byte or word BPE never merges across the start of a run of white space, so a
text may be split there, each distinct piece encoded once, and the ids put
back by position.  The pieces are encoded by the tokenizers library itself:
the split only decides what is encoded together.

``WordTable`` is one worker's, for operators that need ids in passing (packing);
``bpe`` has the table of the whole corpus.  It is kept in two generations of at
most ``GENERATION`` words, so its memory has a bound; a word that has left the
table is encoded again, with the same ids.
"""

from __future__ import annotations

import os
import re
import sys
import threading
from array import array
from collections.abc import Callable

from marlstone.llm.durable import trim

GENERATION = 800_000
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as little-endian integers of four bytes")

#: Unicode White_Space, as the tokenizers' regular expressions see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACED = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def spaced_words(text: str) -> list[str]:
    """Words with the white space before them; all of ``text``, in order."""
    return _SPACED.findall(text)


def bare_words(text: str) -> list[bytes]:
    """Words between ASCII white space, for tokenizers that drop it."""
    return text.encode().split()


def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordTable:
    """Ids of words as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, split: Callable[[str], list]) -> None:
        self.tokenizer = tokenizer_of(path)
        self.split = split
        self.young: dict = {}
        self.old: dict = {}

    def _learn(self, words: set) -> dict:
        """Ids of words that the young table hasn't."""
        if len(self.young) >= GENERATION:
            self.old, self.young = self.young, {}
        found, fresh = {}, []
        for word in words:
            known = self.old.get(word)
            if known is None:
                fresh.append(word)
            else:
                found[word] = known
        if fresh:
            plain = [w.decode() if isinstance(w, bytes) else w for w in fresh]
            done = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
            for word, piece in zip(fresh, done):
                found[word] = array("I", piece.ids).tobytes()
        self.young.update(found)
        return found

    def ids(self, text: str) -> bytes:
        """Ids of the whole text, four bytes each."""
        words = self.split(text)
        found = list(map(self.young.get, words))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            learned = self._learn({words[i] for i in missing})
            for i in missing:
                found[i] = learned[words[i]]
        return b"".join(found)


_TABLES: dict[tuple[str, str], WordTable] = {}
#: Seconds after its last task in which a worker that waits keeps its tables.
KEPT = 5.0
_timer: threading.Timer | None = None


def table(path: str, split: Callable[[str], list]) -> WordTable:
    """This worker's table; a worker that is used again soon keeps it."""
    if _timer is not None:
        _timer.cancel()
    key = (path, split.__name__)
    if key not in _TABLES:
        _TABLES[key] = WordTable(path, split)
    return _TABLES[key]


def _forget() -> None:
    _TABLES.clear()
    trim()


def done() -> None:
    """Called at the end of a task: lets go of all tables unless a task comes soon."""
    global _timer
    if _timer is not None:
        _timer.cancel()
    _timer = threading.Timer(KEPT, _forget)
    _timer.daemon = True
    _timer.start()


def pieces(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary: the id-to-piece table."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    for n, b in enumerate(x for x in range(256) if x not in set(printable)):
        byte_of[chr(256 + n)] = b
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out: list[bytes] = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = added[i].encode() if i in added else bytes(byte_of[c] for c in piece)
    return out
