"""Byte-level BPE token ids at the speed the packing operators need.

The ids are those of the ``tokenizers`` library for the same vocabulary file
(tests compare them). Its tables are read from the file and run by tiktoken's
merger, on a pattern without look-ahead wherever that gives the same words.
As with the library, a vocabulary's added token that stands in a text gets its
own id, whatever is around it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

# The word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Only runs of white space need the look-ahead; all that may be white space is in here.
_RUN = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"

END = 1  # the id that ends a document

_loaded: dict[int, Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def share_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file's bytes (a few MB) for the executors."""
    return spark.sparkContext.broadcast(Path(path or vocabulary_path()).read_bytes())


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself and the
    others, in order, as the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, file: bytes):
        import tiktoken

        data = json.loads(file)
        self._file = file
        model = data["model"]
        added = data.get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        self._special = list(special)
        # Several tokens, or one that takes in white space or needs word bounds, are left to the library.
        self._plain = len(added) < 2 and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        to_byte = _byte_of_char()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [ranks[bytes(to_byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids don't follow its merges")
        make = lambda p: tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self._exact: Callable[[str], list[int]] = make(WORDS)
        self._fast: Callable[[str], list[int]] = make(WORDS.replace(r"\s+(?!\S)|", ""))
        marked = tiktoken.Encoding("marked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self._marked: Callable[[str], list[int]] = lambda text: marked.encode(text, set(special))
        self._library = None

    def _slow(self, text: str) -> list[int]:
        """By the library itself: for texts that the merger can't take."""
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_str(self._file.decode())
        return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array, end: int | None = END) -> Iterator[array]:
        """Ids of each whole text, then ``end``; null counts as empty."""
        runs = pc.match_substring_regex(texts, _RUN).to_pylist()
        for text, run in zip(texts, runs, strict=True):
            whole = text.as_py() or ""
            encode = self._exact if run else self._fast
            if any(s in whole for s in self._special):
                encode = self._marked if self._plain else self._slow
            try:
                ids = array("I", encode(whole))
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # the merger panics on runs past its step limit
                ids = array("I", self._slow(whole))
            if end is not None:
                ids.append(end)
            yield ids


def encoder(shared: Broadcast) -> Encoder:
    """This process's encoder for a shared vocabulary."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded[key] = Encoder(shared.value)
    return _loaded[key]
