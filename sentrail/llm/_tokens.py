"""Token ids of whole texts, by the byte-level BPE vocabulary of a ranks file."""

from __future__ import annotations

import base64

import numpy as np

SEPARATOR = 50256
#: The special token of the vocabulary and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def vocabulary() -> str:
    """Default path of the ranks file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Encodes texts word by word through a bounded cache.

    The pre-tokenisation pattern always begins a new piece at a space that stands between two characters that are
    not white space, so the text may be cut there and each part encoded by itself; the ids are those of the whole
    text. A text with other white space around a space is encoded in one go.

    Where ``special`` stands in a text, its id is taken and the parts around it are encoded each by itself, as the
    tokenizers library does by default; without ``special`` it is ordinary text.
    """

    CACHED, LONGEST = 400_000, 64

    def __init__(self, path: str, special: str | None = SPECIAL):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self._encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special, self._id = special, np.uint16(SPECIAL_ID).tobytes()
        self._cache: dict[str, bytes | int] = {}

    def _raw(self, text: str) -> bytes:
        return np.array(self._encode(text), dtype="<u2").tobytes()

    def _part(self, part: str) -> bytes | int:
        """Ids of a part and the space before it; 0 if it can't be encoded by itself."""
        return 0 if not part or part[0].isspace() or part[-1].isspace() else self._raw(" " + part)

    def raw(self, text: str) -> bytes:
        """Ids as little-endian 16-bit integers."""
        if self._special and self._special in text:
            return self._id.join(self._plain(part) for part in text.split(self._special))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if head and head[-1].isspace():
            return self._raw(text)
        try:
            return (self._raw(head) if head else b"") + b"".join(map(self._cache.__getitem__, rest))
        except KeyError:
            pass
        except TypeError:
            return self._raw(text)
        if len(self._cache) > self.CACHED:
            self._cache.clear()
        long = {}
        for part in set(rest):
            if part not in self._cache:
                (self._cache if len(part) <= self.LONGEST else long)[part] = self._part(part)
        parts = [long[p] if p in long else self._cache[p] for p in rest]
        return self._raw(text) if 0 in parts else (self._raw(head) if head else b"") + b"".join(parts)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype="<u2") if text else np.zeros(0, dtype="<u2")


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, special: str | None = SPECIAL) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]
