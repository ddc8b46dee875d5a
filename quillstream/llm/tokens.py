"""Ids of texts by public vocabularies.  No tokenizer is trained here."""

from __future__ import annotations

import json
from array import array

#: Marks that may end a chunk; none of them is part of a contraction.
MARKS = ".,;:!?#$%&*|"
#: A cache of words is emptied at so many entries, which bounds a worker's memory.
CACHE_ENTRIES = 450_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """Ids of a byte-level BPE file, as the tokenizers library gives them.

    Where the file's merges stand in the order of its ids, and a text is Latin-1
    without an added token, tiktoken applies the same merges to the same pieces,
    four times as fast; the library itself encodes all other texts.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.library = path, None  # the library's own model is opened by the first text that needs it
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = tuple(x["content"] for x in spec.get("added_tokens", ()))
        self.fast = None
        level = spec.get("pre_tokenizer") or {}
        if level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and not spec.get("normalizer"):
            letters, model = _byte_letters(), spec["model"]
            ranks = {bytes(letters[c] for c in piece): k for piece, k in model["vocab"].items() if piece not in self.added}
            pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
            in_order = [model["vocab"][p] for p in pairs]
            if in_order == sorted(set(in_order)):
                import public_tokenizers

                self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str):
        import numpy as np

        if self.fast is not None and not any(x in text for x in self.added):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class WordEncoder(dict):
    """Ids of a BPE file whose pieces never cross white space, as little-endian 32-bit bytes.

    The file's normalizer drops white space between pieces, so a text's ids are those of its chunks
    between spaces and line ends.  This is the cache of chunks: a new one goes to the library, a word of
    lower-case letters straight to its merges, since the steps before them leave such a word as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model.tokenize
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.old: dict[str, bytes] = {}  # what the cache held when it was last full

    def __missing__(self, chunk: str) -> bytes:
        known = self.old.get(chunk)
        if known is None:
            known = self._new(chunk)
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[chunk] = known
        return known

    def _new(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii():
                if chunk.islower():
                    return array("I", [t.id for t in self.merges(chunk)]).tobytes()
            elif chunk == chunk.lower() and max(chunk) < "\u0100":
                return array("I", [t.id for t in self.merges("".join([self.letters[b] for b in chunk.encode()]))]).tobytes()
        elif chunk and chunk[-1] in MARKS:  # letters and marks are pieces of their own
            word = chunk.rstrip(MARKS)
            if word.isalpha():
                return self[word] + self[chunk[len(word):]]
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        # Case is folded first where that cannot differ from the library's folding, so that fewer chunks are new.
        if "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
