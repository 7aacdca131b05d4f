"""Token ids of whole texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed values of the vocabulary: its one added token, which its rank file leaves out.
ADDED = {"<|endoftext|>": 50256}
#: Characters of a text that are encoded at once; a cut falls before a blank between two plain letters.
SEGMENT = 1 << 20
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def vocabulary_path() -> str:
    return str(public_tokenizers.path(VOCABULARY))


def segments(text: str) -> Iterator[str]:
    """Parts of a long text that give the same ids one by one as the whole."""
    start = 0
    while len(text) - start > SEGMENT:
        cut = _CUT.search(text, start + SEGMENT)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Ids as ``tokenizers`` gives them with ``byte_bpe_50k.json`` and ``add_special_tokens=False`` (a test compares them).

    The added token's string in a text is that token, there as here.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.of = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)

    def ids(self, text: str | None, end: int) -> np.ndarray:
        """The ids of a text (null: none), closed by ``end``."""
        parts = [self.of.encode_to_numpy(s, allowed_special="all") for s in segments(text or "")]
        return np.concatenate([*parts, [end]]).astype("<u4")
