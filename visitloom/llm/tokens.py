"""Token ids of the public byte-level BPE vocabulary, in workers.

The ids are those of the ``tokenizers`` library for the given JSON file. Plain text
of Latin letters, digits and punctuation goes through ``tiktoken`` with the
same vocabulary as ranks, where both libraries split and merge alike at a fifth of
the time; all other text, and text that holds the string of a special token, goes through
``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import re

import numpy as np

#: Characters that both libraries' patterns class alike.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")


def default_paths() -> tuple[str, str]:
    """(JSON file, ranks file) of the 50k vocabulary that the environment offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Texts to arrays of uint32 ids; ``ranks`` may be None (then only ``tokenizers``)."""

    def __init__(self, json_path: str, ranks: str | None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.json_path, self._slow, self._fast = json_path, None, None
        self._make = lambda: Tokenizer.from_file(json_path)
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self._fast is not None and not _PLAIN.search(text) and "<|" not in text:
            return np.asarray(self._fast.encode_ordinary(text), np.uint32)
        if self._slow is None:
            self._slow = self._make()
        return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, ranks: str | None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(json_path, ranks)
