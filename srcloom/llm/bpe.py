"""Exact byte-level BPE ids, as the tokenizers library gives them without added special tokens.

Texts of plain Latin letters and ASCII are encoded with the same vocabulary written as
byte ranks, which is several times faster and gives the same ids; all other texts, and
those that hold a special string, by the tokenizers library itself.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: White space beyond ASCII, and characters that libraries may class differently: such texts are not cut.
ODD = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: White space and the non-space run after it. Between two of these, no pre-token reaches over and none looks ahead.
CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u0233]*").fullmatch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranks = None
        ranks_path = re.sub(r"\.json$", ".tiktoken", path)
        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or not _PLAIN(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranks.encode_to_numpy(text, disallowed_special=())


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
