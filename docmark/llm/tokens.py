"""Token ids of whole texts by a public tokenizer, for the packing operators.

The vocabulary is a file of the tokenizers library. A plain byte-level vocabulary, whose ids go up in the
order of its merges, is also what tiktoken reads: pairs are merged by the rank of what they make. Such a
vocabulary is handed to tiktoken, which gives the same ids at a quarter of the cost; the tests compare
both over all code points. Texts with the name of a special token or a very long run of white space
(tiktoken backtracks over it), and all texts under other vocabularies, are encoded by tokenizers itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

END = 1

# Fixed value: how byte-level vocabularies cut a text before merging bytes.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_LONG_SPACE = re.compile(r"\s{1000}")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path or vocabulary_path())


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each id of a plain byte-level vocabulary; None if merging by ids could give other ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
        and not cut.get("add_prefix_space") and spec.get("normalizer") is None
        and not any(model.get(k) for k in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    if not plain:
        return None
    ids, names = model["vocab"], _byte_names()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = ["".join(p) for p in pairs]
    special = {t["content"] for t in spec.get("added_tokens", ())}
    order = [ids[t] for t in made]
    if order != sorted(order) or {*names, *made} != {*ids} - special:
        return None
    return {bytes(names[c] for c in t): ids[t] for t in (*names, *made)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        if self.fast is not None and not _LONG_SPACE.search(text) and not any(t in text for t in self.special):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None], end: int = END) -> list[np.ndarray]:
        """The ids of each text, then the end id; null is an empty text."""
        return [np.frombuffer(array("I", [*self._ids(t or ""), end]), np.uint32) for t in texts]
