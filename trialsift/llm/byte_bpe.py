"""Ids of byte-level BPE vocabularies of the tokenizers library.

The library needs over 900 CPU seconds for a gigabyte.  tiktoken merges the same pairs in less than a third of
that, so it is given the library's own vocabulary file, read into its form, and takes every text for which
both give the same ids.  The library keeps texts that hold one of its added tokens, and texts with a run of
``LONG_RUN`` white-space characters, for which the other's splitter runs out of stack.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LONG_RUN = 4096


def _byte_names() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary: itself if it is visible, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    hidden = sorted(set(range(256)) - set(plain))
    names.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return names


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes of every token and its id, if ids follow the order of the merges; None if they do not."""
    names = _byte_names()

    def raw(token: str) -> bytes | None:
        try:
            return bytes(names[c] for c in token)
        except KeyError:
            return None

    vocabulary = model["vocab"]
    last = -1
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        made = vocabulary.get(left + right)
        if made is None or made <= last:
            return None
        last = made
    ranks = {raw(t): i for t, i in vocabulary.items() if raw(t) is not None}
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


# Fixed value: the split pattern of this family of vocabularies, as their library applies it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """``encode(text)``: ids as the tokenizers library gives them, without truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = file.read()
        spec = json.loads(text)
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.quick = None
        split = spec.get("pre_tokenizer") or {}
        own_split = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        ranks = _ranks(spec["model"]) if spec["model"].get("type") == "BPE" else None
        if own_split and ranks and not spec.get("normalizer") and not spec["model"].get("ignore_merges"):
            import tiktoken

            added = [t["content"] for t in spec.get("added_tokens", [])]
            plain = {b: i for b, i in ranks.items() if b.decode("utf-8", "replace") not in added}
            self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
            odd = [re.escape(t) for t in added] + [r"\s{%d}" % LONG_RUN]
            self.odd = re.compile("|".join(odd))

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None and not self.odd.search(text):
            return self.quick.encode_to_numpy(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def pieces_of(path: str, cap: int, end: int):
    """Map of texts to their pieces of at most ``cap`` ids, ``end`` appended to each text."""
    kind = pa.list_(
        pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids = np.append(coder.encode(text.as_py() or "").astype("<u4"), np.uint32(end))
                # Only the first piece may be short.
                cuts = [0, *range(len(ids) % cap or cap, len(ids) + 1, cap)]
                rows.append(
                    [
                        {"piece": i, "start": low, "length": high - low, "ids": ids[low:high].astype("<u4").tobytes()}
                        for i, (low, high) in enumerate(zip(cuts, cuts[1:]))
                    ]
                )
            yield pa.array(rows, kind)

    return run
