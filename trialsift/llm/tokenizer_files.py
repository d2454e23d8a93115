"""Where the installed vocabulary files are; they are read in place and never copied."""

from __future__ import annotations


def WORD_BPE() -> str:  # noqa: N802
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def BYTE_BPE() -> str:  # noqa: N802
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
