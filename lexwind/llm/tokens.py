"""Byte-level BPE over a public vocabulary file.

The ids are those of the `tokenizers` library for the same file (tests compare both); tiktoken computes them with
a quarter of the CPU time.
"""

from __future__ import annotations

import functools
import json
import re

# Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of the pattern's white space (Unicode's White_Space), each as a whole, and from which length on one is taken apart.
RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++")
LONG_RUN = 100_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def load_encoding(path: str):
    """A tiktoken encoding with the vocabulary and the added tokens of a byte-level BPE file of `tokenizers`."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of = byte_alphabet()
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def directly(encoding, text: str, specials: bool) -> list[int]:
    return encoding.encode(text, allowed_special="all" if specials else set(), disallowed_special=())


def encode(encoding, text: str, specials: bool = True) -> list[int]:
    """Ids as `tokenizers` gives them with add_special_tokens=False: added tokens' strings in a text keep their ids.

    Without `specials` they are plain text. A very long run of white space is one pre-token, but for its last sign if other text
    follows it; such runs are merged apart from the rest, since the pattern would try all their ends.
    """
    if len(text) < LONG_RUN:
        return directly(encoding, text, specials)
    ids, at = [], 0
    for run in RUNS.finditer(text):
        if len(run[0]) < LONG_RUN:
            continue
        followed = run.end() < len(text) and not (specials and any(text.startswith(s, run.end()) for s in encoding.special_tokens_set))
        end = run.end() - followed
        ids += directly(encoding, text[at : run.start()], specials) + encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + directly(encoding, text[at:], specials)


def decode(encoding, ids: list[int]) -> bytes:
    """The text of the ids in UTF-8, added tokens' strings included; bytes that are no text become replacement signs."""
    return encoding.decode_bytes(ids).decode("utf-8", "replace").encode("utf-8")
