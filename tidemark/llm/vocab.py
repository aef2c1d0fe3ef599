"""Readers of public tokenizer files: byte alphabet, merges and ranks."""

from __future__ import annotations

import base64
import hashlib
import json


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def printable_bytes() -> dict[str, int]:
    """The printable stand-in character of every byte in byte-level vocabularies.

    Bytes that print stand for themselves; the others, in order, take the
    code points from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_json_bpe(path: str) -> dict:
    """Parts of a byte-level BPE file: byte ids, merges as id pairs, special strings; and the file's digest."""
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    vocab = spec["model"]["vocab"]
    alphabet = printable_bytes()
    byte_ids = [0] * 256
    for char, byte in alphabet.items():
        byte_ids[byte] = vocab[char]
    merges = []
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    return {"digest": hashlib.sha256(raw).hexdigest(), "byte_ids": byte_ids, "merges": merges, "special": special}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
