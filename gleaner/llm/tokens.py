"""Token ids by a public byte-level BPE vocabulary, each distinct piece of a batch encoded once.

The vocabulary's pre-tokenizer lets a space begin a pre-token and never crosses from a character that is not white space
to a space. A text cut before each space that stands between a character other than white space and one that is neither
white space nor the text's end therefore encodes as the concatenation of its pieces.

A tokenizers file whose merges are in the order of their ids is read into tiktoken's byte-pair encoder, which finds the same ids
several times faster; pieces with a special token's string, and files of another kind, go to the tokenizers library.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPECIAL = "<|endoftext|>"
#: Fixed value: the pre-token pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """tiktoken's encoder for the file, None if its ids don't follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("unk_token") or model.get("ignore_merges"):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    if special - {SPECIAL}:
        return None
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    byte = _alphabet()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes columns of texts; `path` is a tokenizers file of the byte-level kind."""

    def __init__(self, path: str, group: int = 4096) -> None:
        self.path, self.group = path, group

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = _fast(self.path)
        if fast is not None:
            one = fast.encode_ordinary
            return [self.exactly([t])[0] if SPECIAL in t else one(t) for t in texts]
        return self.exactly(texts)

    def exactly(self, texts: list[str]) -> list[list[int]]:
        tokenizer, out = _loaded(self.path), []
        for i in range(0, len(texts), self.group):
            out += [e.ids for e in tokenizer.encode_batch(texts[i : i + self.group], add_special_tokens=False)]
        return out

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Offsets of the texts, the piece that stands at each place, and the distinct pieces."""
        parts = pc.split_pattern(texts, " ")
        flat, at = parts.flatten(), parts.offsets.to_numpy()
        at = at - at[0]
        codes = flat.dictionary_encode()
        words, index = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
        strings = words.to_pylist()
        # A part begins a piece if neither it nor the one before has white space at the border.
        opens = np.array([bool(w) and not w[0].isspace() and SPECIAL not in w for w in strings], bool)
        closes = np.array([bool(w) and not w[-1].isspace() and SPECIAL not in w for w in strings], bool)
        first = np.zeros(len(index), bool)
        first[at[:-1]] = True  # every text has a part, be it empty
        begin = first.copy()
        begin[1:] |= opens[index[1:]] & closes[index[:-1]]
        starts = np.flatnonzero(begin)
        sizes = np.diff(np.append(starts, len(index)))
        # Most pieces are a single part: its code and whether a space stands before it name the piece.
        name = index[starts].astype(np.int64) * 2 + ~first[starts]
        long_names: dict[str, int] = {}
        base = 2 * len(strings)
        for k in np.flatnonzero(sizes > 1):
            s = starts[k]
            said = ("" if first[s] else " ") + " ".join(strings[c] for c in index[s : s + sizes[k]])
            name[k] = long_names.setdefault(said, base + len(long_names))
        distinct, inverse = np.unique(name, return_inverse=True)
        extra = list(long_names)
        said = [extra[x - base] if x >= base else (" " if x & 1 else "") + strings[x >> 1] for x in distinct.tolist()]
        return np.searchsorted(starts, np.append(at[:-1], len(index))), inverse, said

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """As `pieces`, with the number of ids of each distinct piece. Null: empty."""
        ends, inverse, said = self.pieces(pc.fill_null(column.cast(pa.large_string()), ""))
        return ends, inverse, said, np.array([len(e) for e in self.encode(said)], np.int64)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts (null: empty) and the ids of all."""
        ends, inverse, said = self.pieces(pc.fill_null(column.cast(pa.large_string()), ""))
        encoded = self.encode(said)
        lengths = np.array([len(e) for e in encoded], np.int64)
        pool = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
        offset = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        count = lengths[inverse]
        stops = np.concatenate([[0], np.cumsum(count)])
        where = np.arange(stops[-1]) - np.repeat(stops[:-1] - offset[inverse], count)
        return stops[ends], pool[where]
