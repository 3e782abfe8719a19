"""Token ids exactly as the tokenizers library gives them, with each distinct pre-token merged once.

A byte-level BPE never merges across pre-tokens, so a text's ids are the ids of its pre-tokens in a row.
``Encoder`` cuts a text into pre-tokens itself when every character is one whose class no Unicode
version disputes, takes known pre-tokens from a bounded memo, and has the library encode the others
together, parted by a separator whose ids tell the parts from each other. Any other text, and any that
may hold a special token's string, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters whose class (letter, number, space, other) and lower case are beyond dispute.
_PLAIN = [c for r in ((9, 11), (13, 14), (32, 127), (0xA1, 0x130), (0x131, 0x250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)) for c in map(chr, range(*r))]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


_L, _N, _S = _class("L"), _class("N"), "\t\n\r "
_plain = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]*").fullmatch
#: The two pre-tokenisation rules that are known here, over plain characters. The patterns of the tokenizer files.
_BYTE_RULE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_RULE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _kind(spec: dict) -> str:
    """'byte', 'word', or '' for a tokenizer whose rule isn't one of the two."""
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or spec.get("truncation") or spec.get("padding"):
        return ""
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps, norms = pre.get("pretokenizers") or [], (norm or {}).get("normalizers") or []
    if [x["type"] for x in norms] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _WORD_PATTERN} and steps[0]["invert"] and model.get("end_of_word_suffix") == "</w>":
        return "word"
    return ""


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, bound: int = 320_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.kind, self.bound, self.memo = Tokenizer.from_file(path), _kind(spec), bound, {}
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.vocab_size = self.tokenizer.get_vocab_size()
        if self.kind == "word":
            self.ends = np.zeros(self.vocab_size + 1, dtype=bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith("</w>")
        elif self.kind == "byte":
            self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
            if len(self.newline) != 1:
                self.kind = ""

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens; None: the text is for the library whole."""
        if not self.kind or not _plain(text) or any(s in text for s in self.special):
            return None
        return _BYTE_RULE.findall(text) if self.kind == "byte" else _WORD_RULE.findall(text.lower())

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, each as if it stood alone."""
        out, rows = {}, []
        for p in pieces:
            if self.kind == "byte" and p.isspace():
                out[p] = self.whole(p)
            else:
                rows.append(p)
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([("\n" if self.kind == "byte" else " ").join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(ids == self.newline[0]) if self.kind == "byte" else np.flatnonzero(self.ends[ids]) + 1
            if self.kind == "byte":
                starts, stops = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(ids)]))
            else:
                starts, stops = np.concatenate(([0], cut[:-1])), cut
            if len(starts) != len(part):
                out |= {p: self.whole(p) for p in part}
                continue
            raw = ids.tobytes()
            out |= {p: raw[4 * a : 4 * b] for p, a, b in zip(part, starts.tolist(), stops.tolist(), strict=True)}
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        memo = self.memo
        if missing := list(set().union(*(c for c in cut if c)).difference(memo)):
            memo.update(self.learn(missing))
        out = [self.whole(t) if c is None else b"".join(map(memo.__getitem__, c)) for t, c in zip(texts, cut, strict=True)]
        forget(memo, missing, self.bound)
        return out


def forget(memo: dict, latest: list[str], bound: int) -> None:
    """A full memo keeps what came first, in which the frequent pre-tokens are; the latest go, to be merged anew when met again."""
    if len(memo) > bound:
        for p in latest:
            del memo[p]


@cache
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)


def in_parts(texts: pa.Array, rows: int = 256):
    """Runs of an Arrow column as Python strings, so that few texts are held twice."""
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()
