"""Exact byte-level BPE ids at corpus speed.

The byte-level pre-tokenizer never lets a token cross a space that is followed by a character
other than white space, so a text is cut there and each chunk is encoded once per worker:
`Encoder` keeps the ids of short chunks (bounded) and hands the new ones of a batch to the
`tokenizers` library in one call. A chunk that is plain Latin letters, perhaps with ASCII
punctuation behind, is one or two pre-tokens, so the library's BPE model gets them directly; every
other chunk goes through the whole tokenizer. A text with the literal of an added token (an end
marker, say) goes through it uncut. The ids are those of encoding the whole text at once.
"""

from __future__ import annotations

import re
from array import array

#: Chunks whose ids a worker keeps, and the longest one worth keeping.
CACHE_ENTRIES, CACHE_CHARS = 3 << 17, 40
_ODD = re.compile(r" (?:\s|\Z)")
#: ASCII punctuation, all of which the pre-tokenizer puts in one run.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def chunks(text: str) -> list[str]:
    """The text in pieces; all but the first begin at a dropped single space."""
    parts = text.split(" ")
    if not _ODD.search(text):
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Literals that the library takes out of a text before it is cut into pre-tokens.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.kept: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of chunks not kept, each with its leading space."""
        cut, whole, cores = {}, [], {}
        for p in parts:
            core = p.rstrip(_MARKS)
            if core.isalpha() and max(core) < "\u0250":
                cut[p] = core
                if core not in self.kept:
                    cores[core] = 1
            else:
                whole.append(p)
        names = list(cores)
        shaped = [self.space + c if c.isascii() else self.space + c.encode().decode("latin-1").translate(self.letters) for c in names]
        cores = {c: array("I", [t.id for t in self.merge(x)]).tobytes() for c, x in zip(names, shaped)}
        out = dict(zip(whole, self._ids(self.tokenizer, [" " + p for p in whole])))
        kept, marks = self.kept, self.marks
        for p, core in cut.items():
            tail = p[len(core):]
            if tail not in marks:
                ids = self._ids(self.tokenizer, [tail])[0]
                if len(marks) < 4096 and len(tail) <= CACHE_CHARS:
                    marks[tail] = ids
            else:
                ids = marks[tail]
            out[p] = (cores[core] if core in cores else kept[core]) + ids
        if len(kept) < CACHE_ENTRIES:
            kept.update((p, b) for d in (cores, out) for p, b in d.items() if len(p) <= CACHE_CHARS)
        return out

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; one that holds an added token's literal goes through the whole tokenizer."""
        odd = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if not odd:
            return self._batch(texts)
        out = self._batch(["" if t and any(a in t for a in self.added) else t for t in texts])
        for i, ids in zip(odd, self._ids(self.tokenizer, [texts[i] for i in odd])):
            out[i] = ids
        return out

    def _batch(self, texts: list[str | None]) -> list[bytes]:
        rows, holes, new, get = [], [], set(), self.kept.get
        for t in texts:
            parts = chunks(t) if t else [""]
            first = parts[0]
            parts[0] = ""
            ids = list(map(get, parts))
            at = [i for i, b in enumerate(ids) if b is None]
            miss = [parts[i] for i in at[1:]]
            new.update(miss)
            rows.append((first, ids))
            holes.append((at, miss))
        own = self._new(list(new))
        firsts = self._ids(self.tokenizer, [first for first, _ in rows])
        out = []
        for (_, ids), (at, miss), head in zip(rows, holes, firsts):
            for i, p in zip(at[1:], miss):
                ids[i] = own[p]
            ids[0] = head
            out.append(b"".join(ids))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
