"""Token counts for a lower-casing word BPE vocabulary, with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone by the library; those
that come back as exactly their own id form the proven set. At count time a text is cut
at ASCII white space, each distinct chunk of a task is normalised and cut into pre-tokens
once, a pre-token of the proven set counts as one token without any merging, and only the
rest goes through the merges (the library's model; whole chunks with letters beyond Latin
or special strings go to its encoder). No merge crosses a pre-token, so
the sums are the library's own counts.

A null text counts as empty (0 bytes, 0 tokens); a text of any length is counted as a whole;
repeated rows and rows without an id keep their rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid

import regex
from pyspark.sql import DataFrame

from modelwatch.llm.common import per_text

#: White space of str.split that the tokenizer's pattern may see otherwise.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ASCII_SPACE = re.compile("[\t-\r ]+")
#: Letters whose classes every Unicode version agrees on (Latin); others ask the library.
BEYOND_LATIN = re.compile("[^\\x00-ɏ]").search
CACHE, CHARS = 600_000, 4_000_000
#: The counter of this Python worker, by the id of its model; tasks of one worker share it.
_OWN: dict[str, "Counter"] = {}


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_whole(spec: str) -> frozenset[str]:
    """Surface strings that the tokenizer of JSON ``spec`` encodes alone as one token."""
    from tokenizers import Tokenizer
    tok, letters, found = Tokenizer.from_str(spec), byte_letters(), {}
    end = json.loads(spec)["model"]["end_of_word_suffix"] or ""
    for piece, i in tok.get_vocab(with_added_tokens=False).items():
        if piece.endswith(end) and len(piece) > len(end):
            try:
                found[bytes(letters[c] for c in piece[: len(piece) - len(end)]).decode("utf-8")] = i
            except (KeyError, UnicodeDecodeError):
                continue
    names = list(found)
    codes = tok.encode_batch(names, add_special_tokens=False)
    return frozenset(s for s, e in zip(names, codes) if e.ids == [found[s]])


class Counter:
    def __init__(self, spec: str, whole: frozenset[str]):
        from tokenizers import Tokenizer
        self.tok, self.whole, self.seen = Tokenizer.from_str(spec), whole, {"": 0}
        model = json.loads(spec)
        self.special = tuple(t["content"] for t in model["added_tokens"])
        self.cut = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.merge = self.tok.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}

    def one(self, chunk: str) -> int:
        """Tokens of one chunk: the shortcut where it holds, merges for the rest."""
        if BEYOND_LATIN(chunk) or any(s in chunk for s in self.special):
            return len(self.tok.encode(chunk, add_special_tokens=False).ids)
        norm = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()
        if norm in self.whole:
            return 1
        if BEYOND_LATIN(norm):
            return len(self.tok.encode(chunk, add_special_tokens=False).ids)
        n = 0
        for p in self.cut(norm):
            n += 1 if p in self.whole else len(self.merge(p.encode().decode("latin-1").translate(self.letters)))
        return n

    def count(self, texts: list[str]) -> list[int]:
        split = [ASCII_SPACE.split(t) if ODD_SPACE.search(t) else t.split() for t in texts]
        every: set[str] = set()
        for words in split:
            every.update(words)
        if len(self.seen) > CACHE:
            self.seen = {w: self.seen[w] for w in every if w in self.seen}
        for w in every.difference(self.seen):
            self.seen[w] = self.one(w)
        return [sum(map(self.seen.__getitem__, words)) for words in split]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for the vocabulary at ``path``."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    uid = uuid.uuid4().hex
    model = spark.sparkContext.broadcast((spec, proven_whole(spec)))

    def make():
        counter = _OWN.get(uid)
        if counter is None:
            _OWN.clear()
            counter = _OWN[uid] = Counter(*model.value)

        def work(texts):
            texts = [t or "" for t in texts]
            n = counter.count(texts)
            return {"n_bytes": [len(t.encode("utf-8", "replace")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}
        return work

    return per_text(docs, ["doc_id"], make, "n_bytes long, n_tokens long, over_limit boolean", CHARS)
