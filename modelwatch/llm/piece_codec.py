"""Encoding to and decoding from a SentencePiece vocabulary by batched Viterbi.

Words of equal length advance together as one matrix of code points. For every end column
and piece length, the substring's rolling hash probes the sorted piece keys; the last
piece of each prefix is kept as its backpointer, and vectorised maxima choose it.

The public vocabulary is a merge (BPE) model: its scores are merge priorities, so the
plain best-sum path would not be the model's encoding. The path search therefore scores a
step from piece ``a`` to piece ``b`` as allowed only if the merges leave ``a`` and ``b``
apart when the two stand alone. Under that rule exactly one path reaches every prefix,
and it is the encoding of the merges (compared with the library in the tests). Characters
outside the vocabulary are one step of their own and become byte pieces.

A null text counts as empty; a text without characters gives no pieces; a text of any length
is encoded as a whole; words over ``LONG`` characters and runs of spaces are searched one at a
time by the same rule; repeated rows and rows without an id keep their rows; an empty table
gives an empty result; other columns are ignored. A text that itself holds the space mark comes back with a space there, as
with the library; ``round_trip`` is false for it.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame

from modelwatch.llm.common import per_text

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Fixed odd multiplier of the rolling hash; longest word of the batched path; words that a
#: worker remembers from one chunk to the next.
BASE, LONG, CACHE = np.uint64(0x9E3779B97F4A7C15), 48, 150_000
#: Slots for remembered pairs (the only place they are kept); characters encoded at a time.
SLOT_BITS, CHARS = 20, 2_000_000
SLOTS = 1 << SLOT_BITS
#: The codec of this Python worker, by the id of its model; tasks of one worker share it.
_OWN: dict[str, "Codec"] = {}


def load_vocabulary(path: str) -> dict:
    """Plain tables of the model file: pieces with scores, byte pieces, output bytes."""
    import sentencepiece
    with open(path, "rb") as f:
        p = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    text, score, out = {}, {}, []
    for i in range(p.get_piece_size()):
        s = p.id_to_piece(i)
        if p.is_byte(i):
            out.append(bytes([int(s[3:5], 16)]))
            text.setdefault("bytes", {})[int(s[3:5], 16)] = i
        elif p.is_control(i) or p.is_unknown(i):
            out.append(b" \xe2\x81\x87 " if p.is_unknown(i) else b"")
        else:
            out.append(s.replace(MARK, " ").encode())
            score[s] = (i, p.get_score(i))
    if any(MARK in s.lstrip(MARK) for s in score):
        raise ValueError("pieces that hold a space mark after a letter are not supported")
    return {"score": score, "bytes": text.get("bytes", {}), "unk": p.unk_id(), "out": out}


class Codec:
    def __init__(self, v: dict):
        self.score, self.byte_id, self.unk, self.out = v["score"], v["bytes"], v["unk"], v["out"]
        self.name = {i: s for s, (i, _) in self.score.items()}
        self.longest = max(map(len, self.score), default=1)
        self.power = np.cumprod(np.full(LONG + 2, BASE, dtype=np.uint64))
        keys = np.array([self._key(s) for s in self.score], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _ in self.score.values()], dtype=np.int64)[order]
        if len(keys) and (np.diff(self.keys) == 0).any():
            raise ValueError("piece keys collide; change the multiplier")
        self.maybe = np.zeros(1 << 20, dtype=bool)          # first look: some key has these leading bits
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.slot_key = np.full(SLOTS, -1, dtype=np.int64)   # one remembered pair per slot
        self.slot_ok = np.zeros(SLOTS, dtype=bool)
        self.words: dict[str, bytes] = {}

    def _key(self, s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        return (h ^ (len(s) << 56)) % (1 << 64)

    def merge(self, s: str) -> list[str]:
        """The merges themselves on a short string: best score first, then leftmost."""
        sym = list(s)
        while True:
            best, at = None, -1
            for k in range(len(sym) - 1):
                e = self.score.get(sym[k] + sym[k + 1])
                if e and (best is None or e[1] > best):
                    best, at = e[1], k
            if at < 0:
                return sym
            sym[at:at + 2] = [sym[at] + sym[at + 1]]

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave two pieces apart."""
        x, y = self.name[a], self.name[b]
        return self.merge(x + y) == [x, y]

    def allowed(self, a: int, b: int) -> bool:
        return bool(self.allowed_all(np.array([(a << 32) | b]))[0])

    def allowed_all(self, key: np.ndarray) -> np.ndarray:
        """``apart`` for packed pairs; answers come from the slots, misses are worked out."""
        slot = ((key.astype(np.uint64) * BASE) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_ok[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            uniq, inv = np.unique(key[miss], return_inverse=True)
            ok = np.array([self.apart(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in uniq], dtype=bool)
            out[miss] = ok[inv]
            first = np.zeros(len(uniq), dtype=np.int64)
            first[inv] = slot[miss]
            self.slot_key[first], self.slot_ok[first] = uniq, ok
            same = self.slot_key[first] == uniq          # of pairs that share a slot the last one stays
            self.slot_ok[first[same]] = ok[same]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of words that all have the same length."""
        n, m = len(words[0]), len(words)
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(m, n).astype(np.uint64)
        pre = np.zeros((n + 1, m), dtype=np.uint64)
        for j in range(n):
            pre[j + 1] = pre[j] * BASE + cp[:, j] + np.uint64(1)
        last = np.full((n + 1, m), -1, dtype=np.int64)   # last piece of the prefix; -1: a character outside
        back = np.ones((n + 1, m), dtype=np.int64)       # its length: the backpointer
        for j in range(1, n + 1):
            best = np.full(m, -np.inf)
            for size in range(1, min(self.longest, j) + 1):
                h = (pre[j] - pre[j - size] * self.power[size - 1]) ^ np.uint64(size << 56)
                hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
                same = self.keys[at] == h[hit]
                hit, at = hit[same], at[same]
                if not len(hit):
                    continue
                piece, prev = self.ids[at], last[j - size][hit]
                ok = np.full(len(hit), j == size) | (prev < 0)
                ask = np.flatnonzero(~ok)
                if len(ask):
                    ok[ask] = self.allowed_all((prev[ask] << 32) | piece[ask])
                value = np.where(ok, float(size), -np.inf)
                win = value > best[hit]
                k = hit[win]
                best[k], last[j][k], back[j][k] = value[win], piece[win], size
        # Walk the backpointers of all words together, from the end; rows fill from the right.
        ids, used = np.zeros((m, n), dtype="<i4"), np.zeros(m, dtype=np.int64)
        col, live, odd = np.full(m, n), np.arange(m), np.zeros(m, dtype=bool)
        while len(live):
            c = col[live]
            p = last[c, live]
            odd[live] |= p < 0
            used[live] += 1
            ids[live, n - used[live]] = np.where(p < 0, -c, p)
            col[live] = c - back[c, live]
            live = live[col[live] > 0]
        raw, out = ids.tobytes(), []
        for w, (k, strange) in enumerate(zip(used.tolist(), odd.tolist())):
            out.append(self._ids(words[w], ids[w, n - k:].tolist()) if strange else raw[4 * (w * n + n - k): 4 * (w + 1) * n])
        return out

    def _ids(self, word: str, steps: list[int]) -> bytes:
        ids = []
        for p in steps:
            if p >= 0:
                ids.append(p)
            else:  # the character that ends at column -p
                raw = word[-p - 1].encode("utf-8", "replace")
                ids += [self.byte_id[b] for b in raw] if self.byte_id else [self.unk]
        return np.array(ids, dtype="<i4").tobytes()

    def long_word(self, word: str) -> bytes:
        """The same search for one long word, and plain merges for runs of spaces."""
        if word.startswith(MARK * 2) and len(word) <= LONG:
            steps, at = [], 0
            for s in self.merge(word):
                at += len(s)
                steps.append(self.score[s][0] if s in self.score else -at)
            return self._ids(word, steps)
        n = len(word)
        last, back = [-1] * (n + 1), [1] * (n + 1)
        for j in range(1, n + 1):
            for size in range(min(self.longest, j), 0, -1):
                e = self.score.get(word[j - size:j])
                if e and (j == size or last[j - size] < 0 or self.allowed(last[j - size], e[0])):
                    last[j], back[j] = e[0], size
                    break
        steps, j = [], n
        while j:
            steps.append(last[j] if last[j] >= 0 else -j)
            j -= back[j]
        return self._ids(word, steps[::-1])

    def learn(self, words: set[str]) -> None:
        groups: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONG or w.startswith(MARK * 2):
                self.words[w] = self.long_word(w)
            else:
                groups.setdefault(len(w), []).append(w)
        for same in groups.values():
            for lo in range(0, len(same), 20_000):
                part = same[lo:lo + 20_000]
                self.words.update(zip(part, self.viterbi(part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        every: set[str] = set()
        for words in cut:
            every.update(words)
        if len(self.words) > CACHE:
            self.words = {w: self.words[w] for w in every if w in self.words}
        missing = every.difference(self.words)
        if missing:
            self.learn(missing)
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        out = b"".join(map(self.out.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))
        return out[1:] if out[:1] == b" " else out


def piece_codes(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids (array of int, if ``with_ids``), ids_crc32 (of the ids as
    little-endian int32), round_trip (decoding the ids gives the text back)."""
    model = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    uid = uuid.uuid4().hex

    def make():
        codec = _OWN.get(uid)
        if codec is None:
            _OWN.clear()
            codec = _OWN[uid] = Codec(model.value)

        def work(texts):
            texts = [t or "" for t in texts]
            codes = codec.encode(texts)
            return {"n_pieces": [len(c) // 4 for c in codes],
                    **({"ids": [np.frombuffer(c, dtype="<i4") for c in codes]} if with_ids else {}),
                    "ids_crc32": [zlib.crc32(c) for c in codes],
                    "round_trip": [codec.decode(c) == t.encode("utf-8", "replace") for c, t in zip(codes, texts)]}
        return work

    return per_text(docs, ["doc_id"], make, f"n_pieces long, {'ids array<int>, ' if with_ids else ''}ids_crc32 long, round_trip boolean", CHARS)
