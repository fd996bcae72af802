"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece of text there is exactly one token that can end its
BPE encoding: the token ``t`` such that the last token ``p`` of the prefix before it and
``t`` stay apart when ``p + t`` is encoded.  Storing that one last token for each prefix
gives the encoding of any prefix by walking back, makes appends exact (earlier entries
never change) and lets an edit be re-encoded from where it starts to where the entries
agree with the old ones again (:class:`PrefixTable`).

Vocabulary files (base64 token, rank on each line) are given by path and never trained.
A text is first split by the vocabulary's pattern, as its public encoder does; each
distinct piece is encoded once for each worker while its bounded cache holds it.

Defined results of :func:`encode`: a null text has null tokens and counts, an empty text an
empty list; whole texts are encoded whatever their length; repeated rows give repeated
rows; an empty table an empty result; ``round_trip`` says that the decoded bytes are the text.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._spark import read, text_documents

RANKS = os.environ.get("WORDLOOM_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_END = r"'s|'t|'re|'ve|'m|'ll|'d"
_WIDE = regex.compile(_END + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_NARROW = re.compile(_END + f"| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_CACHE = 300_000
_PREFIXES = 600_000
#: a longer piece has a table of its own
_LONG = 64


def pieces(text: str) -> list[str]:
    """The pieces between which no merge happens; texts in Latin-1 take an equal pattern without property tables."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE.findall(text)
    return _NARROW.findall(text)


class Vocabulary:
    """Ranks, tokens, and how each token was last merged."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        #: rank of each token, -1 of what is only the end of a token
        self.ends: dict[bytes, int] = {}
        for t, r in self.ranks.items():
            self.tokens[r] = t
            for k in range(1, len(t)):
                self.ends.setdefault(t[k:], -1)
        self.ends |= self.ranks
        self.packed = [np.int32(r).tobytes() for r in range(len(self.tokens))]
        self.splits: dict[int, tuple[int, int]] = {}
        self.apart: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        #: the last token of each prefix met so far; with a prefix, all that it begins with are there
        self.prefixes: dict[bytes, int] = {}
        self.size = [len(t) for t in self.tokens]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens of the last merge into ``token``; itself twice for a byte."""
        have = self.splits.get(token)
        if have is None:
            raw = self.tokens[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            have = (token, token) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[-1]])
            self.splits[token] = have
        return have

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` then ``b`` gives these two tokens: no merge across the border comes before the merges that made them."""
        key = a << 20 | b
        have = self.apart.get(key)
        if have is None:
            if len(self.apart) >= 2 * _CACHE:
                self.apart.clear()
            have = self.apart[key] = self._stay_apart(a, b)
        return have

    def _stay_apart(self, a: int, b: int) -> bool:
        # Undo the merges of both sides, latest first; a pair across the border that would have merged before the undone merge forbids the border.
        tokens, ranks, undone = self.tokens, self.ranks, len(self.tokens)
        while True:
            joint = ranks.get(tokens[a] + tokens[b])
            if joint is not None and joint < undone:
                return False
            single_a, single_b = len(tokens[a]) == 1, len(tokens[b]) == 1
            if single_a and single_b:
                return True
            if single_b or (not single_a and a > b):
                undone, a = a, self.split(a)[1]
            else:  # of two equal merges the left one comes first, so a joint merge of the same rank is still earlier
                undone, b = b + 1, self.split(b)[0]

    def last_token(self, raw: bytes, i: int, last: list[int]) -> int:
        """The only token that can end the encoding of raw[:i], given those of the shorter prefixes."""
        ends, found, j = self.ends, [], i - 1
        while j >= 0:
            t = ends.get(raw[j:i])
            if t is None:
                break
            if t >= 0:
                found.append((t, j))
            j -= 1
        for t, j in reversed(found):
            if j == 0 or self.stay_apart(last[j], t):
                return t
        raise ValueError("a byte is missing from the vocabulary")

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) > _LONG:
            return PrefixTable(self, raw).encode()
        # The table of prefixes is shared by all pieces: of a new piece only the prefixes that none before it had are worked out.
        known, size, n = self.prefixes, self.size, len(raw)
        if len(known) >= _PREFIXES:
            known.clear()
        i = n
        while i and raw[:i] not in known:
            i -= 1
        ranks, ends, apart = self.ranks.get, self.ends.get, self.apart.get
        while i < n:
            i += 1
            head = raw[:i]
            t = ranks(head)
            if t is None:
                found, j = [], i - 1
                while j:
                    t = ends(raw[j:i])
                    if t is None:
                        break
                    if t >= 0:
                        found.append((t, j))
                    j -= 1
                while found:
                    t, j = found.pop()
                    p = known[raw[:j]]
                    ok = apart(p << 20 | t)
                    if ok or (ok is None and self.stay_apart(p, t)):
                        break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
            known[head] = t
        out = []
        while n:
            t = known[raw[:n]]
            out.append(t)
            n -= size[t]
        return out[::-1]

    def encode_packed(self, text: str) -> bytes:
        """The token ids of a text as little-endian 32-bit integers."""
        cache, parts = self.cache, []
        for p in pieces(text):
            ids = cache.get(p)
            if ids is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                ids = b"".join([self.packed[t] for t in self.encode_piece(p.encode())])
                if len(p) <= 64:
                    cache[p] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<i4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def walk_back(last: list[int], tokens: list[bytes]) -> list[int]:
    out, i = [], len(last) - 1
    while i > 0:
        out.append(last[i])
        i -= len(tokens[last[i]])
    return out[::-1]


class PrefixTable:
    """The last token of each prefix of one piece that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", [-1]
        self.longest = max(map(len, vocabulary.tokens))
        #: prefixes worked out so far, to see what an edit cost
        self.worked = 0
        self.append(raw)

    def append(self, raw: bytes) -> None:
        """Exact, and without touching earlier entries."""
        self.raw += raw
        for i in range(len(self.last), len(self.raw) + 1):
            self.last.append(self.vocabulary.last_token(self.raw, i, self.last))
            self.worked += 1

    def encode(self, upto: int | None = None) -> list[int]:
        """The tokens of raw[:upto]."""
        return walk_back(self.last if upto is None else self.last[: upto + 1], self.vocabulary.tokens)

    def edit(self, at: int, remove: int, insert: bytes) -> None:
        """Replace ``remove`` bytes at ``at``; works from ``at`` until as many entries as the longest token agree with the old ones."""
        old, tail = self.last, self.raw[at + remove :]
        self.raw = self.raw[:at] + insert + tail
        self.last, shift, same = old[: at + 1], len(insert) - remove, 0
        for i in range(at + 1, len(self.raw) + 1):
            t = self.vocabulary.last_token(self.raw, i, self.last)
            self.last.append(t)
            self.worked += 1
            same = same + 1 if i - shift > at + remove and old[i - shift] == t else 0
            if same >= self.longest:
                self.last += old[i - shift + 1 :]
                break


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once for each worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, token_ids, n_tokens, n_bytes, round_trip) of each row of ``docs``."""

    def run(batches):
        v = vocabulary(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed, sizes, n_bytes, same, nulls = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = v.encode_packed(text or "")
                    raw = (text or "").encode()
                    packed.append(ids)
                    sizes.append(len(ids) // 4)
                    n_bytes.append(len(raw))
                    same.append(v.decode(np.frombuffer(ids, dtype="<i4").tolist()) == raw)
                    nulls.append(text is None)
                null = np.array(nulls)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(offsets, values), pa.array(np.array(sizes, dtype=np.int64), mask=null), pa.array(np.array(n_bytes, dtype=np.int64), mask=null), pa.array(same, mask=null)],
                    ["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"],
                )

    return text_documents(docs).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); bytes that are not UTF-8 become U+FFFD, null tokens a null text."""

    def run(batches):
        v = vocabulary(ranks)
        for batch in batches:
            texts = [None if ids is None else v.decode(ids).decode("utf-8", "replace") for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
