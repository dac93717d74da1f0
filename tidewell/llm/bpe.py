"""Exact BPE by longest matches and backtracking.

An Aho-Corasick automaton over the vocabulary finds the longest token that begins at a place of a word,
a table the next shorter ones. The encoder walks from left to right, always tries the longest token
first and accepts it only if the pair with the token before it is compatible (byte-pair merging of the two tokens' symbols gives
the two tokens again). A sequence of pairwise compatible tokens is the one that merging gives, and a
prefix has only one, so a place that once led nowhere is never tried again: linear time.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_column, worker_cache

# Fixed values of the tokenizer's file format: white space of the Unicode property, and its pre-token pattern.
WHITE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in prints else chr(spare))
        spare += b not in prints
    return out


#: What an entry of a cache takes besides its key and value: two objects' headers and its slot in the table.
ENTRY_BYTES = 200


class _Cache(dict):
    """Remembers encode(key); of its two generations the older goes when the newer has `limit` bytes."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old, self.size = encode, limit, {}, 0

    def __missing__(self, key):
        if (found := self.old.get(key)) is None:
            found = self.encode(key)
        if self.size >= self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = found
        self.size += len(key) + len(found) + ENTRY_BYTES
        return found


_NONE: dict = {}


class Bpe:
    """Encoder and decoder of a word-level BPE file with byte letters and word ends. Its two caches hold two generations of `cache_bytes` each, its table of pairs `most_pairs`."""

    def __init__(self, path: str, cache_bytes: int = 80 << 20, most_pairs: int = 200_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        self.merge = {}
        for rank, (a, b) in enumerate(pairs):
            self.merge.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.special_first = {t[0] for t in self.special}
        self.pre_re = regex.compile(PRE_TOKEN)
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        names = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.size = max(names) + 1
        self.rank, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.symbols: list[list[int]] = [[] for _ in range(self.size)]
        self.automaton, keys = ahocorasick.Automaton(), {}
        for token, i in ids.items():
            ends = token.endswith(WORD_END) and token != WORD_END
            stem = token.removesuffix(WORD_END) if ends else token
            parts = [*stem[:-1], stem[-1] + WORD_END] if ends else [*stem]
            if all(p in ids for p in parts):
                self.symbols[i] = [ids[p] for p in parts]
                if self._derived(i):
                    key = stem + "\n" * ends
                    self.automaton.add_word(key, i)
                    keys[key] = i
        self.automaton.make_automaton()
        self.length, self.shorter = [0] * self.size, [-1] * self.size  # the longest token that is a prefix of this one
        for key, i in keys.items():
            self.length[i] = len(key)
            self.shorter[i] = next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), -1)
        self.compatible: dict[int, dict[int, bool]] = {}
        self.pairs, self.most_pairs = 0, most_pairs
        pieces = [(" " + names.get(i, "")).encode("utf-8") for i in range(self.size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.words = _Cache(self._word, cache_bytes)
        self.chunks = _Cache(self._chunk, cache_bytes)

    def merged(self, symbols: list[int]) -> list[int]:
        """Plain byte-pair merging: the pair of least rank first, the leftmost of equals."""
        out = list(symbols)
        while len(out) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merge[out[i], out[i + 1]][1]]
        return out

    def _derived(self, token: int) -> bool:
        """Whether merging the token's symbols gives the token; notes its last merge."""
        parts = self.symbols[token]
        while len(parts) > 2:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merge), default=None)
            if best is None:
                return False
            i = best[1]
            parts = [*parts[:i], self.merge[parts[i], parts[i + 1]][1], *parts[i + 2 :]]
        if len(parts) == 2:
            rank, made = self.merge.get(tuple(parts), (-1, -1))
            if made != token:
                return False
            self.rank[token], (self.left[token], self.right[token]) = rank, parts
        return parts[0] == token or len(parts) == 2

    def parted(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b gives a and b. Goes back in time from there: between two
        merges, the pieces on both sides of the border must not have a merge that would come before the
        next one of either; of merges of one rank the left comes first."""
        rank, merge, limit = self.rank, self.merge, len(self.merge) + 1
        while True:
            crossing = merge.get((a, b))
            ra, rb = rank[a], rank[b]
            if crossing is not None and crossing[0] < limit and crossing[0] >= ra and crossing[0] >= rb:
                return False
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """An entry of the pair-compatibility table, made when the pair comes up."""
        if self.pairs >= self.most_pairs:
            self.compatible, self.pairs = {}, 0
        self.pairs += 1
        known = self.compatible.setdefault(a, {})[b] = self.parted(a, b)
        return known

    def word_ids(self, word: str) -> list[int]:
        """The tokens of one pre-token, by longest matches and backtracking."""
        text = word + "\n" if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode("utf-8"))) + "\n"
        compatible, n = self.compatible, len(text)
        out: list[int] = []
        end, fitting = 0, None
        for last, token in self.automaton.iter_long(text):  # the longest matches one after the other, as long as they are compatible
            if fitting is not None and not fitting.get(token):
                break
            out.append(token)
            end = last + 1
            fitting = compatible.get(token, _NONE)
        else:
            if end == n:
                return out
            token = -1
        length, shorter, matches = self.length, self.shorter, self.automaton.iter_long
        dead = {n - 1}  # no token is a word's end alone
        place = end
        while True:
            while token >= 0:
                end = place + length[token]
                if end not in dead:
                    if fitting is None or (fit := fitting.get(token)) or (fit is None and self.fits(out[-1], token)):
                        break
                token = shorter[token]
            else:  # no token leads on from here: the one before gives way to a shorter one
                dead.add(place)
                last = out.pop()
                place, token = place - length[last], shorter[last]
                fitting = self.compatible.get(out[-1], _NONE) if out else None
                continue
            out.append(token)
            if end == n:
                return out
            place, fitting = end, self.compatible.get(token, _NONE)
            token = next(matches(text, end))[1]

    def _word(self, word: str) -> bytes:
        return array("I", self.word_ids(word)).tobytes()

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            if text.isalpha():
                return self._word(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        words = self.pre_re.findall(text)
        return self._word(words[0]) if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def _chunk(self, chunk: bytes) -> bytes:
        """The ids of a run of bytes without ASCII white space; no token and no special token crosses that."""
        text = chunk.decode("utf-8")
        if not any(map(text.__contains__, self.special_first)) or not (hits := list(self.special_re.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in hits:
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, raw: bytes) -> bytes:
        """The ids of a text (UTF-8) as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, raw.split()))

    def decode_many(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each token with the space before it, one after the other, and where each token's begin (the end added)."""
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        at = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(at[-1]) + np.repeat(self.offsets[ids] - at[:-1], lengths)
        return self.blob[source], at

    def decode(self, ids: bytes) -> str:
        """Tokens joined by single spaces: the file names no decoder."""
        return self.decode_many(np.frombuffer(ids, dtype="<u4").astype(np.int64))[0][1:].tobytes().decode("utf-8")


def loaded(path: str, cache_bytes: int = 80 << 20) -> Bpe:
    """One encoder for each worker, file and size of its caches."""
    return worker_cache("bpe", (path, cache_bytes), lambda: Bpe(path, cache_bytes))


def _digests(path: str, decode_tokens: int = 500_000):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = loaded(path)

        def told(ids: list[bytes]) -> list[str]:
            """Decoded digests of a few texts at once."""
            raw, at = bpe.decode_many(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64))
            view, out, k = memoryview(raw), [], 0
            for x in ids:
                a, b = at[k], at[k := k + len(x) // 4]
                out.append(sha256(view[a + 1 : b] if b > a else b"").hexdigest())
            return out

        for batch in batches:
            n, encoded, decoded, held, size = [], [], [], [], 0
            for raw in raw_column(batch, "text"):
                ids = bpe.encode(raw or b"")
                n.append(len(ids) // 4)
                encoded.append(sha256(ids).hexdigest())
                held.append(ids)
                size += n[-1]
                if size > decode_tokens:
                    decoded += told(held)
                    held, size = [], 0
            decoded += told(held)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return run


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs` (doc_id, text); one pass, no shuffle.

    Null and blank texts: no tokens, digests of nothing. A null doc_id stays null. Very long texts: encoded run by run
    between white space, in the memory of their ids. Repeated rows: each is returned. An empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
