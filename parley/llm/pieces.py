"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Words (a run of word starts and what follows up to the next one) are encoded together: one flat array of symbols, and in
each round the pair of least rank in every word is merged, leftmost first, until no word has a pair that the model knows.
A pair that occurs several times in a word is merged at all places at once where the model's ranks allow it, else only at
the leftmost place, so that the result is that of one merge at a time. A task keeps the words it has met in a bounded table.

A long word is cut first at places that no piece standing there reaches over, so that rounds are as many as its longest part
needs. What stays quadratic is a word in which pieces overlap all along: its parts are long.

Null text: as the empty text, no ids. Repeated rows: each row is encoded. Very long texts and words are encoded whole. An empty
table gives no row. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.wordtable import BYTES_KEPT, WORDS_KEPT, Known, Strings

SPACE = "▁"
NO_PAIR = np.int64(1) << 40
#: Words of more characters are cut before they are merged.
LONG = 64
_POWER = np.multiply.accumulate(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
_WORD = re.compile(r" *[^ ]+| +")


class PieceModel:
    """The pieces, ranks and pair table of one SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that cross a word's border are not supported")
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes_of = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
            self.bytes_of.append(bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(SPACE, " ").encode() if kind == 1 else b"")
        self.is_byte = np.array([kind == 6 for _, _, kind in pieces])
        if (self.byte_ids < 0).any():
            raise ValueError("byte fallback is needed")
        score = {i: s for i, (_, s, kind) in enumerate(pieces) if kind == 1}
        # symbols: ids of pieces; characters that aren't pieces get numbers above them while they are merged
        self.size = len(pieces)
        left, right, made, rank = [], [], [], []
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        early = set()  # pieces that a larger piece of an earlier rank contains at an end: only one merge at a time
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                for part in (a, b):
                    if part is not None and order[score[part]] >= order[score[i]]:
                        early.add(part)
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i), rank.append(order[score[i]])
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        sort = np.argsort(key)
        self.keys, self.made, self.rank = key[sort], np.array(made)[sort], np.array(rank, np.int64)[sort]
        self.one_by_one = np.zeros(self.size, bool)
        self.one_by_one[list(early)] = True
        # by length, the hashes of all beginnings of pieces, sorted, and which of them are whole pieces
        begins: dict[int, dict[int, bool]] = {}
        for p in self.ids:
            h = 0
            for k, c in enumerate(p):
                h = (h + (ord(c) + 1) * int(_POWER[k])) & 0xFFFFFFFFFFFFFFFF
                level = begins.setdefault(k + 1, {})
                level[h] = level.get(h, False) or k + 1 == len(p)
        self.begins = []
        for k in range(1, len(begins) + 1):
            hashes = np.array(sorted(begins[k]), np.uint64)
            self.begins.append((hashes, np.array([begins[k][h] for h in hashes.tolist()])))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, -1 where it has none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (a < self.size) & (b < self.size)
        return np.where(known, at, -1)

    def cuts(self, word: str) -> np.ndarray:
        """Places in a word that no piece which stands there reaches over: no merge ever goes across them."""
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(chars)
        over = np.zeros(n + 1, np.int64)  # opened and closed reaches of pieces
        at, h = np.arange(n), np.zeros(n, np.uint64)
        for k, (hashes, whole) in enumerate(self.begins):
            inside = at + k < n
            at, h = at[inside], h[inside]
            h = h + chars[at + k] * _POWER[k]
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[found] == h
            at, h, found = at[known], h[known], found[known]
            if k:
                piece = at[whole[found]]  # covers piece + 1 to piece + k
                over += np.bincount(piece + 1, minlength=n + 1)[: n + 1]
                over -= np.bincount(piece + k + 1, minlength=n + 1)[: n + 1]
            if not len(at):
                break
        return np.flatnonzero(np.cumsum(over)[1:n] == 0) + 1

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has; words come with their word starts.

        A long word is cut where no piece reaches over, and its parts are merged side by side.
        """
        parts, number = [], np.ones(len(words), np.int64)
        for i, w in enumerate(words):
            if len(w) > LONG:
                border = [0, *self.cuts(w).tolist(), len(w)]
                parts += [w[a:b] for a, b in zip(border[:-1], border[1:], strict=True)]
                number[i] = len(border) - 1
            else:
                parts.append(w)
        ids, counts = self._encode_parts(parts)
        if len(parts) > len(words):
            counts = np.add.reduceat(counts, np.cumsum(number) - number)
        return ids, counts

    def _encode_parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        found, back = np.unique(chars, return_inverse=True)
        symbols = np.array([self.ids.get(chr(c), self.size + c) for c in found], np.int64)[back]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        pair = self._next_pairs(symbols, owner, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], NO_PAIR)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(rank, starts)
            number = np.diff(np.append(starts, len(symbols)))
            if (least == NO_PAIR).any():
                ended = np.repeat(least == NO_PAIR, number)
                done.append((owner[ended], symbols[ended]))
                symbols, owner, pair, rank = (x[~ended] for x in (symbols, owner, pair, rank))
                if not len(symbols):
                    break
                live = least < NO_PAIR
                least, number = least[live], number[live]
            at = np.flatnonzero(rank == np.repeat(least, number))
            word = owner[at]
            first = np.concatenate(([True], word[1:] != word[:-1]))
            lead = at[first][np.cumsum(first) - 1]
            # equal pairs side by side overlap: every second one is merged, from the left; pairs of one rank that
            # differ, and pieces that an earlier rank extends, wait for the next round
            begins = np.concatenate(([True], at[1:] != at[:-1] + 1))
            place = np.arange(len(at))
            even = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
            at = at[first | (even & (pair[at] == pair[lead]) & ~self.one_by_one[self.made[pair[lead]]])]
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            now = (np.cumsum(keep) - 1)[at]
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            for changed in (now, now[now > 0] - 1):
                pair[changed] = self._next_pairs(symbols, owner, changed)
        owners = np.concatenate([o for o, _ in done])
        symbols = np.concatenate([s for _, s in done])
        sort = np.argsort(owners, kind="stable")
        return self._fallback(owners[sort], symbols[sort], len(words))

    def _next_pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(symbols) - 1)
        pair = self.pairs(symbols[at], symbols[after])
        return np.where((owner[at] == owner[after]) & (after > at), pair, -1)

    def _fallback(self, owners: np.ndarray, symbols: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that aren't pieces become the ids of their bytes."""
        other = symbols >= self.size
        if other.any():
            found, back = np.unique(symbols[other], return_inverse=True)
            raw = [chr(c - self.size).encode() for c in found.tolist()]
            table = np.zeros((len(raw), 4), np.int64)
            for i, r in enumerate(raw):
                table[i, : len(r)] = self.byte_ids[list(r)]
            width = np.ones(len(symbols), np.int64)
            width[other] = np.array([len(r) for r in raw])[back]
            row = np.repeat(np.arange(len(symbols)), width)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            which = np.zeros(len(symbols), np.int64)
            which[other] = back
            symbols = np.where(other[row], table[which[row], inside], symbols[row])
            owners = owners[row]
        return symbols, np.bincount(owners, minlength=words)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: bytes that make no UTF-8 become U+FFFD, one for each; the first space of the prefix goes."""
        ids = np.asarray(ids, np.int64)
        text = self._joined(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _joined(self, ids: np.ndarray) -> str:
        of = self.bytes_of
        raw = b"".join([of[i] for i in ids.tolist()])
        if not self.is_byte[ids].any():
            return raw.decode()
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return lossy(raw)


def lossy(raw: bytes) -> str:
    """Decode UTF-8 with U+FFFD for every byte that is part of no character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes the texts of one task; keeps for each word met its ids as decimal text, their number and decoded bytes."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.decimals = Strings.of([b"%d," % i for i in range(model.size)])
        self.raw = Strings.of(model.bytes_of)
        self.forget()

    def forget(self) -> None:
        self.known, self.ids_of, self.text_of, self.number = Known(), Strings(), Strings(), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text if self.model.prefix else text
        if "  " in text or text[-1] == " " or text[0] != " " or SPACE in text:
            return _WORD.findall(text.replace(SPACE, " "))
        return text[1:].split(" ")

    def learn(self) -> None:
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            # a word from words() has no word start in front; those of _WORD have theirs
            ids, counts = self.model.encode_words([w.replace(" ", SPACE) if " " in w else SPACE + w for w in fresh])
            for table, kept in ((self.decimals, self.ids_of), (self.raw, self.text_of)):
                data, border = table.joined(ids, counts)
                kept.add(data, np.diff(border))
            self.number = np.concatenate((self.number, counts))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, and how many each text has."""
        if len(self.known) > WORDS_KEPT or self.ids_of.used > BYTES_KEPT:
            self.forget()
        get = self.known.__getitem__
        found = [np.fromiter(map(get, w), np.int64, len(w)) for w in map(self.words, texts)]
        self.learn()
        return np.concatenate([np.zeros(0, np.int64), *found]), np.array([len(x) for x in found], np.int64)

    def ids(self, text: str) -> np.ndarray:
        data, _ = self.ids_of_texts([text])
        return np.array(data.tobytes()[:-1].split(b","), np.int64) if len(data) else np.zeros(0, np.int64)

    def ids_of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = self.numbers(texts)
        return self.ids_of.joined(numbers, counts)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        numbers, counts = self.numbers(texts)
        total = np.concatenate(([0], np.cumsum(self.number[numbers])))[np.concatenate(([0], np.cumsum(counts)))]
        ids, a = self.ids_of.joined(numbers, counts)
        text, b = self.text_of.joined(numbers, counts)
        ids, text = memoryview(ids), text.tobytes()
        for n, p, q, r, t in zip(np.diff(total).tolist(), a[:-1].tolist(), a[1:].tolist(), b[:-1].tolist(), b[1:].tolist(), strict=True):
            raw = text[r:t]
            if not raw.isascii():
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    raw = lossy(raw).encode()
            if self.model.prefix and raw[:1] == b" ":
                raw = raw[1:]
            yield n, hashlib.sha256(ids[p : max(p, q - 1)]).hexdigest(), hashlib.sha256(raw).hexdigest()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks find the words of earlier ones."""
    return Encoder(load(path))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. model_path: there on every executor."""
    from parley.llm.shared import slices

    def run(batches):
        mine = encoder(model_path)
        for batch in slices(batches):
            rows = list(mine.digests([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
