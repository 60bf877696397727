"""Byte-pair encoding by an index of pair occurrences, and decoding.

A task gathers the distinct words (matches of the vocabulary's split pattern) of a stretch of texts and encodes those
it hasn't met. All their symbols stand in one array with links to the neighbours in their word. An index maps the rank
of each mergeable pair to all positions where it occurs; the active ranks are applied in ascending order, each to all
its positions at once, and every merge adds the positions of the pairs that it creates to their lists. Positions whose
pair has gone meanwhile are recognised when their rank's turn comes. Words are independent, so this gives each of them
the merges that a word-by-word encoder makes.

A text's ids are then the ids of its words in order. Texts never leave their partition: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tidepanel.llm.common import Batches, bounded_batches, texts_of

#: Fixed value: the split pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

STRETCH = 4_000_000
"""Code points of texts that are encoded together."""
CACHED = 150_000
"""Words that a task may remember; beyond it, it starts afresh. It bounds memory and changes no result."""


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary: bytes that print stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What encoding needs of a vocabulary file; a few MB, whatever the corpus."""

    first: np.ndarray  # id of each byte
    last: np.ndarray  # id of each byte at the end of a word
    by_left: tuple[np.ndarray, np.ndarray, np.ndarray]  # mergeable pairs: where each left symbol's begin, right symbols, ranks
    by_right: tuple[np.ndarray, np.ndarray, np.ndarray]  # where each right symbol's begin, left symbols, ranks
    first_ranks: np.ndarray  # rank of each pair of bytes, at 512 * left + right, + 256 where the right one ends a word
    left: np.ndarray  # by rank
    right: np.ndarray
    merged: np.ndarray  # id of the merged pair, by rank
    size: int
    pieces: list[bytes]  # bytes of each id
    special: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level vocabulary in the JSON form of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters, vocab = byte_letters(), model["model"]["vocab"]
    end = model["model"]["end_of_word_suffix"] or ""
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    pieces = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in (token.removesuffix(end) if end else token))
    for token, i in special.items():
        pieces[i] = token.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
    left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
    keys = left * len(pieces) + right
    order = np.argsort(keys)
    by_byte = [c for c, _ in sorted(letters.items(), key=lambda x: x[1])]
    first, last = (np.array([vocab[c + x] for c in by_byte], dtype=np.int32) for x in ("", end))
    merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
    symbols = np.arange(len(pieces) + 1)
    by_left, by_right = (
        (np.searchsorted(own[o], symbols), partner[o].astype(np.int32), o.astype(np.int32))
        for own, partner, o in ((left, right, order), (right, left, np.lexsort((left, right))))
    )
    pairs = np.repeat(first.astype(np.int64), 512) * len(pieces) + np.tile(np.concatenate((first, last)), 256)
    first_ranks = ranks_among(keys[order], order.astype(np.int32), pairs)
    return Vocabulary(first, last, by_left, by_right, first_ranks, left, right, merged, len(pieces), pieces, special)


def ranks_among(known: np.ndarray, ranks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rank beside each wanted value in ``known``, which ascends; -1 for values that aren't there."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, ranks[at], -1)


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and each word's count of ids."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols = v.first[data]
    n = len(symbols)
    if not n:
        return symbols, sizes
    ends = np.cumsum(sizes)
    final = ends[sizes > 0] - 1
    symbols[final] = v.last[data[final]]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[final] = -1
    before[(ends - sizes)[sizes > 0]] = -1

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    small = np.uint16 if len(v.merged) <= 1 << 16 else np.int32  # sorted by counting, where ranks are short enough

    def note(ranks: np.ndarray, at: np.ndarray) -> None:
        keep = ranks >= 0
        ranks, at = ranks[keep], at[keep]
        if not len(at):
            return
        order = np.argsort(ranks.astype(small), kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for rank, start, end in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(at[start:end])

    def meet(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], symbol: int, partners: np.ndarray, at: np.ndarray) -> None:
        """Note the pairs of ``symbol`` and the symbols at ``partners``, which begin at ``at``."""
        starts, known, ranks = pairs
        start, end = starts[symbol], starts[symbol + 1]
        if start < end and len(at):
            note(ranks_among(known[start:end], ranks[start:end], symbols[partners]), at)

    pairs = data[:-1].astype(np.int32) * 512 + data[1:]
    pairs[final[final > 0] - 1] += 256
    ranks = v.first_ranks[pairs]
    ranks[final[:-1]] = -1  # no pair reaches into the next word
    at = np.flatnonzero(ranks >= 0).astype(np.int32)
    note(ranks[at], at)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[rank], v.right[rank]
        at = at[(symbols[at] == a) & (after[at] >= 0)]
        at = at[symbols[after[at]] == b]
        if a == b and len(at) > 1:  # of overlapping occurrences, every second from the left
            at = np.unique(at)
            starts = np.concatenate(([True], after[at[:-1]] != at[1:]))
            place = np.arange(len(at))
            at = at[(place - place[starts][np.cumsum(starts) - 1]) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbols[at], symbols[gone] = v.merged[rank], -1
        follow = after[gone]
        after[at] = follow
        linked = follow >= 0
        before[follow[linked]] = at[linked]
        lead = before[at]
        lead = lead[lead >= 0]
        meet(v.by_right, v.merged[rank], lead, lead)
        meet(v.by_left, v.merged[rank], follow[linked], at[linked])
    alive = symbols >= 0
    counts = np.zeros(len(words), dtype=np.int64)
    filled = np.flatnonzero(sizes > 0)
    counts[filled] = np.add.reduceat(alive.astype(np.int64), (ends - sizes)[filled])
    return symbols[alive], counts


class Numbers(dict):
    """Words to numbers; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts of one task, remembering the parts that it has met.

    A text that single spaces divide falls into its first part and parts with a space before them; the split pattern
    never joins two of them, so each has ids of its own. Other texts are divided by the pattern itself. A key of
    ``numbers`` is a string for a part with a space before it, else a tuple of one word.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(SPLIT)
        self.uneven = regex.compile(r"^\s|\s$| \s|\s ")
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.forget()

    def forget(self) -> None:
        self.numbers, self.known = Numbers(), 0
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.decimals: list[str] = []

    def parts(self, text: str) -> list[str | tuple[str]]:
        if self.special is not None and self.special.search(text):
            # every second part of such a split is a special token; its key holds its id too
            cut = enumerate(self.special.split(text))
            return [key for k, part in cut for key in ([(part, self.v.special[part])] if k % 2 else ((w,) for w in self.split.findall(part)))]
        if not text or self.uneven.search(text):
            return [(w,) for w in self.split.findall(text)]
        parts = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def learn(self) -> None:
        """Encode the parts that have come since the last call."""
        new = list(itertools.islice(self.numbers, self.known, None))
        words, sizes = [], []
        for key in new:
            found = [""] if len(key) > 1 and isinstance(key, tuple) else self.split.findall(" " + key if isinstance(key, str) else key[0])
            words += [w.encode("utf-8", "replace") for w in found]
            sizes.append(len(found))
        ids, per_word = encode_words(self.v, words)
        upto = np.concatenate(([0], np.cumsum(per_word)))
        ends = upto[np.cumsum(sizes, dtype=np.int64)]
        counts = np.diff(ends, prepend=0)
        named = {k: key[1] for k, key in enumerate(new) if isinstance(key, tuple) and len(key) > 1}
        if named:
            ids = np.insert(ids, (ends - counts)[list(named)], list(named.values()))
            counts[list(named)] = 1
        starts = np.cumsum(counts) - counts
        texts = ids.astype(str).tolist()
        self.decimals += [",".join(texts[s : s + c]) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
        self.starts, self.lengths = np.concatenate((self.starts, starts + len(self.ids))), np.concatenate((self.lengths, counts))
        self.ids = np.concatenate((self.ids, ids))
        self.known = len(self.numbers)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text, and the same in decimals joined by commas."""
        if len(self.numbers) > CACHED:
            self.forget()
        spelled = [np.fromiter(map(self.numbers.__getitem__, self.parts(t)), dtype=np.int32) for t in texts]
        self.learn()
        for parts in spelled:
            lengths = self.lengths[parts]
            shift = self.starts[parts] - (np.cumsum(lengths) - lengths)
            ids = self.ids[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]
            yield ids, ",".join(map(self.decimals.__getitem__, parts.tolist()))


def decode(pieces: list[bytes], ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def stretches(batch: pd.DataFrame, column: str = "text", bound: int = STRETCH) -> Iterator[tuple[slice, list[str]]]:
    """Runs of a batch's rows whose texts have ``bound`` code points together, or one longer text."""
    texts, start, size = texts_of(batch, column), 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > bound:
            yield slice(start, k), texts[start:k]
            start, size = k, 0
        size += len(text)
    if texts[start:]:
        yield slice(start, len(texts)), texts[start:]


def round_trips(documents: DataFrame, path: str) -> DataFrame:
    """Token count and hashes of each whole text's ids and of the text decoded from them.

    A null text counts as empty: 0 tokens and the hash of nothing. Strings of special tokens inside a text become
    their ids, as the library does. Repeated rows are encoded each; other columns are not read; an empty table gives none.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # bounded by the vocabulary file

    def encode(batches: Batches) -> Batches:
        encoder = Encoder(shared.value)
        for batch in batches:
            for rows, texts in stretches(batch):
                out = []
                for ids, decimals in encoder.encode(texts):
                    decoded = decode(encoder.v.pieces, ids).encode("utf-8")
                    out.append((len(ids), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                result = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                result.insert(0, "doc_id", batch["doc_id"].iloc[rows].array)
                yield result

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(
        encode, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
