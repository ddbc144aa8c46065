"""Token counts without token strings: rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from goldseam.llm.pretokens import PreTokenizer, byte_symbols, tokenizer

#: Counts of this many different pre-tokens are remembered by a worker; then it starts afresh.
REMEMBERED = 1_000_000
#: Bytes of new pre-tokens that are merged together.
MERGED_TOGETHER = 4 * 1024 * 1024
#: A pre-token of more bytes is counted from pieces of PIECE bytes.
LONG_WORD = 512
PIECE = 64


class RankMerger:
    """The merges of a byte-level BPE file as sorted arrays."""

    def __init__(self, name: str) -> None:
        _, parsed = tokenizer(name)
        vocab, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.none = len(pairs)
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int64)
        # what a symbol stands for: a merge joins the bytes of its two sides
        self.spelled: dict[int, bytes] = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        for a, b, joined in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
            self.spelled[joined] = self.spelled[a] + self.spelled[b]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], self.none), self.made[at]

    def count(self, words: list[bytes], left: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Symbols that are left of each word once no pair of it has a rank.

        ``left``, if given, receives the symbols themselves, each with the number of its word. All words lie behind one another in one array. A round looks up the rank of every adjacent
        pair, takes each word's lowest, and merges that pair wherever the word has it, from the
        left where pairs overlap. Words without a ranked pair are done and leave the array.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        result = lengths.copy()
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        while len(ids):
            rank, made = self._ranks(ids[:-1], ids[1:])
            rank[word[:-1] != word[1:]] = self.none
            rank = np.append(rank, self.none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            lowest = np.minimum.reduceat(rank, starts)
            result[word[starts]] = sizes
            live = lowest < self.none
            if left is not None:
                done = np.repeat(~live, sizes)
                left.append((word[done], ids[done]))
            if not live.any():
                break
            hit = (rank == np.repeat(lowest, sizes)) & (rank < self.none)
            at = np.flatnonzero(hit)
            # of pairs that overlap (a run of one symbol) every second one merges, from the left
            run = np.append(True, np.diff(at) != 1)
            first = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - first) % 2 == 0]
            ids[at] = made[at]
            keep = np.repeat(live, sizes)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        return result

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words behind one another, and how many each word has."""
        left: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = self.count(words, left)
        word, ids = (np.concatenate(parts) for parts in zip(*left, strict=True))
        return ids[np.argsort(word, kind="stable")], sizes

    def count_long(self, word: bytes) -> int:
        """``count`` of one long word, in rounds that do not grow with its length.

        The word is cut into pieces that are merged side by side. Symbols are those of the whole word
        if any two neighbours, merged by themselves, stay these two: the first merge across a border
        would also happen between its two neighbours alone. Where a border of pieces fails this, some
        symbols around it are merged anew, and their outer borders are tested next, with twice as
        many symbols each time; at worst this ends with the whole word in one piece.
        """
        pieces = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
        step = MERGED_TOGETHER // PIECE
        merged = [self.symbols(pieces[i : i + step]) for i in range(0, len(pieces), step)]
        ids = np.concatenate([m[0] for m in merged])
        border = np.cumsum(np.concatenate([m[1] for m in merged]))[:-1]
        reach = 4
        while len(border):
            pairs = [self.spelled[a] + self.spelled[b] for a, b in zip(ids[border - 1].tolist(), ids[border].tolist())]
            got, sizes = self.symbols(pairs)
            ends = np.cumsum(sizes)
            stays = (sizes == 2) & (got[ends - sizes] == ids[border - 1]) & (got[ends - 1] == ids[border])
            failed = border[~stays]
            if not len(failed):
                break
            low, high = np.maximum(failed - reach, 0), np.minimum(failed + reach, len(ids))
            apart = np.append(True, low[1:] > high[:-1])
            low, high = low[apart], np.maximum.reduceat(high, np.flatnonzero(apart))
            around = [
                b"".join(map(self.spelled.__getitem__, ids[a:b].tolist())) for a, b in zip(low.tolist(), high.tolist())
            ]
            got, sizes = self.symbols(around)
            parts, outer, at, length = [], [], 0, 0
            for a, b, new in zip(low.tolist(), high.tolist(), np.split(got, np.cumsum(sizes)[:-1]), strict=True):
                parts += [ids[at:a], new]
                outer += [length + a - at, length + a - at + len(new)]
                length, at = outer[-1], b
            ids = np.concatenate([*parts, ids[at:]])
            border = np.unique(outer)
            border = border[(border > 0) & (border < len(ids))]
            reach *= 2
        return len(ids)


@lru_cache(maxsize=2)
def _tools(name: str) -> tuple[PreTokenizer, RankMerger, dict[str, int]]:
    return PreTokenizer(name), RankMerger(name), {}


def _learn(words: list[str], merger: RankMerger, known: dict[str, int]) -> None:
    """Counts for pre-tokens not yet known, a bounded number of bytes at a time."""
    part: list[str] = []
    coded: list[bytes] = []
    total = 0
    for word in words:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > LONG_WORD:
            known[word] = merger.count_long(raw)
            continue
        part.append(word)
        coded.append(raw)
        total += len(raw)
        if total >= MERGED_TOGETHER:
            known.update(zip(part, merger.count(coded).tolist(), strict=True))
            part, coded, total = [], [], 0
    if part:
        known.update(zip(part, merger.count(coded).tolist(), strict=True))


def count_tokens(texts: list[str | None], name: str) -> list[int]:
    """Tokens of each text, as the library's ``encode(text, add_special_tokens=False)`` has them."""
    pre, merger, known = _tools(name)
    if len(known) > REMEMBERED:
        known.clear()
    counts = []
    for text in texts:
        total = 0
        for segment in pre.segments(text or ""):
            if segment in pre.special:
                total += 1
                continue
            words = pre.split(segment)
            new = {w for w in words if w not in known}
            if new:
                _learn(list(new), merger, known)
            total += sum(map(known.__getitem__, words))
        counts.append(total)
    return counts


def with_token_counts(docs: DataFrame, name: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null and empty texts have no tokens. Rows are judged one by one: repeated rows give repeated
    results, null ids stay null, other columns are not read, an empty table gives an empty table.
    Special tokens inside a text count as one token, as is the library's default. Nothing is
    shuffled; a worker holds one Arrow batch and the counts of at most ``REMEMBERED`` pre-tokens.
    A very long text costs in proportion to its length, also where it is a single pre-token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = count_tokens(texts, name)
            size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
