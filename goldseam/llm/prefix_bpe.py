"""BPE by dynamic programming over prefixes: one last token per prefix, ids by following back-pointers.

Byte pair encoding leaves exactly one token at the end of every prefix of a word. If that token is
known for all shorter prefixes, the one of the next prefix is the only vocabulary entry that ends there
and fits behind the last token of what precedes it: the two must come out as themselves when their
concatenation is encoded. An automaton over the vocabulary lists the entries that end at each place, so
a word costs time in proportion to its length, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from goldseam.llm.pretokens import PreTokenizer, byte_symbols, tokenizer

REMEMBERED_WORDS = 500_000
REMEMBERED_PAIRS = 2_000_000
_NEVER = 1 << 60
#: A symbol that ends a word is another symbol than the same character inside it.
_ENDING = 0x2000


class PrefixEncoder:
    """Vocabulary automaton, merge trees and the pair test of one BPE file."""

    def __init__(self, name: str) -> None:
        _, parsed = tokenizer(name)
        model = parsed["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.tokens |= {t["id"]: t["content"] for t in parsed["added_tokens"]}
        self._bytes = byte_symbols()
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.birth: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            joined = (a.removesuffix(self.suffix) if self.suffix else a) + b
            pair = (vocab[a], vocab[b])
            made = vocab.get(a + b, vocab.get(joined))
            self.rank[pair] = r
            if made not in self.parts:
                self.parts[made] = pair
                self.birth[made] = r
        single = {s for s in self._bytes} | {s + self.suffix for s in self._bytes}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.parts or token in single:
                key = self._symbols(token)
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(_ENDING + ord(token[-1]))
        return token

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one edge of ``token`` while it is built: (token, rank that replaces it)."""
        made = self._left if side == 0 else self._right
        spine = made.get(token)
        if spine is None:
            spine, ends, at = [], _NEVER, token
            while True:
                spine.append((at, ends))
                if at not in self.parts:
                    break
                ends = self.birth[at]
                at = self.parts[at][side]
            spine.reverse()
            made[token] = spine
        return spine

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` side by side stay two tokens.

        Both are replayed from their single symbols in the order of ranks. They merge across their
        border if, at some moment, the pair that touches there ranks before whatever next changes
        either of its members; at equal ranks the pair further left goes first.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        good = True
        while True:
            crossing = self.rank.get((a[i][0], b[j][0]), _NEVER)
            if crossing < a[i][1] and crossing <= b[j][1] and crossing != _NEVER:
                good = False
                break
            if a[i][1] == b[j][1] == _NEVER:
                break
            if a[i][1] <= b[j][1]:
                i += 1
            else:
                j += 1
        if len(self._fits) > REMEMBERED_PAIRS:
            self._fits.clear()
        self._fits[left, right] = good
        return good

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        symbols = "".join(map(self._bytes.__getitem__, word.encode("utf-8", "surrogatepass")))
        if self.suffix:
            symbols = symbols[:-1] + chr(_ENDING + ord(symbols[-1]))
        last = [-1] * (len(symbols) + 1)
        back = [0] * (len(symbols) + 1)
        for end, (size, token) in self.automaton.iter(symbols):
            here = end + 1
            start = here - size
            if last[here] >= 0 or (start and last[start] < 0):
                continue
            if start == 0 or self.fits(last[start], token):
                last[here], back[here] = token, start
        ids = []
        at = len(symbols)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        if -1 in ids:
            raise ValueError("a symbol is not in the vocabulary")
        return tuple(ids)

    def decode(self, ids: list[int]) -> str:
        """The library's text for ids where the file names no decoder: the tokens with spaces between."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _tools(name: str) -> tuple[PreTokenizer, PrefixEncoder, dict[str, tuple[int, ...]]]:
    return PreTokenizer(name), PrefixEncoder(name), {}


def encode_text(text: str | None, name: str) -> list[int]:
    """Ids of a whole text, special tokens inside it included, none added."""
    pre, encoder, known = _tools(name)
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    ids: list[int] = []
    for segment in pre.segments(text or ""):
        if segment in pre.special:
            ids.append(pre.special[segment])
            continue
        for word in pre.split(segment):
            part = known.get(word)
            if part is None:
                part = known[word] = encoder.encode(word)
            ids.extend(part)
    return ids


def decode_ids(ids: list[int], name: str) -> str:
    return _tools(name)[1].decode(ids)


def encoded(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row: the ids of the text, and the text that the ids decode to.

    Null and empty texts have no ids and decode to the empty text. Rows are independent: repeated
    rows repeat their result, null ids stay null, other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = [encode_text(t, name) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([decode_ids(i, name) for i in ids], pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that what is made of them stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def encoding_digests(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as ``encoded``, with digests taken in the task.

    ids_sha256 is over the decimal ids with single spaces, decoded_sha256 over the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, of_ids, of_text = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode_text(text, name)
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    plain = decode_ids(ids, name).encode("utf-8", "surrogatepass")
                    of_text.append(hashlib.sha256(plain).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(of_ids, pa.string()),
                        pa.array(of_text, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
