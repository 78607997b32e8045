"""Byte-level BPE by prefix dynamic programming.

Of each prefix of a piece of text, exactly one token can be the last of the prefix's encoding. It is the token that ends
there for which the encoding of what comes before ends in a token that may stand before it: two tokens may stand side by
side if encoding their joint bytes gives just these two. So a table of last tokens, filled from left to right, holds the
encoding of every prefix; appending bytes extends the table, and an edit leaves the entries before it as they are and
those after it from where the table meets the old one again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citeloom.llm.batches import slices
from citeloom.session import ship

#: Fixed value: the pattern that cuts a text into pieces before byte_bpe_50k's merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces whose ids a worker keeps, and the longest of them in characters. Only speed depends on these.
KEPT_PIECES, KEPT_CHARS = 400_000, 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixTable:
    """The last tokens of all prefixes of a byte string."""

    __slots__ = ("bpe", "computed", "data", "last")

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        #: computed: the entries that had to be found so far.
        self.bpe, self.data, self.last, self.computed = bpe, b"", [], 0
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        """Add bytes at the end; the entries so far stay."""
        self.data += more
        self.computed += len(more)
        self.bpe._extend(self.data, self.last)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Put new in place of the bytes from start to end; entries are found again from start on until they meet the old
        ones.

        An entry depends on the bytes and entries before it as far as the longest token reaches. So once as many entries
        behind the new bytes are as they were, all that follow are too, and are taken over.
        """
        old, shift, longest = self.last[start:], len(new) - (end - start), self.bpe.longest
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        same = 0
        while len(self.last) < len(self.data):
            self.bpe._extend(self.data, self.last, len(self.last) + 1)
            self.computed += 1
            at = len(self.last) - 1 - shift - start
            same = same + 1 if len(self.last) > start + len(new) and old[at] == self.last[-1] else 0
            if same == longest:
                self.last += old[at + 1 :]
        return self

    def ids(self) -> list[int]:
        out, at, length = [], len(self.data), self.bpe.lengths
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out


class PrefixBPE:
    """A byte-level BPE whose later merges have higher ids, from the text of a tokenizers JSON file."""

    def __init__(self, definition: str, pattern: str = PATTERN):
        model = json.loads(definition)["model"]
        letters = _byte_letters()
        vocabulary = model["vocab"]
        bytes_of = {name: bytes(letters[c] for c in name) for name in vocabulary if all(c in letters for c in name)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {left + right for left, right in merges}
        self.ids_of: dict[bytes, int] = {}
        self.lengths: dict[int, int] = {}
        for name, data in bytes_of.items():
            if name in made or len(data) == 1:
                self.ids_of[data] = vocabulary[name]
                self.lengths[vocabulary[name]] = len(data)
        # rank: single bytes come before all merges, these in their order.
        self.rank = {vocabulary[n]: -1 for n, data in bytes_of.items() if len(data) == 1}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            token = vocabulary[left + right]
            if token not in self.parts:
                self.parts[token] = (vocabulary[left], vocabulary[right])
                self.pair[(vocabulary[left], vocabulary[right])] = rank
                self.rank[token] = rank
        self.longest = max(self.lengths.values())
        self.beside: dict[tuple[int, int], bool] = {}
        self.cut = regex.compile(pattern)
        self.kept: dict[str, list[int]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joint bytes gives back these two.

        The two are taken apart step by step from the latest merge on, looking at the border: if the two tokens at the
        border make a merge that comes before the merges that built what stands there, BPE would have joined them.
        """
        known = self.beside.get((left, right))
        if known is not None:
            return known
        first, second, never = left, right, len(self.pair)
        limit, good = never, True
        while True:
            joint = self.pair.get((first, second))
            if joint is not None and joint < limit:
                good = False
                break
            a, b = self.rank[first], self.rank[second]
            if a < 0 and b < 0:
                break
            # The later of the two merges is undone first; of equal tokens the right one, as BPE joins from the left.
            if a > b:
                limit, first = a, self.parts[first][1]
            else:
                limit, second = b + (b >= 0), self.parts[second][0]
        if len(self.beside) < 4_000_000:
            self.beside[(left, right)] = good
        return good

    def _extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        ids, longest, follows, lengths = self.ids_of, self.longest, self.may_follow, self.lengths
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is not None and (start == 0 or follows(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise AssertionError(f"no token ends at {end}")
        assert not last or lengths[last[-1]] <= len(data)

    def piece(self, text: str) -> list[int]:
        """The ids of a piece, which no merge crosses."""
        data = text.encode("utf-8", "surrogatepass")
        token = self.ids_of.get(data)
        return [token] if token is not None else PrefixTable(self, data).ids()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for an empty or null text."""
        if not text:
            return []
        kept, out = self.kept, []
        for piece in self.cut.findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= KEPT_CHARS:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out


_loaded: dict[int, PrefixBPE] = {}


def _tables(mark: int, definition: str) -> PrefixBPE:
    """The tables of a vocabulary, kept by the worker from task to task."""
    bpe = _loaded.get(mark)
    if bpe is None:
        _loaded.clear()
        bpe = _loaded[mark] = PrefixBPE(definition)
    return bpe


def encode_documents(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, out: str = "ids") -> DataFrame:
    """key, out: the token ids of each row's text, a list of int, without special tokens.

    Empty and null texts give an empty list, blank ones their ids; strings of special tokens are ordinary text. Whole
    texts are encoded, of any length. Repeated rows stay repeated; other columns are ignored. The vocabulary file is
    read on the driver and sent to the executors (its size does not depend on the data). There is no shuffle.
    """
    ship(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        definition = df.sparkSession.sparkContext.broadcast(file.read())
    mark = hash(definition.value)
    kept = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))

    kind = to_arrow_type(kept.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(mark, definition.value)
        for keys, texts in slices(batches):
            encoded = [bpe.encode(t) for t in texts]
            ends = np.zeros(len(encoded) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in encoded], out=ends[1:])
            flat = np.fromiter((i for x in encoded for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=[key, out])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, `{out}` array<int>")
