"""Passages of evaluation items inside training texts, by spaced seeds and an alignment around their hits."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.batches import slices
from citeloom.operators.skew import skew_join
from citeloom.session import materialise, ship

#: The masks: which of successive words a seed takes; the others, at fixed places, are ignored. A seed is the taken words
#: alone, so a word that one side lacks or has besides is met by another mask on the other side. Any passage of 12 or more
#: words of which at most 2 in 10 are altered, dropped or added has four successive words left as they were, but for 15
#: words with three changes at even distances, where two words on either side of a change make the seed.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 5))
LEAST_WORDS, CHANGES_IN_TEN = 12, 2
#: Bits of the filter of the items' seeds that goes to the executors, at most: 16 MB, whatever the number of items. Where
#: these make more seeds than it can tell apart, more of the documents' seeds travel, and none is lost.
FILTER_BITS = 1 << 27
#: Words whose codes a worker keeps. Only speed depends on it.
KEPT_WORDS = 500_000

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авеѕіјкмһоорсԁтухԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοԍɡı", "abesijkmhoopcdtyxqwABEZHIKMNOPTYXogi" + "gi", strict=False))
# A tag is short, or all its attributes have quoted values of any length.
_TAG = re.compile(r"""</?[A-Za-z][^<>]{0,200}>|<[A-Za-z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"]*"|'[^']*'))+\s*/?>""")
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n\s*(?=[^\W\d_])")
_INSIDE = re.compile(r"(?<=[^\W_])[-.,'_](?=[^\W_])")
_SPACE_CLASSES = frozenset({"Zs", "Zl", "Zp", "Cc"})


class _Folds(dict):
    """What a character that is not ASCII becomes: nothing for marks, format characters and symbols."""

    def __missing__(self, code: int) -> int | str | None:
        char = chr(code)
        kind = unicodedata.category(char)
        if code < 128:
            out: int | str | None = code
        elif char in LOOKALIKES:
            out = LOOKALIKES[char]
        elif kind in ("Mn", "Me", "Cf", "So", "Sk", "Sm", "Co", "Cn", "Cs"):
            out = None
        elif kind == "Pd":
            out = "-"
        elif char in "‘’ʼ":
            out = "'"
        elif kind in _SPACE_CLASSES or kind[0] == "P":
            out = " "
        else:
            out = code
        self[code] = out
        return out


_FOLDS = _Folds()


def _without_comments(text: str) -> str:
    """The text without what stands between comment marks; an open one at the end stays."""
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out.append(text[at:start])
        at = end + 3
    return " ".join([*out, text[at:]])


def normal_words(text: str | None) -> list[str]:
    """The words of a text without differences of case, punctuation, spacing, markup and character encoding."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _without_comments(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_FOLDS)
    # A word may be broken at the end of a line; marks inside a word or number are no border.
    text = _BROKEN.sub("", text)
    return _WORD.findall(_INSIDE.sub("", text).lower())


#: A passage of 24 words or more splits into halves of which one is a passage again, so those of 12 to 23 words decide.
_REACH = 24
_DRIFT = _REACH * CHANGES_IN_TEN // 10 + 1
#: Seeds of one diagonal whose places in the item differ by less are looked at once.
_STEP = 8


_codes: dict[str, int] = {}


def word_codes(words: list[str]) -> np.ndarray:
    """The words as numbers, the same on every executor."""
    kept = _codes
    if len(kept) > KEPT_WORDS:
        kept.clear()
    out = []
    for w in words:
        code = kept.get(w)
        if code is None:
            code = kept[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out.append(code)
    return np.array(out, np.uint64)


def seeds(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the text, place) of all seeds of the texts, each an array of word codes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    codes, owner = np.concatenate([*texts, np.empty(0, np.uint64)]), np.repeat(np.arange(len(texts)), lengths)
    keys, places = [], []
    with np.errstate(over="ignore"):
        for mask in MASKS:
            n = max(0, len(codes) - mask[-1])
            good = np.flatnonzero(owner[:n] == owner[mask[-1] : mask[-1] + n])
            key = np.zeros(len(good), np.uint64)
            for m in mask:
                key = (key * np.uint64(0x9E3779B97F4A7C15) + codes[good + m]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            keys.append(key)
            places.append(good)
    key, place = np.concatenate(keys), np.concatenate(places)
    number = owner[place]
    return key, number, place - starts[number]


def near_hits(items: np.ndarray, item_of: np.ndarray, texts: np.ndarray, text_of: np.ndarray, item_at: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Which of the hits may lie in a passage: of 12 words with 2 changes 10 are left, so as many words of the item must come
    again near their place in the text.

    items and texts hold many word lists one behind the other, item_of and text_of tell whose each word is; item_at and
    text_at are the hits' places in them.
    """
    left = LEAST_WORDS - LEAST_WORDS * CHANGES_IN_TEN // 10
    span = np.arange(-_REACH - _STEP + 1, _REACH + _STEP + 4)
    keep = np.zeros(len(item_at), bool)
    for low in range(0, len(item_at), 4096):
        part = slice(low, low + 4096)
        at = item_at[part, None] + span
        inside = at.clip(0, len(items) - 1)
        mine = (item_of[inside] == item_of[item_at[part], None]) & (at == inside)
        own, again = items[inside], np.zeros(mine.shape, bool)
        for drift in range(-_DRIFT, _DRIFT + 1):
            there = text_at[part, None] + span + drift
            inside = there.clip(0, len(texts) - 1)
            again |= (texts[inside] == own) & (text_of[inside] == text_of[text_at[part], None]) & (there == inside)
        upto = np.cumsum(again & mine, axis=1, dtype=np.int32)
        keep[part] = (upto[:, _REACH - 2] >= left) | ((upto[:, _REACH - 1 :] - upto[:, : 1 - _REACH]).max(axis=1) >= left)
    return keep


def held_pairs(items: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray], hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[int]:
    """The numbers of the pairs whose text holds a passage of their item around one of their hits.

    items and texts are (words, ends): the words of all pairs one behind the other, with len(pairs) + 1 limits; hits are
    (limits, places in the text, places in the item).
    """
    (own, own_ends), (codes, ends), (limits, text_at, item_at) = items, texts, hits
    if not len(text_at):
        return []
    pair = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    own_of, text_of = np.repeat(np.arange(len(own_ends) - 1), np.diff(own_ends)), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    i, t = own_ends[pair] + item_at, ends[pair] + text_at
    found: set[int] = set()
    for h in np.flatnonzero(near_hits(own, own_of, codes, text_of, i, t)):
        p = int(pair[h])
        if p not in found:
            a, b = max(own_ends[p], i[h] - _REACH - _STEP + 1), min(own_ends[p + 1], i[h] + _REACH + _STEP + 4)
            c, d = max(ends[p], t[h] - (i[h] - a) - _DRIFT), min(ends[p + 1], t[h] + (b - i[h]) + _DRIFT)
            if holds_passage(own[a:b], codes[c:d]):
                found.add(p)
    return sorted(found)


def holds_passage(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether the text repeats at least 12 successive words of the item with at most 2 in 10 changed.

    A change may be at the ends too, so 10 words alone are 12 of which two were dropped; 9 are too few.

    The best score of an alignment of n words of the item that ends at each word of the text, for n = 0 to 11 and 12 or
    more; a word of the item gives 2, a change costs 10, so a score of 0 or more is a passage.
    """
    gain, cost, n = CHANGES_IN_TEN, 10, len(text)
    low = -(10**6)
    slope = np.arange(n + 1) * cost
    best = np.full((LEAST_WORDS + 1, n + 1), low)
    best[0] = 0
    for word in item:
        step = np.where(text == word, gain, gain - cost)
        new = best + (gain - cost)
        np.maximum(new[:, 1:], best[:, :-1] + step, out=new[:, 1:])
        shifted = np.full_like(best, low)
        shifted[1:] = new[:-1]
        np.maximum(shifted[-1], new[-1], out=shifted[-1])
        best = np.maximum.accumulate(shifted + slope, axis=1) - slope
        best[0] = 0
        if best[-1].max() >= 0:
            return True
    return False


def _worded(texts: DataFrame, name: str, bits: Broadcast | None = None) -> DataFrame:
    """name, row, codes, seeds (key, at) of texts (name, row, text). The codes are the words' lower 32 bits. With a filter only seeds whose bit is set, and only
    texts that have such; without one the texts of LEAST_WORDS words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for ids, rows, values in slices(batches):
            texts = [word_codes(normal_words(t)) for t in values]
            if marks is None:
                texts = [t if len(t) >= LEAST_WORDS else t[:0] for t in texts]
            key, number, at = seeds(texts)
            if marks is not None:
                bit = key & np.uint64(len(marks) * 8 - 1)
                held = np.flatnonzero((marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                key, number, at = key[held], number[held], at[held]
            order = np.argsort(number, kind="stable")
            key, at = key[order], at[order]
            ends = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(texts)))))
            kept = np.flatnonzero(np.diff(ends))
            found = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(at.astype(np.int32))], names=["key", "at"])
            codes = [texts[i] for i in kept]
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int32)
            flat = np.concatenate([*codes, np.empty(0, np.uint64)]).astype(np.uint32).view(np.int32)
            # Texts without a seed lie between the others' ends, and hold no entries there.
            limits = np.append(ends[kept], ends[-1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in kept], pa.int64()), pa.array([rows[i] for i in kept], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.ListArray.from_arrays(pa.array(limits), found)],
                names=[name, "row", "codes", "seeds"],
            )

    return texts.select(name, "row", "text").mapInArrow(run, f"{name} long, row long, codes array<int>, seeds array<struct<key:long,at:int>>")


def _filter_bits(keys: DataFrame) -> bytes:
    """A bit for each key modulo a power of two, at least 64 for each key up to FILTER_BITS; built in the cluster, in pieces
    of 4 KB."""
    n = keys.agg(F.count(F.lit(1))).first()[0]
    size = min(FILTER_BITS, max(1 << 15, 1 << (64 * n).bit_length()))
    bit = F.col("key").bitwiseAND(F.lit(size - 1))
    pieces = keys.select(F.shiftright(bit, 15).alias("piece"), bit.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(size // 8)
    for piece, bits in pieces.collect():  # at most FILTER_BITS bits
        out[piece * 4096 : piece * 4096 + len(bits)] = bits
    return bytes(out)


def leaked_items(documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """doc_key, item_key: each document with each item of which it holds a passage of 12 words or more, 2 in 10 changed.

    The seeds of the items are a table. A filter of bounded size (FILTER_BITS) made of them goes to the executors, where a
    document keeps the seeds that pass it; these are joined with the items' by their keys, frequent ones by skew_join.
    The pairs that meet get their word codes, and the passage is looked for by an alignment around the hits. Nothing of the
    documents and no item comes to the driver, and any number of items takes one pass over the documents.

    Keys are whole numbers. Null and empty texts and items of fewer than 12 words are in no case, null keys give no row,
    repeated rows give their cases once. Texts are taken whole, extra columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)

    def texts(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        value = F.col(text).cast("string")
        return df.select(F.col(key).cast("long").alias(name), F.xxhash64(value).alias("row"), value.alias("text")).filter(F.col(name).isNotNull() & F.col("text").isNotNull())

    wanted = materialise(_worded(texts(items, item_key, item_text, "item").distinct(), "item").withColumnRenamed("row", "item_row"))
    index = wanted.select("item", "item_row", F.explode("seeds").alias("s")).select("item", "item_row", F.col("s.key").alias("key"), F.col("s.at").alias("item_at"))
    bits = spark.sparkContext.broadcast(_filter_bits(index.select("key").distinct()))
    marked = materialise(_worded(texts(documents, doc_key, doc_text, "doc"), "doc", bits))
    hits = marked.select("doc", "row", F.explode("seeds").alias("s")).select("doc", "row", F.col("s.key").alias("key"), F.col("s.at").alias("text_at"))
    total = hits.agg(F.count(F.lit(1)).alias("n"))
    seen = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n_hits"))
    met = skew_join(hits, index.join(seen, "key"), "key", "n_hits", total)
    # Of the hits on one diagonal those less than _STEP words apart see the same passages: one of them stays.
    one = met.groupBy("doc", "row", "item", "item_row", (F.col("text_at") - F.col("item_at")).alias("diagonal"), F.floor(F.col("item_at") / _STEP).alias("step")).agg(F.min("item_at").alias("item_at"))
    pairs = materialise(one.groupBy("doc", "row", "item", "item_row").agg(F.collect_list(F.struct((F.col("item_at") + F.col("diagonal")).cast("int").alias("text_at"), "item_at")).alias("hits")))
    name = F.xxhash64("item", "item_row").alias("name")
    often = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("n_pairs"))
    own = wanted.select(name, F.col("item").alias("item_2"), F.col("item_row").alias("row_2"), F.col("codes").alias("own")).join(often, "name")
    armed = skew_join(pairs.withColumn("name", name), own, "name", "n_pairs", pairs.agg(F.count(F.lit(1)).alias("n"))).filter("item = item_2 and item_row = row_2")
    both = armed.select("doc", "row", "item", "own", "hits").join(marked.select("doc", "row", "codes").dropDuplicates(["doc", "row"]), ["doc", "row"])

    def lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        ends = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return ends - ends[0], column.values.slice(ends[0], ends[-1] - ends[0])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (own_ends, own), (ends, codes), (limits, places) = (lists(batch.column(c)) for c in ("own", "codes", "hits"))
            spots = [places.field(c).to_numpy(zero_copy_only=False) for c in ("text_at", "item_at")]
            held = pa.array(held_pairs((own.to_numpy(), own_ends), (codes.to_numpy(), ends), (limits, *spots)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(held), batch.column("item").take(held)], names=["doc", "item"])

    cases = both.select("doc", "item", "own", "codes", "hits").mapInArrow(verify, "doc long, item long")
    return cases.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()


def leak_report(cases: DataFrame, item_key: str, doc_key: str) -> DataFrame:
    """item_key, n_documents: in how many documents each leaked item is."""
    return cases.groupBy(item_key).agg(F.countDistinct(doc_key).alias("n_documents"))
