"""Long exact spans shared between texts, by compact windows.

The tokens of a text are its runs of `gram` characters (half the least length, so that shorter stock lines meet nothing),
each with a hash. A compact window (l, c, r) stands for all
sequences of tokens that begin in l..c and end in c..r, for all of which the least hash is that at c; the windows of a
text are the nodes of the Cartesian tree over its hashes. Only windows that hold a sequence of full length are kept,
about two for each such length. Two equal stretches of `least` characters have the same tokens, hence the same least
hash at the same place under any hash function; so one function finds all exact spans, and more would find no further
ones. Windows with one signature meet with their places c laid on each other; what both intervals l..r hold in common is
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.batches import slices
from citeloom.operators.skew import skew_join
from citeloom.session import materialise, ship

#: Different surroundings of one signature that are compared in one task. Signatures with more go the other way, over
#: the hashes of their single stretches, which has no bound on a group.
GROUP = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """The hashes of all runs of gram codes, by doubling: those of 2^i codes from those of 2^(i-1)."""
    if len(codes) < gram:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width, at = _mixed(codes.astype(np.uint64) + _MIX), 1, 0
        total, base, done = None, np.uint64(0x100000001B3), 0
        weight = base
        while True:
            if gram & width:
                piece = power[done : done + len(codes) - gram + 1]
                total = piece.copy() if total is None else total * weight + piece
                done += width
            at += 1
            if width * 2 > gram:
                return _mixed(total)
            power = power[: len(power) - width] * weight + power[width:]
            weight, width = weight * weight, width * 2


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values (block prefix and suffix minima)."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def compact_windows(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees' nodes that span at least width hashes, of equal hashes the left one above.

    hashes holds those of many texts one behind the other, ends where each text's begin and the last one's end. A node of
    that span is the least hash of some run of width hashes, so the nodes are the places at which the greatest of the least
    hashes of the runs around is the hash itself; only their ends are looked for one by one, with a stack.
    """
    n = len(hashes)
    if n < width:
        return (np.empty(0, np.int64),) * 3
    least, lengths = _sliding_least(hashes, width), np.diff(ends)
    stop = np.repeat(ends[1:], lengths)
    runs = np.zeros(n + width - 1, np.uint64)  # width - 1 in front; runs that reach into the next text count as none
    runs[width - 1 : n] = np.where(np.arange(len(least)) + width <= stop[: len(least)], least, np.uint64(0))
    places = np.flatnonzero(hashes == ~_sliding_least(~runs, width))
    values, limits, left, right, stack = hashes[places].tolist(), stop[places].tolist(), [], [0] * len(places), []
    firsts, at = (stop - np.repeat(lengths, lengths))[places].tolist(), places.tolist()
    limit = -1
    for i, value in enumerate(values):
        if limits[i] != limit:
            for j in stack:
                right[j] = limit - 1
            stack, limit = [], limits[i]
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = at[i] - 1
        left.append(at[stack[-1]] + 1 if stack else firsts[i])
        stack.append(i)
    for j in stack:
        right[j] = limit - 1
    low, high = np.array(left, np.int64), np.array(right, np.int64)
    kept = np.flatnonzero(high - low + 1 >= width)
    return low[kept], places[kept], high[kept]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_rows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """sig, doc, row, at, low, high: of each compact window (l, c, r) of the texts of docs (doc, row, text) the signature, c,
    and the first and past the last character of its sequences that hold c and are at most least characters long."""
    width = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, values in slices(batches):
            texts = [_codes(v) for v in values]
            lengths = np.array([len(t) for t in texts], np.int64)
            # Grams that reach into the next text are left out; a text of fewer than least characters has no window.
            every = gram_hashes(np.concatenate([*texts, np.zeros(gram, np.uint32)]), gram)
            begins, counts = np.concatenate(([0], np.cumsum(lengths)[:-1])), np.where(lengths >= least, lengths - gram + 1, 0)
            ends = np.concatenate(([0], np.cumsum(counts)))
            hashes = every[np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])]
            left, places, right = compact_windows(hashes, ends, width)
            text = np.searchsorted(ends, places, "right") - 1
            at, first, last = places - ends[text], left - ends[text], right - ends[text]
            columns = (hashes[places].view(np.int64), np.array(ids, np.int64)[text], np.array(marks, np.int64)[text], at.astype(np.int32), np.maximum(first, at + gram - least).astype(np.int32), np.minimum(last + gram, at + least).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "doc", "row", "at", "low", "high"])

    return docs.select("doc", "row", "text").mapInArrow(run, "sig long, doc long, row long, at int, low int, high int")


def _surroundings(joined: DataFrame) -> DataFrame:
    """sig, doc, row, at, head, around: the text of each window, and how much of it is before the place at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, row, value, hits in zip(*columns, strict=True):
                for hit in hits:
                    at, low = hit["at"], hit["low"]
                    for column, x in zip(out, (hit["sig"], doc, row, at, at - low, value[low : hit["high"]]), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["sig", "doc", "row", "at", "head", "around"])

    return joined.mapInArrow(run, "sig long, doc long, row long, at int, head int, around string")


def _common(a: str, b: str) -> int:
    """The length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def shared_reach(members: list[tuple[int, int, str]], least: int) -> list[tuple[int, int] | None]:
    """Of each (owner, head, around) the first and last start, from the place on, of the stretches it shares with others.

    owner -1 stands for several documents that all have this window. All stretches hold the place, so the first and the
    last of them bound one run.
    """
    reach: list[list[int]] = [[least, -least] for _ in members]

    def note(i: int, first: int, last: int) -> None:
        if first <= last:
            reach[i][0], reach[i][1] = min(reach[i][0], first), max(reach[i][1], last)

    for i, (owner, head, around) in enumerate(members):
        if owner == -1:
            note(i, -head, len(around) - head - least)
    if len(members) <= 8:
        parts = [(around[:head][::-1], around[head:]) for _, head, around in members]
        for i, (a, _, _) in enumerate(members):
            for j in range(i):
                if a == -1 or a != members[j][0]:
                    before, after = _common(parts[i][0], parts[j][0]), _common(parts[i][1], parts[j][1])
                    note(i, -before, after - least)
                    note(j, -before, after - least)
    else:
        owners: dict[tuple[int, str], int] = {}
        for owner, head, around in members:
            for s in range(len(around) - least + 1):
                mark = (s - head, around[s : s + least])
                if owners.setdefault(mark, owner) != owner:
                    owners[mark] = -1
        for i, (_, head, around) in enumerate(members):
            for s in range(len(around) - least + 1):
                if owners[(s - head, around[s : s + least])] == -1:
                    note(i, s - head, s - head)
    return [(first, last) if first <= last else None for first, last in reach]


def _compared(classes: DataFrame, least: int) -> DataFrame:
    """class, first, last of the classes collected by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("sig", pa.int64()), ("head", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
        for columns in slices(batches):
            names, firsts, lasts = [], [], []
            for group in columns[0]:
                for member, reach in zip(group, shared_reach([(m["owner"], m["head"], m["around"]) for m in group], least), strict=True):
                    if reach:
                        names.append(member["class"])
                        firsts.append(reach[0])
                        lasts.append(reach[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["class", "first", "last"])

    return classes.groupBy("sig").agg(F.collect_list(F.struct("class", "owner", "head", "around")).alias("group")).select("group").mapInArrow(run, "class struct<sig:long,head:int,a:long,b:long>, first int, last int")


def _stretches(classes: DataFrame, least: int) -> DataFrame:
    """class, first, last by grouping the stretches of large groups by 128 bits of hashes: nothing is collected.

    Each group holds its least and greatest text; where these differ, different texts have met in it by their hashes, and
    its stretches are grouped by the texts themselves.
    """
    start = F.explode(F.sequence(F.lit(0), F.length("around") - least))
    cut = classes.filter(F.length("around") >= least).select("class", "sig", "owner", "head", "around", start.alias("s"))
    piece, place = F.substring(F.col("around"), F.col("s") + 1, F.lit(least)), (F.col("s") - F.col("head")).cast("int")
    pieces = cut.select(F.xxhash64("sig", place, piece).alias("stretch"), F.xxhash64(F.lit(1), piece).alias("more"), "class", "owner", place.alias("from"), piece.alias("piece"))
    groups = materialise(
        pieces.groupBy("stretch", "more").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count(F.lit(1)).alias("n"), F.min("piece").alias("a"), F.max("piece").alias("b")).select("stretch", F.col("more").alias("other"), "low", "high", "n", (F.col("a") == F.col("b")).alias("one"))
    )
    cut, shared = materialise(pieces.drop("piece")), F.expr("low != high or low = -1")
    found = skew_join(cut, groups.filter(shared & F.col("one")).select("stretch", "other", "n"), "stretch", "n", cut.agg(F.count(F.lit(1)).alias("n"))).filter("more = other").select("class", "from")
    mixed = pieces.join(groups.filter("not one").select("stretch", F.col("other").alias("more")), ["stretch", "more"])
    texts = mixed.groupBy("stretch", "piece").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter(shared).select("stretch", "piece")
    found = found.unionByName(mixed.join(texts, ["stretch", "piece"]).select("class", "from"))
    return found.groupBy("class").agg(F.min("from").alias("first"), F.max("from").alias("last"))


def merged_runs(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, start, end: overlapping and touching spans joined to maximal runs."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = spans.withColumn("__new", F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1))
    return fresh.withColumn("__run", F.sum("__new").over(upto)).groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def shared_spans(df: DataFrame, key: str, text: str, least: int = 200, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """key, span_start, span_end: the maximal runs of characters that lie in least characters another key's text has too.

    key is a whole number. Starts are 0-based, ends exclusive, in Unicode characters of the text as it is. Rows with one
    key count as one document, each text of which gets its runs; a repeated row gives its runs once. Null, empty and
    short texts and null keys give no row, nor does a stretch that only repeats within its own document. Long texts are
    taken whole; extra columns are ignored.

    A signature whose windows all lie in one document is left at once. The others get the texts of their windows; equal ones
    are merged to a class with its lowest and highest document, so copies and stock lines are compared once. Up to group
    classes of a signature are compared where they meet; more are compared by grouping their stretches, so that no task
    holds a group without bound, and nothing is left out. Both ways compare texts, not hashes alone.
    """
    gram = max(1, least // 2) if gram is None else gram
    if not 0 < gram <= least:
        raise ValueError("gram must be between 1 and least")
    ship(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).cast("string").alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= least))
    rows = materialise(window_rows(docs, least, gram))
    met = rows.groupBy("sig").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")).filter("low != high").select("sig", "n")
    hits = skew_join(rows, met, "sig", "n", rows.agg(F.count(F.lit(1)).alias("n")), "left_semi")
    # The places of one text: bounded by its own length.
    places = hits.groupBy("doc", "row").agg(F.collect_set(F.struct("sig", "at", "low", "high")).alias("hits"))
    near = materialise(_surroundings(docs.join(places, ["doc", "row"]).select("doc", "row", "text", "hits")))
    name = F.struct("sig", "head", F.xxhash64("around").alias("a"), F.xxhash64(F.lit(1), "around").alias("b"))
    classes = near.groupBy("sig", "head", "around").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.select("sig", "head", "around", "n", name.alias("class"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1).alias("owner")))
    sizes = classes.groupBy("sig").agg(F.count(F.lit(1)).alias("classes"))
    sized = skew_join(classes, sizes, "sig", "classes", classes.agg(F.count(F.lit(1)).alias("n")))
    reach = _compared(sized.filter(F.col("classes") <= group), least).unionByName(_stretches(sized.filter(F.col("classes") > group), least))
    reach = reach.join(classes.select("class", "n"), "class")
    members = near.select("doc", "row", "at", name.alias("class"))
    total = classes.agg(F.sum("n").alias("n"))
    spans = skew_join(members, reach, "class", "n", total).select("doc", "row", (F.col("at") + F.col("first")).alias("span_start"), (F.col("at") + F.col("last") + least).alias("span_end"))
    return merged_runs(spans, ["doc", "row"], "span_start", "span_end").select(F.col("doc").alias(key), "span_start", "span_end").distinct()


def shared_share(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """key, n_chars, n_spans, shared_chars, shared_share: how much of each text is in the spans.

    One row for each row of df; null texts have null n_chars and share, empty ones a null share.
    """
    sums = spans.groupBy(key).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    out = df.select(key, F.length(text).alias("n_chars")).join(sums, key, "left").na.fill(0, ["n_spans", "shared_chars"])
    return out.select(key, "n_chars", "n_spans", "shared_chars", F.try_divide(F.col("shared_chars"), F.col("n_chars")).alias("shared_share"))
