"""Operator 5, exact substring dedup: bounded common prefixes from a Burrows-Wheeler transform.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier (smaller doc_id, or
same document and earlier start). Equal strings must meet, though no machine holds all texts:

1. Each window of ``LENGTH`` bytes is named by the least hash of the ``GRAM``-byte strings in it, so
   equal windows have one name. Neighbouring windows mostly share theirs: such a run is
   one piece of text. Names that occur once in all documents settle their windows.
2. Pieces of the other names, equal ones of a split merged before, are dealt by name. The pieces
   that meet are one text, each ended by a separator. Its suffixes are sorted to ``LENGTH``
   symbols, which gives the transform; breadth-first backward extension of intervals
   then finds where the common prefix of neighbouring suffixes has 0, 1, 2, ... symbols and
   stops at ``LENGTH`` - 1: what is left undivided are equal windows, of which the earliest stays.
3. The flags of windows go back to the documents' splits, where bytes are removed.

The texts are shuffled once, by splits of about ``SPLIT_BYTES``, and that exchange serves all three
passes; else only names and pieces travel. A passage in a large share of the documents would
give its names to windows that reach into the different texts around it. So strings
that are frequent in a bounded sample (``SAMPLE`` documents) name a window only if it has no
other: windows within the passage stay together as a few equal pieces, and the
others are spread. The sample moves windows between tasks and never changes a result.

Edge cases: null is empty text; texts under ``LENGTH`` bytes stay whole; rows with equal doc_id have
an order of their own (their place by text within a split, then the split), so that a hot or null id spreads over
splits and only whole copies of a row meet in one; rows with null doc_id come last; an empty table gives no rows; other
columns pass through, unless they have a result's name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import U64, flat, mix, widen, widened

LENGTH = 100
GRAM = 24
SPLIT_BYTES = 4 << 20
#: Rows and bytes a text may have to be in the sample; its strings found in so many texts are frequent.
SAMPLE, SAMPLE_BYTES, FREQUENT = 2000, 1 << 14, 8

_LAST = np.iinfo(np.int64).max
_SPLIT = "__sub_split"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for each ``GRAM`` bytes in a row."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U64)
    data = np.ascontiguousarray(data)
    eight = lambda k: np.ndarray((n,), "<u8", data, k, (1,))
    h = eight(0) * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h += eight(8)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    h += eight(16)
    return mix(h)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


class Frequent:
    """A sorted set of hashes behind a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << 20, bool)
        self.table[hashes & U64((1 << 20) - 1)] = True

    def among(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[x & U64((1 << 20) - 1)])
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)
            at = at[self.hashes[place] == x[at]]
        return at


def runs(data: np.ndarray, offsets: np.ndarray, frequent: Frequent, twice: bool = False) -> tuple[np.ndarray, ...]:
    """First window, number of windows and name of each run of windows with one name.

    With ``twice`` also the names whose string occurs twice within a window's reach: such a run
    can repeat windows in itself.
    """
    grams = gram_hashes(data) >> U64(1)
    if len(grams) < LENGTH - GRAM + 1:
        return (np.zeros(0, np.int64),) * (3 + twice)
    grams[frequent.among(grams)] |= U64(1 << 63)
    names = sliding_min(grams, LENGTH - GRAM + 1)
    change = np.zeros(len(names) + 1, np.int8)  # over windows: 1 where a text's windows begin, -1 past their end
    long = offsets[1:] - offsets[:-1] >= LENGTH
    change[offsets[:-1][long]] = 1
    np.add.at(change, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    begins = np.r_[True, names[1:] != names[:-1]]
    begins[offsets[:-1][long]] = True
    begins &= valid
    starts = np.flatnonzero(begins)
    place = np.cumsum(begins) - 1
    counts = np.bincount(place[valid], minlength=len(starts))
    found = starts, counts, names[starts].view(np.int64)
    if twice:
        reach = np.zeros(LENGTH - GRAM, U64)
        chosen = grams[grams == ~sliding_min(~np.concatenate((reach, names, reach)), LENGTH - GRAM + 1)]
        found += (chosen[1:][chosen[1:] == chosen[:-1]].view(np.int64),)
    return found


def _ordered(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A split's rows by doc_id and text; ids with nulls as the largest; which of equal ids a row is; bytes and offsets."""
    table = table.append_column("__sub_id", pc.fill_null(table.column("doc_id").cast(pa.int64()), _LAST))
    table = table.take(pc.sort_indices(table, [("__sub_id", "ascending"), ("text", "ascending")]))
    part = table.combine_chunks().to_batches()[0]
    ids = part.column("__sub_id").to_numpy(zero_copy_only=False)
    first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0)) if len(ids) else ids
    data, offsets = flat(part.column("text"))
    return part, ids, nth, data, offsets


def _names(table: pa.Table, frequent) -> pa.Table:
    _, _, _, data, offsets = _ordered(table)
    _, _, names, twice = runs(data, offsets, frequent.value, True)
    names, counts = np.unique(names, return_counts=True)
    counts[np.isin(names, twice)] += 1
    return pa.table({"split": np.full(len(names), table.column(_SPLIT)[0].as_py(), np.int32), "name": names, "many": counts > 1})


def _repeated(batches):
    """From rows sorted by name, those whose name several rows have, or one with many."""
    held, known = None, None  # a last row that may be repeated; a name that is
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        name = rows.column("name").to_numpy(zero_copy_only=False)
        many = rows.column("many").to_numpy(zero_copy_only=False).astype(bool)
        begins = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        sizes = np.diff(np.r_[begins, len(name)])
        keep = (sizes > 1) | np.logical_or.reduceat(many, begins)
        keep[0] |= known == name[0]
        held, known = (None, name[-1]) if keep[-1] else (rows.slice(len(name) - 1), None)
        yield rows.filter(pa.array(np.repeat(keep, sizes))).select(["split", "name"])


def _candidates(ids, nth, data, offsets, names_wanted: np.ndarray, frequent):
    starts, counts, names = runs(data, offsets, frequent)
    if len(names_wanted) and len(names):
        wanted = np.unique(names_wanted)
        place = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
        keep = wanted[place] == names
    else:
        keep = np.zeros(len(names), bool)
    starts, counts, names = starts[keep], counts[keep], names[keep]
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, counts, names, row


def _begins(split: int, nth: np.ndarray, starts: np.ndarray, splits: int, bits: int) -> np.ndarray:
    """Where pieces begin among all texts of their ids: the row's own number among rows of that id, then the place in its text."""
    return (nth * splits + split << bits) + starts


def _pieces(docs: pa.Table, keys: pa.Table, frequent, splits: int, bits: int) -> pa.Table:
    _, ids, nth, data, offsets = _ordered(docs)
    names = keys.column("name").to_numpy() if keys.num_rows else np.zeros(0, np.int64)
    starts, counts, names, row = _candidates(ids, nth, data, offsets, names, frequent.value)
    text, seen, keep, pieces = data.tobytes(), set(), [], []
    for k, (a, n) in enumerate(zip(starts.tolist(), counts.tolist())):
        piece = text[a : a + n + LENGTH - 1]
        if piece not in seen:
            seen.add(piece)
            keep.append(k)
            pieces.append(piece)
    split = docs.column(_SPLIT)[0].as_py() if docs.num_rows else 0
    at = _begins(split, nth[row], starts - offsets[row], splits, bits)
    return pa.table({"name": names[keep], "doc": ids[row][keep], "at": at[keep], "split": np.full(len(keep), split, np.int32), "piece": pa.array(pieces, pa.binary())})


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first ``depth`` symbols (of 9 bits), by doubling.

    Each round sorts only suffixes that are still equal to a neighbour, within their places.
    """
    n = len(symbols)
    padded = np.zeros(n + 6, np.int64)
    padded[:n] = symbols
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    order = np.argsort(key)
    ordered, known = key[order], 7
    rank = np.empty(n, np.int64)  # the place behind a suffix's equals
    places = np.arange(n)  # of suffixes that are not yet alone
    while True:
        ends = np.flatnonzero(np.r_[ordered[1:] != ordered[:-1], True]) if len(ordered) else places
        sizes = np.diff(np.r_[-1, ends])
        rank[order[places]] = np.repeat(places[ends] + 1, sizes)
        open_ = np.repeat(sizes > 1, sizes)
        places = places[open_]
        if known >= depth or not len(places):
            return order
        step = min(known, depth - known)
        at = order[places]
        further = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], 0)
        ordered = rank[at] * (n + 1) + further
        again = np.argsort(ordered)
        order[places], ordered = at[again], ordered[again]
        known += step


def short_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order`` whether the suffix has under ``length`` symbols in common with the one before.

    Breadth-first backward extension on the transform: the interval of a string of k + 1 symbols
    that ends at a place nothing has reached yet shows a common prefix of k symbols there. Every
    place is reached once, so all levels together take time in proportion to the text.
    Strings go on to the left of a separator's string, never over it.
    """
    n = len(symbols)
    first, before = symbols[order], symbols[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    reached = np.zeros(n + 1, bool)
    owner = np.empty(n, np.int32)
    lower, upper = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for k in range(length):
        sizes = upper - lower
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(lower - begin, sizes)
        own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if k:
            real = before[at] != 0
            at, own = at[real], own[real]
        to = back[at]
        owner[to] = own
        to = np.sort(to)
        if not len(to):
            break
        o, f = owner[to], first[to]
        new = np.flatnonzero(np.r_[True, (to[1:] != to[:-1] + 1) | (o[1:] != o[:-1]) | (f[1:] != f[:-1])])
        lower, upper = to[new], to[np.r_[new[1:], len(to)] - 1] + 1
        fresh = ~reached[upper]
        lower, upper = lower[fresh], upper[fresh]
        reached[upper] = True
        if not len(lower):
            break
    reached[0] = True
    return reached[:n]


def later_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, in order of place, which of its windows occurred before."""
    lengths = np.array([len(p) + 1 for p in pieces], np.int64)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = data.astype(np.int16) + 1
    ends = np.cumsum(lengths)
    symbols[ends - 1] = 0
    order = suffix_order(symbols, LENGTH)
    group = np.cumsum(short_prefixes(symbols, order, LENGTH))
    valid = np.ones(len(symbols), bool)
    for k in range(LENGTH):  # no window begins so near to a piece's end
        valid[np.maximum(ends - 1 - k, 0)] = False
    inside = valid[order]
    order, group = order[inside], group[inside]
    flags = np.zeros(len(symbols), bool)
    if len(order):
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.repeat(np.minimum.reduceat(order, begins), np.diff(np.r_[begins, len(order)]))
        flags[order[order != least]] = True
    return [flags[e - n : e - LENGTH] for e, n in zip(ends.tolist(), lengths.tolist())]


#: Bytes of different pieces whose suffixes are sorted together, whole names at least.
_TOGETHER = 1 << 19


def _resolve(batches):
    """From pieces sorted by name and place: for each different piece, at its first place, the windows that occurred before.

    Equal pieces are dropped as they arrive, so a name that very many texts share takes the memory of
    its different pieces only.
    """

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, at = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "at"))
        order = np.lexsort((at, doc))
        piece = part.column("piece").to_pylist()
        flags = later_windows([piece[k] for k in order.tolist()])
        masks = [np.packbits(f).tobytes() if f.any() else b"" for f in flags]
        return pa.record_batch([part.column("split").take(pa.array(order)), pa.array(doc[order]), pa.array(at[order]), pa.array(masks, pa.binary())], names=["split", "doc", "at", "mask"])

    held: list[pa.RecordBatch] = []
    size, last, seen = 0, None, set()
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            name, keep = last, []
            for k, (n, piece) in enumerate(zip(part.column("name").to_pylist(), part.column("piece").to_pylist())):
                if n != name:
                    name, seen = n, set()
                if piece not in seen:
                    seen.add(piece)
                    keep.append(k)
            if not keep:
                continue
            part = part.take(pa.array(keep))
            names = part.column("name").to_numpy(zero_copy_only=False)
            begin = int(np.searchsorted(names, names[-1]))  # of the last name
            if size >= _TOGETHER and (begin or last != names[-1]):
                yield solve(pa.concat_batches([*held, part.slice(0, begin)]))
                held, size, part = [], 0, part.slice(begin)
            held.append(part)
            size += sum(map(len, part.column("piece").to_pylist()))
            last = name
    if held:
        yield solve(pa.concat_batches(held))


_NEW = "n_bytes bigint, n_removed bigint, removed_spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(docs: pa.Table, told: pa.Table, frequent, as_text: bool, splits: int, bits: int) -> pa.Table:
    part, ids, nth, data, offsets = _ordered(docs)
    n = part.num_rows
    told = told.combine_chunks()
    named = told.filter(pc.is_valid(told.column("name")))
    names = named.column("name").to_numpy() if named.num_rows else np.zeros(0, np.int64)
    starts, counts, _, row = _candidates(ids, nth, data, offsets, names, frequent.value)
    flags = np.zeros(len(data) + 1, np.int32)
    flags[starts] += 1
    flags[starts + counts] -= 1
    flags = np.cumsum(flags[:-1], dtype=np.int32) > 0
    masks = told.filter(pc.is_valid(told.column("mask")))
    if masks.num_rows and len(starts):
        places = _begins(part.column(_SPLIT)[0].as_py(), nth[row], starts - offsets[row], splits, bits)
        at = {(d, a): (s, c) for d, a, s, c in zip(ids[row].tolist(), places.tolist(), starts.tolist(), counts.tolist())}
        for d, a, m in zip(masks.column("doc").to_pylist(), masks.column("at").to_pylist(), masks.column("mask").to_pylist()):
            s, c = at[d, a]
            flags[s : s + c] = np.unpackbits(np.frombuffer(m, np.uint8), count=c) if m else False
    # a byte goes if one of the LENGTH windows that hold it is flagged
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    gone = total[1:] > 0
    gone[LENGTH - 1 :] = total[LENGTH:] > total[: max(len(data) - LENGTH + 1, 0)]
    del total, flags
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(gone & (np.r_[~gone[1:], True] | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    counted = np.zeros(len(data) + 1, np.int32)
    np.cumsum(gone, out=counted[1:])
    n_removed = (counted[offsets[1:]] - counted[offsets[:-1]]).astype(np.int64)
    n_bytes = np.diff(offsets)
    kept, kept_at = data[~gone].tobytes(), np.r_[0, np.cumsum(n_bytes - n_removed)].tolist()
    base = np.repeat(offsets[:-1], np.diff(np.searchsorted(begins, offsets)))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, offsets), pa.int32()), pa.StructArray.from_arrays([pa.array(begins - base), pa.array(ends - base)], ["start", "end"]))
    part = part.select([c for c in part.schema.names if c not in (_SPLIT, "__sub_id")])
    rest = [kept[a:b] for a, b in zip(kept_at, kept_at[1:])]
    rest = pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string()) if as_text else pa.array(rest, pa.binary())
    out = widen(part, ["n_bytes", "n_removed", "removed_spans", "kept_text" if as_text else "kept_bytes"], [n_bytes, n_removed, lists.cast(_SPANS), rest])
    return pa.Table.from_batches([out])


def _sample(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of strings that ``FREQUENT`` of about ``SAMPLE`` texts, of ``n`` in all, have."""
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    each = [np.zeros(0, U64)]
    for r in docs.select("text").where(chosen & (F.octet_length("text") <= SAMPLE_BYTES)).collect():
        each.append(np.unique(gram_hashes(np.frombuffer(r.text.encode(), np.uint8)) >> U64(1)))
    hashes, counts = np.unique(np.concatenate(each), return_counts=True)
    return hashes[counts >= FREQUENT]


def substring_dedup(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, removed_spans (byte offsets in the text) and kept_bytes.

    With ``as_text``, kept_text without characters that were cut apart takes the place of kept_bytes.
    """
    spark = docs.sparkSession
    octets = F.octet_length("text").cast("bigint")
    size, rows, longest = docs.agg(F.coalesce(F.sum(octets), F.lit(0)), F.count("*"), F.coalesce(F.max(octets), F.lit(0))).first()
    bits = longest.bit_length()
    frequent = spark.sparkContext.broadcast(Frequent(_sample(docs, rows)))
    n = max(1, math.ceil(size / SPLIT_BYTES))
    dealt = docs.withColumn(_SPLIT, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    names = dealt.groupBy(_SPLIT).applyInArrow(lambda t: _names(t, frequent), "split int, name bigint, many boolean")
    keys = names.repartition("name").sortWithinPartitions("name").mapInArrow(_repeated, "split int, name bigint")
    pieces = dealt.groupBy(_SPLIT).cogroup(keys.groupBy("split")).applyInArrow(lambda a, b: _pieces(a, b, frequent, n, bits), "name bigint, doc bigint, at bigint, split int, piece binary")
    masks = pieces.repartition("name").sortWithinPartitions("name", "doc", "at").mapInArrow(_resolve, "split int, doc bigint, at bigint, mask binary")
    new = f"{_NEW}, {'kept_text string' if as_text else 'kept_bytes binary'}"
    nothing = lambda kind: F.lit(None).cast(kind)
    told = keys.select("split", "name", nothing("bigint").alias("doc"), nothing("bigint").alias("at"), nothing("binary").alias("mask"))
    told = told.unionByName(masks.select("split", nothing("bigint").alias("name"), "doc", "at", "mask"))
    return dealt.groupBy(_SPLIT).cogroup(told.groupBy("split")).applyInArrow(lambda a, b: _remove(a, b, frequent, as_text, n, bits), widened(docs.schema, new))


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


SQL = f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
f AS (SELECT b.doc_id, b.i, x, max(r.i IS NOT NULL) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone
      FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.i = b.i),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM f),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS k FROM g GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)"""
