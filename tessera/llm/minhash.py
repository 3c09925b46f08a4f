"""Operator 10, near-duplicates: an LSH forest, then exact links on full shingle sets.

1. One pass over the texts gives each document's number of shingles, a digest of its
   shingle set and a signature of 96 minimum hashes. Documents with
   one set are one class, named by its smallest id; only classes go on.
2. Forest: each order sorts the classes by the signature's values in a sequence of its own. The candidates of a
   class are its neighbours there, on both sides for as long as the longest common prefix of adjacent
   signatures doesn't fall under the region's depth. Depth adapts: ``LEVELS`` starts with
   prefixes of two values in 16 orders. The classes of a region that holds over ``REGION`` of them (counted
   before anything is moved) go on to longer prefixes, in as many more orders as that takes, and
   are not compared in that region; a region that at the last level still holds over ``REGION`` is
   compared whole, over ``2 * REGION`` dealt to blocks, with a task for every pair of blocks. What leaves a task are the edges of a
   spanning forest, never all pairs. A pair at similarity 0.75 is missed with a chance of about 2 in a
   million at each of the first two levels and 4 at the others, so of at most 12 in a million in
   the most crowded place; the signature's own test (``EQUAL``) misses 0.4 in a million.
3. The edges' components gather all that may be linked. Each is dealt to one task that holds
   the full shingle sets and counts intersections; a component of over ``SHINGLES`` shingles is
   cut into blocks, and every pair of blocks gets a task, so a task's memory is bounded and
   no link is lost. The links found, again as forests, give the components.

Edge cases: a null or empty text or one without words has an empty set, is linked with
nothing and kept; texts of fewer than five words have one shingle; repeated rows share
a class; rows with a null id never name a class but can be copies of one; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import U64, VISIBLE, blocks, flat, lower, mix, windows, word_hashes, words
from tessera.llm.components import Forest, components
from tessera.session import cut

WORDS = 5
PERCENT = 75
TREES, STEPS = 16, 6
#: Values of the prefix that makes a region, and orders, from level to level.
LEVELS = ((2, 16), (3, 24), (4, 56), (6, 160))
REGION = 4096
#: Least number of equal signature values, of 96, for an edge: five standard errors below 0.75.
EQUAL = 50
SHINGLES = 1_000_000

_HASHES = TREES * STEPS
_RANDOM = np.random.default_rng(5)
_A = _RANDOM.integers(1, 2**63, _HASHES, dtype=U64) * U64(2) + U64(1)
_B = _RANDOM.integers(0, 2**63, _HASHES, dtype=U64)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, one text after the other, and the offsets."""
    data, offsets = flat(texts)
    data = lower(data)
    starts, ends, at = words(data, offsets, VISIBLE)
    hashes, begins = windows(word_hashes(data, starts, ends), at, size)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    counts = np.bincount(row[fresh], minlength=len(begins) - 1)
    return hashes[fresh], np.concatenate(([0], np.cumsum(counts)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        sets, at = shingle_sets(part.column("text"))
        full = np.diff(at) > 0
        signature = np.full((len(full), _HASHES), 0xFFFFFFFF, np.uint32)
        if len(sets):
            for k in range(_HASHES):
                signature[full, k] = np.minimum.reduceat(((sets * _A[k] + _B[k]) >> U64(32)).astype(np.uint32), at[:-1][full])
        yield pa.record_batch(
            [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array(_sums(sets, at)), pa.array(_sums(mix(sets ^ U64(0xA5A5A5A5)), at)), pa.array([x.tobytes() if y else None for x, y in zip(signature, full)], pa.binary())],
            names=["doc_id", "n_shingles", "d1", "d2", "signature"],
        )


def _orders(level: int) -> list[np.ndarray]:
    """The sequence of values in each order of a level: prefixes are disjoint while there are values, then drawn by a fixed seed."""
    depth, count = LEVELS[level]
    apart = min(count, _HASHES // depth)
    random = np.random.default_rng(100 + level)
    return [np.roll(np.arange(_HASHES), -t * (_HASHES // apart)) if t < apart else random.permutation(_HASHES) for t in range(count)]


def _ordered_rows(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """A row for each class and order: the region of its prefix, and all values in that order, a byte each."""
    depth, orders = LEVELS[level][0], _orders(level)
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            n = part.num_rows
            ids = part.column("id").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(n, _HASHES)
            low = (sig & 0xFF).astype(np.uint8)
            keys = []
            for t, order in enumerate(orders):
                key = np.full(n, (level << 16) + t + 1, U64)
                for k in order[:depth]:
                    key = mix(key ^ sig[:, k].astype(U64))
                keys.append(key.view(np.int64))
            tail = np.concatenate([low[:, order] for order in orders])
            yield pa.record_batch([np.concatenate(keys), np.tile(ids, len(orders)), np.full(n * len(orders), depth, np.int32), pa.array([x.tobytes() for x in tail], pa.binary())], names=["region", "id", "depth", "tail"])


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups from rows sorted by ``key``."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        keys = held.column(key).to_numpy(zero_copy_only=False)
        cut_at = int(np.searchsorted(keys, keys[-1]))
        if cut_at:
            yield held.slice(0, cut_at)
            held = held.slice(cut_at)
    if held is not None:
        yield held


def _region_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _grouped(batches, "region"):
        region = part.column("region").to_numpy(zero_copy_only=False)
        ids = part.column("id").to_numpy(zero_copy_only=False)
        tail = np.frombuffer(b"".join(part.column("tail").to_pylist()), np.uint8).reshape(len(ids), _HASHES)
        unlike = tail[1:] != tail[:-1]
        common = np.where(unlike.any(1), unlike.argmax(1), _HASHES)  # the longest common prefix of neighbours
        begins = np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (common < part.column("depth").to_numpy(zero_copy_only=False)[1:])])
        sizes = np.diff(np.r_[begins, len(ids)])
        two = begins[sizes == 2]
        alike = (tail[two] == tail[two + 1]).sum(1) >= EQUAL
        a, b = [ids[two[alike]]], [ids[two[alike] + 1]]
        for s, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            left, rest = np.arange(s, s + n), np.ascontiguousarray(tail[s : s + n].T)
            queue: list[int] = []
            while len(left):
                if queue:
                    x = queue.pop()
                else:
                    x, left, rest = int(left[0]), left[1:], rest[:, 1:]
                near = (rest == tail[x][:, None]).sum(0, dtype=np.uint8) >= EQUAL
                if not near.any():
                    continue
                found, left, rest = left[near], left[~near], np.compress(~near, rest, axis=1)
                queue += found.tolist()
                a.append(np.full(len(found), ids[x]))
                b.append(ids[found])
        yield pa.record_batch([np.concatenate(a), np.concatenate(b)], names=["a", "b"])


def _block_pairs(name, id, n_blocks):
    """The tasks of a class whose group ``name`` is dealt to blocks: one for each pair of its block and another or the same."""
    own = F.pmod(F.xxhash64(id), n_blocks)
    return F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda x: F.xxhash64(name, F.least(own, x.cast("bigint")), F.greatest(own, x.cast("bigint"))))


def _forest_edges(classes: DataFrame) -> DataFrame:
    active, found = classes.select("id", "signature"), []
    for level in range(len(LEVELS)):
        rows = active.mapInArrow(lambda batches, level=level: _ordered_rows(batches, level), "region bigint, id bigint, depth int, tail binary")
        crowded = cut(rows.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > REGION), "crowded-regions")
        if crowded.isEmpty():
            found.append(rows)
            break
        if level + 1 < len(LEVELS):
            found.append(rows.join(crowded, "region", "left_anti"))
            inside = rows.join(crowded, "region", "left_semi").select("id").distinct()
            active = cut(active.join(inside, "id", "left_semi").select("id", "signature"), "crowded-classes")
        else:
            n_blocks = crowded.where(F.col("n") > 2 * REGION).select("region", F.ceil(F.col("n") / REGION).cast("int").alias("n_blocks"))
            pairs = F.when(F.col("n_blocks").isNull(), F.array("region")).otherwise(_block_pairs("region", "id", F.col("n_blocks")))
            found.append(rows.join(n_blocks, "region", "left").select(F.explode(pairs).alias("region"), "id", "depth", "tail"))
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    every = every.select("region", "id", "depth", "tail").repartition("region").sortWithinPartitions("region", "tail", "id")
    return every.mapInArrow(_region_edges, "a bigint, b bigint")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        sets, at = shingle_sets(part.column("text"))
        yield pa.record_batch([part.column("id"), part.column("tasks"), pa.array([sets[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["id", "tasks", "shingles"])


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (i, j) with 100 * intersection >= percent * union."""
    n, forest = np.array([len(s) for s in sets]), Forest()
    owner = np.repeat(np.arange(len(sets)), n)
    values = np.concatenate(sets)
    order = np.lexsort((owner, values))
    values, holder = values[order], owner[order]
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    offsets = np.r_[0, np.cumsum(n)]
    found: list[tuple[int, int]] = []
    for i in range(len(sets) - 1):
        if len(found) == len(sets) - 1:
            break
        e = place[offsets[i] : offsets[i + 1]]
        counts = end[e] - e - 1
        e, counts = e[counts > 0], counts[counts > 0]
        if not len(e):
            continue
        at = np.arange(counts.sum()) + np.repeat(e + 1 - np.r_[0, np.cumsum(counts)[:-1]], counts)
        common = np.bincount(holder[at], minlength=len(sets))
        for j in np.flatnonzero((common > 0) & (100 * common >= percent * (n + n[i] - common))).tolist():
            if forest.join(i, j):
                found.append((i, j))
    return found


def _link_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _grouped(batches, "task"):
        task = part.column("task").to_numpy(zero_copy_only=False)
        ids = part.column("id").to_pylist()
        data = [np.frombuffer(x, U64) for x in part.column("shingles").to_pylist()]
        begins = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]).tolist()
        out = [(ids[s + i], ids[s + j]) for s, e in zip(begins, [*begins[1:], len(ids)]) for i, j in links(data[s:e])]
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", "text")
    signed = cut(texts.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, signature binary"), "signatures")
    best = F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(best)
    classes = cut(classes.select("d1", "d2", F.col("x.doc_id").alias("id"), "x.n_shingles", "x.signature"), "classes")
    near = components(_forest_edges(classes))
    # whole components to one task, or pairs of blocks of a large one
    near = near.join(classes.select("id", "n_shingles"), "id")
    blocks_of = near.groupBy("component").agg(F.ceil(F.sum("n_shingles") / SHINGLES).cast("int").alias("n_blocks"))
    pairs = _block_pairs("component", "id", F.col("n_blocks"))
    dealt = cut(near.join(blocks_of, "component").select("id", "component", "n_blocks", pairs.alias("tasks")), "tasks")
    sets = texts.join(dealt.select("id", "tasks"), F.col("doc_id") == F.col("id")).select("id", "tasks", "text")
    sets = sets.mapInArrow(_sets, "id bigint, tasks array<bigint>, shingles binary")
    sets = sets.select(F.explode("tasks").alias("task"), "id", "shingles").repartition("task").sortWithinPartitions("task", "id")
    found = components(sets.mapInArrow(_link_edges, "a bigint, b bigint"))
    named = classes.select("d1", "d2", F.col("id").alias("class")).join(found.withColumnRenamed("id", "class"), "class", "left")
    named = named.select("d1", "d2", F.coalesce("component", "class").alias("component"))
    result = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    result = result.select("doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {WORDS - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS} + 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""
