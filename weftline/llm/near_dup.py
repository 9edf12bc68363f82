"""MinHash near-duplicate detection with tensored banding.

Texts are lower-cased (A-Z), cut into words at ASCII white space, and turned
into the set of their distinct five-word shingles (a text of one to four words
has its whole sequence as one shingle; a text without words has none).

1. Each text gets two collections of M half-keys of R minhashes each, so
   2 * M * R minhashes serve the M * M tables whose keys combine a half-key of
   the first collection with one of the second.
2. Texts with equal shingle sets (two fingerprints of 64 bits, each from a hash
   of the words of its own) form a class; only one row per class goes on.
3. Classes that share a table key form a bucket. Equal buckets of different
   tables are merged by their membership, so that a group of copies is looked
   at once, not M * M times.
4. In a bucket, 64 one-byte minhashes and the set sizes screen the pairs; the
   spanning edges of the screened relation give candidate groups, which hold
   every similar pair of the buckets (a pair at the threshold fails the screen
   with a probability below 1e-6).
5. In a candidate group, full shingle sets decide every link that can still
   change the components; a link counts if both hashes of the shingles say so.
   A group of more than GROUP_ROWS texts or GROUP_CAP shingles is first held
   against its HUBS most screened texts, slice by slice, in one pass; a text
   that is linked with a hub is absorbed. Then only the texts that no hub
   absorbed meet the group, block by block: work grows with a group's size
   times the number of its texts apart from the hubs, not with its square, and
   no task gets more than about two blocks.

A pair at exactly a threshold of J shares a table with a probability of
(1 - (1 - J^R)^M)^2: 0.99993 with R = 2 and M = 8 at 0.85. Thresholds from 0.8
to below 0.85 take M = 10, which is 0.99993 at 0.8, and a lower screen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from ._graph import block_pairs, connected_components
from ._place import file_of, in_place
from ._session import Scratch, ship, small

R, M = 2, 8
SKETCH = 64
#: Equal bytes of the sketch that a candidate pair has at least.
SCREEN = 38
#: M and SCREEN for thresholds from 80 to below 85 percent.
LOW_M, LOW_SCREEN = 10, 34
#: Members of a bucket, and texts and shingles of a candidate group, that one task takes on.
BUCKET_CAP = 8192
GROUP_ROWS = 128
GROUP_CAP = 500_000
#: Texts of a larger candidate group that all others are compared with first.
HUBS = 4

_MUL, _ADD = t.multipliers(SKETCH, 3)
_FP = t.multipliers(1, 17)[0]

_SIGNED = "doc_id long, file string, n_shingles long, f1 long, f2 long, a array<long>, b array<long>, sketch binary"

#: Sets of shingles, a text after the other: the sorted hashes and each text's first (n + 1 entries).
Sets = tuple[np.ndarray, np.ndarray]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, Sets, Sets]]:
    """(first row, end row, sets by one hash of the words, sets by another) of slices of the texts."""
    for i, j, data, offsets in t.slices(texts):
        starts, ends, first = t.word_bounds(data, offsets)
        one, two = (t.distinct_sorted(*t.shingle_hashes(t.span_hashes(data, starts, ends, seed=k), first)) for k in range(2))
        yield i, j, one, two


def fingerprint(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offs) - 1, np.uint64)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        out[some] = np.add.reduceat(t.mix(flat * _FP), offs[:-1][some])
    return out.view(np.int64)


def minhashes(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """SKETCH 32-bit minima for each set; zeros for an empty one."""
    out = np.zeros((len(offs) - 1, SKETCH), np.uint32)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        at = offs[:-1][some]
        step = max(1, (1 << 16) // max(1, len(flat) // len(some)))
        for lo in range(0, len(some), step):  # blocks that stay in the cache
            rows = some[lo : lo + step]
            part = flat[offs[rows[0]] : offs[rows[-1] + 1]]
            cut = at[lo : lo + step] - offs[rows[0]]
            for k in range(SKETCH):
                h = ((part * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
                out[rows, k] = np.minimum.reduceat(h, cut)
    return out


def _sign(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, (flat, offs), other in shingle_sets(batch.column("text")):
                mins = minhashes(flat, offs)
                halves = []
                for side in range(2):
                    h = np.zeros((j - i, m), np.uint64)
                    for r in range(R):
                        h = t.mix(h * np.uint64(0x9E3779B97F4A7C15) + mins[:, side * m * R + r : (side + 1) * m * R : R].astype(np.uint64) + np.uint64(1))
                    halves.append(t.list_array(h.view(np.int64), m, pa.int64()))
                sketch = np.ascontiguousarray(mins.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("file").slice(i, j - i),
                        pa.array(np.diff(offs).astype(np.int64)),
                        pa.array(fingerprint(flat, offs)),
                        pa.array(fingerprint(*other)),
                        *halves,
                        t.binary_array([row.tobytes() for row in sketch]),
                    ],
                    ["doc_id", "file", "n_shingles", "f1", "f2", "a", "b", "sketch"],
                )

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by their first `keys` integer columns: a table of groups, and where each begins (with the end)."""
    held: list[pa.RecordBatch] = []
    last: list[int] | None = None

    def columns(table: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        return [np.asarray(table.column(c)) for c in range(keys)]

    def changes(cols: list[np.ndarray]) -> np.ndarray:
        change = np.zeros(len(cols[0]), bool)
        for x in cols:
            change[1:] |= x[1:] != x[:-1]
        return change

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts)
        return table, np.concatenate([[0], np.flatnonzero(changes(columns(table))), [len(table)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns(batch)
        change = changes(cols)
        change[0] = last is not None and any(x[0] != y for x, y in zip(cols, last))
        last = [x[-1] for x in cols]
        at = np.flatnonzero(change)
        if len(at):
            if held or at[-1]:
                yield whole([*held, batch.slice(0, int(at[-1]))])
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield whole(held)


def _screen(percent: int, screen: int):
    """Spanning edges of the pairs that pass the screen, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups(batches, 3):
            node = table.column("rep").to_numpy()
            size = table.column("n_shingles").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), SKETCH)
            out: list[np.ndarray] = []
            width = np.diff(bounds)
            two = bounds[:-1][width == 2]
            same = (sketch[two] == sketch[two + 1]).sum(1, dtype=np.int32) >= screen
            same &= 100 * np.minimum(size[two], size[two + 1]) >= percent * np.maximum(size[two], size[two + 1])
            out.append(np.stack([node[two[same]], node[two[same] + 1]]))
            for g in np.flatnonzero(width > 2):
                lo, hi = bounds[g], bounds[g + 1]
                out.append(_forest(node[lo:hi], size[lo:hi], sketch[lo:hi], percent, screen))
            edges = np.concatenate(out, axis=1)
            if edges.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])

    return run


def _forest(node: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int, screen: int) -> np.ndarray:
    """Edges (2, n) that connect what the screen connects, found breadth first from the most typical member."""
    by = np.sort(sketch, axis=0)[len(node) // 2]
    left = np.lexsort((node, -(sketch == by).sum(1, dtype=np.int32)))
    frontier: list[int] = []
    found: list[tuple[np.ndarray, int]] = []
    while len(left):
        if frontier:
            x = frontier.pop()
        else:
            x, left = int(left[0]), left[1:]
        ok = (sketch[left] == sketch[x]).sum(1, dtype=np.int32) >= screen
        ok &= 100 * np.minimum(size[left], size[x]) >= percent * np.maximum(size[left], size[x])
        hit = left[ok]
        if len(hit):
            found.append((node[hit], node[x]))
            frontier += hit.tolist()
            left = left[~ok]
    if not found:
        return np.zeros((2, 0), np.int64)
    return np.stack([np.concatenate([f for f, _ in found]), np.concatenate([np.full(len(f), x) for f, x in found])])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both shingle sets of each row whose text has the row's fingerprints."""
    for batch in batches:
        keep = {name: batch.column(name) for name in ("component", "rep", "rows", "total", "degree")}
        want = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("f1", "f2")]
        for i, j, one, two in shingle_sets(batch.column("text")):
            rows = np.flatnonzero((fingerprint(*one) == want[0][i:j]) & (fingerprint(*two) == want[1][i:j]))
            sets = [t.binary_array([flat[offs[r] : offs[r + 1]].tobytes() for r in rows]) for flat, offs in (one, two)]
            take = pa.array(rows + i)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in keep.values()), *sets], [*keep, "shingles", "others"])


_MEMBER = "component long, rep long, rows long, total long, degree long, shingles binary, others binary"


def similar(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def link(sets: list[np.ndarray], others: list[np.ndarray], percent: int, root: np.ndarray | None = None, active: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest position connected with it by links of 100 * intersection >= percent * union.

    `others` holds the same sets by another hash and must confirm a link. One
    set after another, the most typical first, is compared with all sets
    outside its component; so copies of one text cost one pass, and a pair is
    left out only where it cannot change the components. `root` says what is
    connected already, `active` which sets are compared with the rest (all).
    """
    n = len(sets)
    parent = np.arange(n) if root is None else root.copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    typical = np.add.reduceat(df[inverse], offs[:-1]) / sizes
    mark = np.zeros(len(flat), np.int32)
    done = np.zeros(n, bool)
    for x in np.argsort(-typical, kind="stable"):
        if active is not None and not active[x]:
            continue
        done[x] = True
        near = np.flatnonzero((parent != parent[x]) & ~done & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])))
        if not len(near):
            if (parent == parent[0]).all():
                break
            continue
        own = inverse[offs[x] : offs[x + 1]]
        mark[own] = 1
        at = np.concatenate([[0], np.cumsum(sizes[near])])
        both = np.add.reduceat(mark[inverse[t.ragged(offs[near], sizes[near])]], at[:-1])
        mark[own] = 0
        hit = near[similar(both, sizes[near], sizes[x], percent)]
        hit = hit[[similar(len(np.intersect1d(others[x], others[y], True)), len(others[x]), len(others[y]), percent) for y in hit.tolist()]] if len(hit) else hit
        if len(hit):
            roots = np.unique(np.append(parent[hit], parent[x]))
            parent[np.isin(parent, roots)] = roots[0]
    return parent


def _members(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[np.ndarray], list[np.ndarray]]]:
    """Groups of rows without repeats, and both sets of their rows."""
    for table, bounds in groups(batches, keys):
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            one = table.slice(lo, hi - lo)
            raw, rep = one.column("shingles").to_pylist(), one.column("rep").to_pylist()
            rows = sorted({(r, x): k for k, (r, x) in enumerate(zip(rep, raw))}.values())
            if len(rows) > 1:
                other = one.column("others").to_pylist()
                yield one.take(rows), [np.frombuffer(raw[k], np.uint64) for k in rows], [np.frombuffer(other[k], np.uint64) for k in rows]


def _edges(ids: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sets, others in _members(batches, 2):
            yield _edges(table.column("rep").to_numpy(), link(sets, others, percent))

    return run


def _absorb(percent: int):
    """(component, rep, hub) of the texts of a slice, its hubs among them.

    Of the hubs those count that hang together with the most others; all texts
    linked with one of them get the same hub, the others null.
    """

    def alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
        a, b = len(x[0]), len(y[0])
        return 100 * min(a, b) >= percent * max(a, b) and all(similar(len(np.intersect1d(p, q, True)), len(p), len(q), percent) for p, q in zip(x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups(batches, 2):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                one = table.slice(lo, hi - lo)
                rep, is_hub = one.column("rep").to_numpy(), np.asarray(one.column("is_hub"))
                sets = list(zip(*([np.frombuffer(x, np.uint64) for x in one.column(c).to_pylist()] for c in ("shingles", "others"))))
                hubs = np.flatnonzero(is_hub).tolist()
                label = {h: h for h in hubs}
                for x in hubs:
                    for y in hubs:
                        if x < y and label[x] != label[y] and alike(sets[x], sets[y]):
                            label = {h: label[x] if v == label[y] else v for h, v in label.items()}
                sizes = {v: list(label.values()).count(v) for v in label.values()}
                main = max(sizes, key=lambda v: (sizes[v], -v))
                main = [h for h in hubs if label[h] == main]
                found = [k in main or not is_hub[k] and any(alike(sets[k], sets[h]) for h in main) for k in range(len(rep))]
                hub = pa.array(np.full(len(rep), rep[main].min()), mask=~np.array(found))
                yield pa.RecordBatch.from_arrays([one.column("component").combine_chunks(), one.column("rep").combine_chunks(), hub], ["component", "rep", "hub"])

    return run


def _rest(percent: int):
    """Links of the texts that no hub absorbed with those of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sets, others in _members(batches, 3):
            apart = np.asarray(table.column("hub").is_null())
            start = np.arange(len(apart))
            start[~apart] = start[~apart][:1]  # one component already
            yield _edges(table.column("rep").to_numpy(), link(sets, others, percent, start, apart))

    return run


def _linked(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect what the shingle sets of the candidate groups link."""
    keys = ["component", "bi"]
    large = (F.col("rows") > GROUP_ROWS) | (F.col("total") > GROUP_CAP)
    whole = sets.where(~large).select("component", F.lit(0).alias("bi"), "rep", "shingles", "others")
    edges = whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(percent), "u long, v long")

    sets = sets.where(large)
    if sets.isEmpty():
        return edges
    n = F.ceil(F.greatest(F.col("rows") / F.lit(GROUP_ROWS), F.col("total") / F.lit(GROUP_CAP))).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    every = F.sequence(F.lit(0), n - 1)
    typical = Window.partitionBy("component").orderBy(F.desc("degree"), "rep")
    hubs = sets.select("component", "rep", "degree").distinct().withColumn("k", F.row_number().over(typical)).where(F.col("k") <= HUBS).select(F.col("rep").alias("hub"))
    hubs = sets.join(small(hubs, hubs.count()), sets.rep == F.col("hub"), "left").withColumn("is_hub", F.col("hub").isNotNull()).drop("hub")
    slices = hubs.withColumn("bi", F.explode(F.when(F.col("is_hub"), every).otherwise(F.array(own))))
    slices = slices.select("component", "bi", "rep", "is_hub", "shingles", "others").repartition(*keys).sortWithinPartitions(*keys, F.desc("is_hub"), "rep")
    absorbed = scratch.table(slices.mapInArrow(_absorb(percent), "component long, rep long, hub long").distinct(), "absorbed")
    star = absorbed.where("hub <> rep").select(F.col("rep").alias("u"), F.col("hub").alias("v"))

    # Blocks (bi, bj): the bi-th part of the texts apart, and the bj-th of the whole group.
    left = absorbed.where("hub is null").groupBy("component").agg(F.count("*").alias("apart")).withColumnRenamed("component", "_c")
    absorbed = absorbed.select(F.col("rep").alias("_rep"), "hub")
    rest = sets.join(left, F.col("component") == F.col("_c")).join(absorbed, F.col("rep") == F.col("_rep"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("apart") * n / F.col("rows"))).cast("int")
    mine = F.struct(F.pmod(F.xxhash64("rep", F.lit(1)), parts).cast("int").alias("bi"), F.lit(None).cast("int").alias("bj"))
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("bi"), own.alias("bj")))
    both = F.transform(every, lambda j: F.struct(mine["bi"].alias("bi"), j.cast("int").alias("bj")))
    rest = rest.withColumn("b", F.explode(F.when(F.col("hub").isNull(), F.array_union(pairs, both)).otherwise(pairs)))
    keys = ["component", "bi", "bj"]
    rest = rest.select("component", "b.bi", "b.bj", "rep", "hub", "shingles", "others").repartition(*keys).sortWithinPartitions(*keys)
    return edges.unionByName(star).unionByName(rest.mapInArrow(_rest(percent), "u long, v long"))


def _components(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """near_duplicates' rows, and the input file of each where there is one."""
    if not 80 <= percent <= 100:
        raise ValueError("percent: 80 to 100")
    m, screen = (M, SCREEN) if percent >= 85 else (LOW_M, LOW_SCREEN)
    ship(docs.sparkSession)
    at = file_of(docs)
    id_, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    named = docs.select(id_, text, (F.lit(None).cast("string") if at is None else at).alias("file"))
    signed = scratch.table(named.mapInArrow(_sign(m), _SIGNED), "signed")

    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles")
    first = F.min(F.struct("doc_id", "file"))
    classes = classes.agg(first.alias("low"), F.count("*").alias("copies"), F.first(F.struct("a", "b", "sketch")).alias("s"))
    classes = scratch.table(classes.select("f1", "f2", "n_shingles", "copies", F.col("low.doc_id").alias("rep"), "low.file", "s.*"), "classes")

    keys = classes.select("rep", F.posexplode("a").alias("i", "x"), "b").select("rep", "i", "x", F.posexplode("b").alias("j", "y"))
    keys = keys.select(F.xxhash64("i", "j", "x", "y").alias("key"), "rep")
    found = keys.groupBy("key").agg(
        F.count("*").alias("c"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2")
    )
    found = found.where("c > 1").groupBy("c", "low", "x1", "x2").agg(F.min("key").alias("key"))
    found = scratch.table(found.select("key", "c", F.xxhash64("c", "low", "x1", "x2").alias("bucket")), "buckets")
    members = keys.join(small(found, found.count()), "key").select("bucket", "c", "rep")
    members = scratch.table(members.join(classes.select("rep", "n_shingles", "sketch"), "rep"), "members")
    members = block_pairs(members, "c", BUCKET_CAP, "rep").select("bucket", "bi", "bj", "rep", "n_shingles", "sketch")
    members = members.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    screened = members.mapInArrow(_screen(percent, screen), "u long, v long")
    screened = scratch.table(screened.distinct(), "screened")  # many buckets of a group give one edge
    candidates = connected_components(screened, scratch, "candidates")

    ends = [screened.groupBy(F.col(c).alias("rep")).agg(F.count("*").alias("n")) for c in ("u", "v")]
    degree = ends[0].unionByName(ends[1]).groupBy("rep").agg(F.sum("n").alias("degree"))
    sized = candidates.join(classes.select(F.col("rep").alias("node"), "file", "f1", "f2", "n_shingles"), "node")
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("rows"))
    sized = sized.join(totals, "component").select("component", F.col("node").alias("rep"), "file", "f1", "f2", "rows", "total")
    sized = scratch.table(sized.join(degree, "rep"), "groups").withColumnRenamed("file", "_file")

    def sets_of(part: DataFrame, groups_of: DataFrame) -> DataFrame:
        texts = part.select(id_, text)
        texts = texts.join(groups_of, texts.doc_id == groups_of.rep).select("component", "rep", "rows", "total", "degree", "f1", "f2", "text")
        return texts.mapInArrow(_sets, _MEMBER)

    sets = scratch.table(in_place(docs, sized, sets_of, scratch, "texts"), "sets", "none")
    linked = scratch.table(_linked(sets, percent, scratch), "links")
    # Texts of one doc_id are one document: its classes' first ids are one, too.
    known = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "f1", "f2")
    twice = known.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("low"), F.max(F.struct("f1", "f2")).alias("high"))
    twice = scratch.table(twice.where("low <> high").select("doc_id"), "twice")
    several = known.join(small(twice, twice.count()), "doc_id").distinct()
    several = several.join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    linked = connected_components(linked.unionByName(several), scratch, "linked")

    low = classes.join(linked, classes.rep == linked.node, "left")
    low = low.where("copies > 1 or component is not null").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2", F.col("file").alias("_file")).join(low, ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "_file")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links with
    100 * intersection >= percent * union of shingle sets (percent from 80 to
    100), itself included; kept says whether doc_id is that id. A null or empty
    text, or one of white space, has no shingle and is linked with nothing.
    Rows that repeat a doc_id are one document: what links one of their texts
    links them all. A row with a null doc_id has a null component, links
    nothing and is kept. Other columns are not read.
    """
    return _components(docs, percent, Scratch(docs.sparkSession, "near_dup")).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; rows that share a doc_id stay or go together.

    Texts are not shuffled: see in_place().
    """
    scratch = Scratch(docs.sparkSession, "keep_one")
    gone = _components(docs, percent, Scratch(docs.sparkSession, "near_dup")).where("not kept")
    gone = scratch.table(gone.select(F.col("doc_id").alias("_gone"), "_file").distinct(), "gone")
    return in_place(docs, gone, lambda part, ids: part.join(ids, part["doc_id"].cast("long") == ids["_gone"], "left_anti"), scratch, "kept")
