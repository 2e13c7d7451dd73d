"""SimHash near-duplicates by covering locality-sensitive hashing.

Method: documents become 64-bit fingerprints of their word shingles. Every bit
gets a nonzero vector of r + 1 bits; table v (of 2^(r+1) - 1) keeps the bits whose
vector has an odd product with v. Any r differing bits leave some v orthogonal to
all their vectors, so every pair within radius r agrees on all kept bits of a
table: no link can be missed. Exact copies are one fingerprint from the start.

A bucket of up to ``block`` fingerprints is linked where it is streamed, by a
forest instead of all pairs. A larger one is dealt anew, in later rounds, over
covering tables that keep half of the bits it does not share; after two such
rounds about 8 bits are free, so a bucket has a few hundred fingerprints at most.
Links go to :mod:`components`.

:func:`duplicates` goes further, for pipelines: a pair with a Jaccard similarity of
0.8 differs in some ten bits of a fingerprint of its five-word shingles, too many
for any covering tables, but in about four bits of fingerprints of its *sets* of
shorter shingles. So candidates come from several such views, each covered within
its radius. All that candidates connect is one group, and within it the links are made
anew, by a forest over the shingles themselves: a candidate that fails costs no other pair.

Defined cases: null, empty and all-white texts have no words and fingerprint
zero, linked like any other; repeated rows are copies; documents with null ids
get a fingerprint, and a component_id from the others of their group (null if
there are none); an empty table gives no rows; only id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, durable, map_arrow, small_side
from .components import components

BITS = 64


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words, space-joined; fewer words are one run."""
    joined = b" ".join(words)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    size = min(size, len(words))
    starts = (ends - lengths)[: len(words) - size + 1]
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def _hashes(runs, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(r, seed) for r in runs], "<u8")


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit b is set if it is in over half of the shingle hashes."""
    words = text.lower().split() if text else []
    return _bits(_hashes(shingles(words, shingle), seed)) if words else 0


def _bits(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id_col, fp): the fingerprint as a signed long."""
    def task(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_arrow(rows, task, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def covering_masks(radius: int, bits: int = BITS, seed: int = 1) -> list[int]:
    """2^(radius+1) - 1 masks of bits to compare; a pair within the radius agrees under at least one."""
    dims = radius + 1
    rng = np.random.default_rng(seed)
    vectors = np.resize(np.arange(1, 1 << dims), bits)  # every vector about equally often
    rng.shuffle(vectors)
    return [sum(1 << b for b in range(bits) if (int(vectors[b]) & v).bit_count() & 1) for v in range(1, 1 << dims)]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what is within the radius in one bucket; at most one less than fingerprints."""
    left, stack, edges = np.arange(len(fps)), [], []
    while stack or len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
        i = stack.pop()
        near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
        found = left[near].tolist()
        left = left[~near]
        edges += [(i, j) for j in found]
        stack += found
    return edges


def _linked(buckets: DataFrame, radius: int, block: int, last: bool) -> DataFrame:
    """Rows (kind, view, mask, a, b): links between fingerprints (kind 0), or members of a bucket that is too large (kind 1)."""
    def task(batches):
        fps, key, over = [], None, False
        out: list[tuple[int, int, int, int, int]] = []

        def close():
            if len(fps) > 1 and not over:
                array = np.array(fps, np.int64).view(np.uint64)
                out.extend((0, key[0], 0, fps[i], fps[j]) for i, j in _forest(array, radius))

        def flush():
            columns = list(zip(*out, strict=True)) or [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kind", "view", "mask", "a", "b"])
            out.clear()
            return batch

        for batch in batches:
            views, masks, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("view", "mask", "fp"))
            keys = values & masks
            alone = np.ones(len(keys), bool)  # neither neighbour has its key
            same = (keys[1:] == keys[:-1]) & (masks[1:] == masks[:-1]) & (views[1:] == views[:-1])
            alone[1:] &= ~same
            alone[:-1] &= ~same
            if len(alone):
                alone[[0, -1]] = False
            for v, k, m, fp in zip(*(x[~alone].tolist() for x in (views, keys, masks, values)), strict=True):
                if (v, k, m) != key:
                    close()
                    fps, key, over = [], (v, k, m), False
                fps.append(fp)
                if not last and len(fps) > block:
                    over = True
                if over:
                    out.extend((1, v, m, fp, k) for fp in fps)
                    fps = []
                if len(out) >= 8192:
                    yield flush()
        close()
        yield flush()

    key = F.col("fp").bitwiseAND(F.col("mask"))  # not shuffled: it follows from the rest
    dealt = buckets.repartition("view", "mask", key).sortWithinPartitions("view", "mask", key, "fp")
    return map_arrow(dealt, task, "kind long, view long, mask long, a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """Edges (view, u, v) that join all different fingerprints (column fp) of a view that are within the radius; without column view there is one."""
    rows = classes.select(F.col("view").cast("int").alias("view") if "view" in classes.columns else F.lit(0).alias("view"), "fp")
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    found = durable(_linked(rows.select("view", "fp", F.explode(masks).alias("mask")), radius, block, last=False))
    edges, large = [found.where("kind = 0")], found.where("kind = 1")
    for seed in (2, 3):
        if large.isEmpty():
            break
        # Members of a large bucket agree on its mask: they are told apart by further bits, and stay with it.
        finer = F.explode(F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, seed=seed)])).alias("more")
        rows = large.select(F.col("view").cast("int").alias("view"), F.col("a").alias("fp"), "mask", finer)
        rows = rows.select("view", "fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask"))
        found = durable(_linked(rows.distinct(), radius, block, last=seed == 3))
        edges.append(found.where("kind = 0"))
        large = found.where("kind = 1")
    joined = edges[0]
    for more in edges[1:]:
        joined = joined.unionByName(more)
    return joined.select("view", F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, block: int = 4096) -> DataFrame:
    """(id_col, fp, component_id): the smallest id that is reachable over links within the radius."""
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    classes = durable(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(classes, radius, block).select("u", "v"))
    # root is the smallest fingerprint; the smallest id of its group has to be found
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    members = durable(members.join(classes, "fp"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = members.join(least, "root").select("fp", "component_id")
    of = classes.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(of, "fp").select(id_col, "fp", "component_id")


#: (words of a shingle, salt of its hashes) of the views that give candidates: sets of shingles, without counts.
VIEWS = ((1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 1))
#: Shingle sets of a group that one place takes; of a larger group, two blocks of so many.
BLOCK_BYTES = 16 << 20


def _mixed(hashes: np.ndarray, salts: list[int]) -> np.ndarray:
    """For each salt, hashes as good as those of another seed, without reading the shingles again."""
    z = hashes + np.array([salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for salt in salts], np.uint64)[:, None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def run_set(words: np.ndarray, size: int) -> np.ndarray:
    """The set of hashes of all runs of ``size`` words, ascending, from the words' hashes; fewer words are one run."""
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for j in range(size):
        total = (total ^ words[j : j + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _views(text: bytes | None, views, hashes: WordHashes) -> tuple[bytes, list[int]]:
    """A digest of the word sequence, and a fingerprint for each view."""
    split = text.lower().split() if text else []
    exact, words = xxhash.xxh128_digest(b" ".join(split)), hashes.of(split)
    if not split:
        return exact, [0] * len(views)
    found: list[int] = [0] * len(views)
    for size in {size for size, _ in views}:
        own = [i for i, (n, _) in enumerate(views) if n == size]
        mixed = _mixed(run_set(words, size), [views[i][1] for i in own])
        ones = np.zeros((len(own), BITS), np.int64)
        for at in range(0, mixed.shape[1], 8192):
            part = np.ascontiguousarray(mixed[:, at : at + 8192])
            ones += np.unpackbits(part.view(np.uint8).reshape(len(own), -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
        for i, fp in zip(own, np.packbits(2 * ones > mixed.shape[1], axis=1, bitorder="little").view("<u8")[:, 0].tolist(), strict=True):
            found[i] = fp
    return exact, found


def shingle_set(text: bytes | None, shingle: int, hashes: WordHashes | None = None) -> np.ndarray:
    """The hashes of the set of shingles, ascending."""
    return run_set((WordHashes() if hashes is None else hashes).of(text.lower().split() if text else []), shingle)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 5, min_similarity: float = 0.8, views=VIEWS, block: int = 4096, members: int = 2000) -> DataFrame:
    """(id_col, component_id) of all documents but the one of each group with the smallest id.

    A group is what links join: equal word sequences, and pairs whose shingle sets have
    the similarity, of all that chains of pairs within the radius in some view reach.
    Ids have to be unique and not null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def view_task(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [_views(t, views, hashes) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            fps = np.array([f for _, f in found], np.uint64).reshape(len(found), len(views)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([e for e, _ in found], pa.binary()), *(pa.array(fps[:, i]) for i in range(len(views)))], ["id", "exact", *names])

    names = [f"view{i}" for i in range(len(views))]
    prints = durable(map_arrow(rows, view_task, f"id {kind}, exact binary, {', '.join(f'{n} long' for n in names)}"))
    firsts = durable(prints.groupBy("exact").agg(F.min("id").alias("id"), *[F.first(n).alias(n) for n in names]))
    copies = prints.select("exact", F.col("id").alias("copy")).join(firsts.select("exact", "id"), "exact").where(F.col("copy") != F.col("id"))

    stacked = firsts.select("id", F.posexplode(F.array(*names)).alias("view", "fp"))
    classes = durable(stacked.groupBy("view", "fp").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")))
    # within a class: a star around its leader; between classes: links of their leaders
    same = stacked.join(classes.where("n > 1"), ["view", "fp"]).where(F.col("id") != F.col("leader")).select(F.col("leader").alias("u"), F.col("id").alias("v"))
    near = links(classes.select("view", "fp"), radius, block)  # a link can come from several tables
    near = near.select(F.col("view").cast("int").alias("view"), F.least("u", "v").alias("fu"), F.greatest("u", "v").alias("fv")).distinct()
    for end in ("u", "v"):
        near = near.join(classes.select("view", F.col("fp").alias(f"f{end}"), F.col("leader").alias(end)), ["view", f"f{end}"])
    # a failed link says nothing about the pairs that it stood for, so what links join is searched as a whole
    groups = durable(components(same.unionByName(near.select("u", "v"))))
    verified = _verified(rows, groups, kind, shingle, min_similarity, members)
    linked = components(verified).select(F.col("node").alias("id"), F.col("root").alias("root"))
    linked = durable(linked)
    # a copy belongs where its first one does
    roots = copies.join(linked, "id", "left").select(F.col("copy").alias("id"), F.coalesce("root", "id").alias("root"))
    return linked.unionByName(roots).select(F.col("id").alias(id_col), F.col("root").alias("component_id"))


def _similar_forest(sets: list[np.ndarray], min_similarity: float) -> list[tuple[int, int]]:
    """Edges that join all sets that are similar enough; at most one less than sets."""
    lengths = np.array([len(s) for s in sets])
    left, stack, edges, indexed = np.arange(len(sets)), [], [], None
    while stack or len(left):
        if not stack:
            stack, left = [int(left[0])], left[1:]
        i = stack.pop()
        if not len(left):
            continue
        if indexed is None or 2 * len(left) < indexed:  # an index of the hashes of what is left, halved with it
            indexed = len(left)
            hashes, owners = np.concatenate([sets[j] for j in left]), np.repeat(left, lengths[left])
            order = np.argsort(hashes)
            hashes, owners = hashes[order], owners[order]
        begin, end = np.searchsorted(hashes, sets[i]), np.searchsorted(hashes, sets[i], "right")
        sizes = end - begin
        places = np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
        shared = np.bincount(owners[places], minlength=len(sets))[left]
        near = shared >= min_similarity * np.maximum(lengths[left] + lengths[i] - shared, 1) - 1e-6
        found = left[near].tolist()
        left = left[~near]
        edges += [(i, j) for j in found]
        stack += found
    return edges


def _verified(rows: DataFrame, groups: DataFrame, kind: str, shingle: int, min_similarity: float, members: int) -> DataFrame:
    """Edges (u, v) that join all pairs of a group (node, root) that are similar enough.

    A group of more than ``members``, or of more than BLOCK_BYTES of shingle sets, is cut
    into blocks, and each two blocks meet in a place of their own.
    """
    def set_task(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t, shingle, hashes).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), pa.array(found, pa.binary())], ["id", "root", "shingles"])

    def forest_task(batches):
        key, ids, sets, type_ = None, [], [], None

        def close():
            edges = _similar_forest(sets, min_similarity)
            return pa.RecordBatch.from_arrays([pa.array([ids[e[end]] for e in edges], type_) for end in (0, 1)], ["u", "v"])

        for batch in batches:
            type_ = batch.column("id").type
            for root, p, q, own, found in zip(*(batch.column(c).to_pylist() for c in ("root", "p", "q", "id", "shingles")), strict=True):
                if (root, p, q) != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, sets = (root, p, q), [], []
                ids.append(own)
                sets.append(np.frombuffer(found, "<u8"))
        if len(ids) > 1:
            yield close()

    whole = groups.select(F.col("node").alias("id"), "root").unionByName(groups.select(F.col("root").alias("id"), "root").distinct())
    sets = durable(map_arrow(rows.join(small_side(durable(whole)), "id"), set_task, f"id {kind}, root {kind}, shingles binary"))
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("int")
    large = sets.groupBy("root").agg(needed.alias("blocks")).where("blocks > 1")
    dealt = sets.join(small_side(durable(large)), "root", "left").withColumn("own", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    dealt = dealt.withColumn("own", F.coalesce("own", F.lit(0))).withColumn("other", F.explode(others))
    dealt = dealt.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "shingles")
    dealt = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "id")
    return map_arrow(dealt, forest_task, f"u {kind}, v {kind}")
