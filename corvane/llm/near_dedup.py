"""Near-duplicate documents by a Chosen Path set similarity join.

Texts that are equal as word sequences are one class.  A class's shingle set is summed up by SIZE minwise
tokens.  Each of TREES trees branches the classes by the value of a chosen token; a node of more than
NODE_LIMIT classes is branched again by further tokens, so many (see children_for) that a pair at the threshold
stays together at any depth: at 0.8, with three children, all 12 trees lose it with probability 2e-7 by calculation
(at the roots alone 4e-9).  A child that keeps so much of its parent that branching saves no comparisons is not
branched on but compared whole.  Nodes are compared exhaustively: first by sketches of the tokens, which pass a pair
at the threshold with probability above 0.99999, then on the full shingle sets.

A near-copy group can be large, so pairs are never emitted: a node gives the star of each of its sketch
components.  The components of these stars are blocks that no link leaves.  The full sets of a block of at most
PART_CLASSES classes meet in one place; a larger block is dealt to parts whose pairs meet in cells.  A block beyond
BLOCK_CLASSES classes or BLOCK_SHINGLES shingles is compared node by node where that ships fewer sets.  A node that
branching does not bring within the limit is dealt to pieces of CHUNK classes, and every pair of pieces meets in a
cell: the work grows with the square of such a node, and no pair of it is left out.

Rows are known by a hash of id and text, so an id may stand on several texts, each of which is compared.

Cases: a null text or one without words has an empty set and is linked with nothing; texts with fewer words
than a shingle are one shingle; a null id gets a null component and is kept; repeated rows share a component, and
one of them is the survivor of a group; of several texts of an id each has the component of its own links; the
smallest id names a component, whatever the order of rows; long texts are read whole; an empty table gives an empty
result; other columns may have any names, as only the named ones are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import bounded_broadcast, stash
from corvane.llm.components import components
from corvane.llm.kernel import U, Words, _power, mix, pieces, tidy, utf8

SHINGLE = 5
SIZE = 64
TREES = 12
NODE_LIMIT = 2048
MAX_LEVEL = 24
#: Probability, over all levels of branching, with which a pair at the threshold may be lost.
LOST = 1e-6
CHUNK = 512
PART_CLASSES = 384
BLOCK_CLASSES = 4096
BY_CELL, BY_NODE = 1, 2
BLOCK_SHINGLES = 4_000_000
#: Rows (ids with 64-byte sketches; ids) up to which, by count, a side is broadcast rather than the texts shuffled.
BROADCAST_SKETCHES = 200_000
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(77)
_ODD = _rng.integers(1, 2**63, SIZE, dtype=np.uint64) * U(2) + U(1)
_XOR = _rng.integers(1, 2**63, SIZE, dtype=np.uint64)
_TREE = _rng.permutation(SIZE)[:TREES]


def _sequence_hash(w: Words, salt: int) -> np.ndarray:
    """Hash of each document's word sequence."""
    out = np.zeros(w.n_docs, np.uint64)
    if len(w.hash):
        power, inverse = _power(len(w.hash) + 1)
        some = np.flatnonzero(w.count)
        start = w.first[some]
        out[some] = np.add.reduceat(mix(w.hash + U(salt)) * power[: len(w.hash)], start) * inverse[start]
    return mix(out + w.count.astype(np.uint64))


def signatures(docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """SIZE minwise tokens of every document with a shingle."""
    out = np.zeros((n, SIZE), np.uint32)
    if len(docs):
        start = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        for k in range(SIZE):
            out[docs[start], k] = np.minimum.reduceat((((hashes ^ _XOR[k]) * _ODD[k]) >> U(32)).astype(np.uint32), start)
    return out


def _binary(rows: np.ndarray, some: np.ndarray | None = None) -> pa.Array:
    return pa.array([r.tobytes() if some is None or s else None for r, s in zip(rows, some if some is not None else rows, strict=True)], pa.binary())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in pieces(offsets, rows=4096):
            w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            docs, hashes = w.shingles(SHINGLE)
            n = np.bincount(docs, minlength=b - a)
            sig = signatures(docs, hashes, b - a)
            ka, kb = _sequence_hash(w, 1), _sequence_hash(w, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ka.view(np.int64)), pa.array(kb.view(np.int64)), _binary(sig, n > 0)],
                names=["id", "doc", "n_shingles", "ka", "kb", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        for a, b in pieces(offsets):
            w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            docs, hashes = w.shingles(SHINGLE)
            at = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=b - a))))
            grams = pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), grams], names=["block", "id", "sketch", "grams"])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _branch_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _matrix(batch.column(1), np.uint32, SIZE)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        nodes = [mix(sig[:, j].astype(np.uint64) * U(2654435769) + U(t + 1)) for t, j in enumerate(_TREE)]
        used = np.repeat(U(1) << _TREE.astype(np.uint64), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.tile(ids, TREES)), pa.array(used.view(np.int64))], names=["node", "id", "used"])


def children_for(similarity: float) -> int:
    """Least number of children a branching (3 at 0.8, 2 at 0.85) with which a pair at the threshold loses little, at any depth."""
    return next((c for c in range(2, 5) if lost(similarity, c, MAX_LEVEL) <= max(LOST, 2 * lost(similarity, c, 1))), 5)


def lost(similarity: float, children: int, levels: int) -> float:
    """Probability that all trees lose a pair whose tokens agree independently, with that many levels of branching."""
    total, draws = 0.0, np.arange(SIZE + 1)
    for k in draws:
        a, out = k / SIZE, 0.0
        for _ in range(levels - 1):
            out = (1 - a + a * out) ** children
        # the roots of the trees take distinct positions, the deeper draws about the same share of agreeing ones
        total += math.comb(SIZE, int(k)) * similarity**k * (1 - similarity) ** (SIZE - k) * (1 - a + a * out) ** TREES
    return float(total)


def _branch(children: int) -> Callable:
    """Rows of the children of nodes: each node draws token positions of its own that its path has not used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sig = _matrix(batch.column(2), np.uint32, SIZE)
            used = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, taken, out, path = np.arange(len(node)), used.copy(), [], []
            for c in range(children):
                draw = mix(node ^ U(0x51ED270B + c))
                j, step = draw % U(SIZE), (draw >> U(8)) | U(1)
                while len(busy := np.flatnonzero((taken >> j) & U(1))):
                    j[busy] = (j[busy] + step[busy] % U(SIZE)) % U(SIZE)
                taken |= U(1) << j
                path.append(used | (U(1) << j))
                out.append(mix(mix(node + j) ^ (sig[rows, j.astype(int)].astype(np.uint64) * U(0x9E3779B1))))
            again = lambda k: pa.concat_arrays([batch.column(k)] * children)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), again(1), again(3), pa.array(np.concatenate(path).view(np.int64))], names=["node", "id", "above", "used"]
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by the first column."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column(0).to_numpy()
        others = np.flatnonzero(key != key[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield t.slice(0, cut)
            held, count = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric boolean matrix with a true diagonal."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _star_edges(pass_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            key = t.column(0).to_numpy()
            ids = t.column(1).to_numpy()
            sketch = _matrix(t.column(2), np.uint8, SIZE)
            at = _bounds(key)
            size = np.diff(at)
            a, b = [], []
            two = at[:-1][size == 2]
            if len(two):
                ok = (sketch[two] == sketch[two + 1]).sum(1) >= pass_at
                a.append(np.maximum(ids[two], ids[two + 1])[ok])
                b.append(np.minimum(ids[two], ids[two + 1])[ok])
            for s, n in zip(at[:-1][size > 2], size[size > 2], strict=True):
                order = np.argsort(ids[s : s + n], kind="stable")
                who, k = ids[s : s + n][order], np.ascontiguousarray(sketch[s : s + n][order].T)
                same = np.zeros((n, n), np.uint8)
                for c in k:
                    same += c[:, None] == c[None, :]
                label = _labels(same >= pass_at)
                moved = label != np.arange(n)
                a.append(who[moved])
                b.append(who[label[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return run


def _exact_star(percent: int, pass_at: int) -> Callable:
    """Stars of the components of links confirmed on full sets, within each group."""

    def group(ids: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, number = np.unique(flat, return_inverse=True)
        at = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(number.max() + 1, bool)
        label = np.arange(n)
        for i in range(n - 1):
            j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            if n > 2:
                j = j[(sketch[j] == sketch[i]).sum(1) >= pass_at]
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            if not len(j):
                continue
            mine = number[at[i] : at[i + 1]]
            mark[mine] = True
            step = max(1, 2_000_000 // max(1, int(size[j].max())))
            for p in range(0, len(j), step):
                part = j[p : p + step]
                rows = np.concatenate([number[at[x] : at[x + 1]] for x in part])
                inter = np.add.reduceat(mark[rows].astype(np.int64), np.concatenate(([0], np.cumsum(size[part])[:-1])))
                for x in part[100 * inter >= percent * (size[part] + size[i] - inter)]:
                    if label[x] != label[i]:
                        low, high = sorted((label[x], label[i]))
                        label[label == high] = low
            mark[mine] = False
        moved = label != np.arange(n)
        return ids[moved], ids[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 2_000):
            key, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            sketch = _matrix(t.column(2), np.uint8, SIZE)
            sets = t.column(3)
            at = _bounds(key)
            a, b = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s < 2:
                    continue
                order = np.argsort(ids[s:e], kind="stable")
                mine = [np.frombuffer(sets[int(s + o)].as_py(), np.uint64) for o in order]
                x, y = group(ids[s:e][order], mine, sketch[s:e][order])
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = _matrix(batch.column(1), np.uint32, SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary((sig >> np.uint32(3)).astype(np.uint8))], names=["id", "sketch"])


def _gathered(rows: DataFrame, key: str, parts: int) -> DataFrame:
    return rows.repartition(parts, key).sortWithinPartitions(key)


def _dealt(large: DataFrame) -> DataFrame:
    """(node, id) of cells in which every pair of a node's classes meets: node, id, n -> pieces of CHUNK, two by two."""
    pieces = F.ceil(F.col("n") / CHUNK)
    d = large.select("node", "id", F.pmod(F.xxhash64("id"), pieces).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("other"))
    return d.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id")


def _row_key(docs: DataFrame, id_column: str, text: str) -> Column:
    return F.xxhash64(docs[id_column], docs[text])


def near_duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id column, n_shingles, component_id and kept of every row; linked from percent / 100 on."""
    rows = _grouped(docs, percent, id_column, text)
    kept = F.coalesce(F.col("doc") == F.col("first.doc"), F.lit(True))
    return rows.select(F.col("doc").alias(id_column), "n_shingles", F.col("first.doc").alias("component_id"), kept.alias("kept"))


def _grouped(docs: DataFrame, percent: int, id_column: str, text: str) -> DataFrame:
    """Rows (id, a hash of the row; doc, its id; n_shingles; first, the (doc, id) that names its component)."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    similarity = percent / 100
    # a pair at the threshold agrees in SIZE * similarity tokens; 4.5 deviations below, and none above that
    pass_at = int(SIZE * similarity - 4.5 * np.sqrt(SIZE * similarity * (1 - similarity)))
    texts = docs.select(_row_key(docs, id_column, text).alias("id"), docs[id_column].alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    signed = stash(texts.mapInArrow(tidy(_sign), f"id long, doc {docs.schema[id_column].dataType.simpleString()}, n_shingles long, ka long, kb long, sig binary"), "signatures")
    # a class's texts are fetched by its row: those of a null id never stand for one
    texts = texts.filter("doc is not null").select("id", "text")
    some = signed.filter("doc is not null and sig is not null").drop("doc")
    # written, so that the joins below can split a class of very many copies
    least = stash(some.groupBy("ka", "kb").agg(F.min("id").alias("class")), "class-ids")
    classes = some.join(least.withColumnRenamed("class", "id"), ["ka", "kb", "id"], "left_semi").select("id", "n_shingles", "sig").dropDuplicates(["id"])
    classes = stash(classes, "classes")

    def counted(rows: DataFrame, tag: str) -> DataFrame:
        rows = stash(rows, f"{tag}-rows")
        n = stash(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), f"{tag}-sizes")
        return stash(rows.join(n, "node"), tag)

    rows = counted(classes.select("id", "sig").mapInArrow(tidy(_branch_root), "node long, id long, used long"), "nodes-1")
    small = rows.filter(F.col("n") <= NODE_LIMIT).select("node", "id")
    level, children = 1, children_for(similarity)
    large = rows.filter(F.col("n") > NODE_LIMIT)
    while level < min(MAX_LEVEL, SIZE - children) and large.limit(1).count():
        level += 1
        branched = large.select("node", "id", F.col("n").alias("above"), "used").join(classes.select("id", "sig"), "id").select("node", "id", "sig", "above", "used")
        rows = counted(branched.mapInArrow(tidy(_branch(children)), "node long, id long, above long, used long"), f"nodes-{level}")
        small = small.unionByName(rows.filter(F.col("n") <= NODE_LIMIT).select("node", "id"))
        # where children hold no fewer pairs than their parent, branching on would only repeat these
        stuck = F.col("n") > children**-0.5 * F.col("above")
        small = small.unionByName(_dealt(rows.filter((F.col("n") > NODE_LIMIT) & stuck)))
        large = rows.filter((F.col("n") > NODE_LIMIT) & ~stuck)
    if large.limit(1).count():
        small = small.unionByName(_dealt(large))

    sketches = classes.select("id", "sig").mapInArrow(tidy(_sketch), "id long, sketch binary")
    compared = _gathered(small.join(sketches, "id").select("node", "id", "sketch"), "node", parts)
    stars = compared.mapInArrow(tidy(_star_edges(pass_at)), "a long, b long")
    blocks = stash(components(stars).select("id", F.col("component").alias("block")), "blocks")
    sizes = blocks.join(classes.select("id", "n_shingles"), "id").groupBy("block").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    sizes = stash(sizes.withColumn("parts", F.greatest(F.ceil(F.col("n") / PART_CLASSES), F.ceil(F.col("m") / BLOCK_SHINGLES))), "block-sizes")
    huge = sizes.filter((F.col("n") > BLOCK_CLASSES) | (F.col("m") > BLOCK_SHINGLES)).select("block")
    # cells hold every pair of a block; nodes are taken where they ship fewer sets than that
    by_node = small.join(blocks.join(huge, "block", "left_semi"), "id").groupBy("block").agg(F.count("*").alias("node_rows"))
    sizes = sizes.join(by_node, "block", "left")
    kind = F.when(F.col("node_rows") < F.col("n") * F.col("parts"), BY_NODE).when((F.col("parts") > 1) | F.col("node_rows").isNotNull(), BY_CELL)
    sizes = stash(sizes.withColumn("kind", kind).filter("kind is not null"), "large-blocks")
    kinds = {r.kind for r in sizes.select("kind").distinct().collect()}  # at most two rows
    sketched = blocks.join(sketches, "id").join(sizes.select("block", "kind"), "block", "left")
    sketched = stash(sketched, "sketched")
    # full sets, once for every class that has a possible partner
    full = "block long, id long, sketch binary, grams binary"
    verify = tidy(_exact_star(percent, pass_at))
    links = None

    def sets_of(which: DataFrame, block: Column) -> DataFrame:
        side = bounded_broadcast(which, BROADCAST_SKETCHES)
        return texts.join(side, "id").select(block.alias("block"), "id", "sketch", "text").mapInArrow(tidy(_sets), full)

    def added(stars: DataFrame) -> None:
        nonlocal links
        links = stars if links is None else links.unionByName(stars)

    def whole(stars: DataFrame) -> DataFrame:
        return components(stars).filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))

    added(_gathered(sets_of(sketched.filter("kind is null"), F.col("block")), "block", parts).mapInArrow(verify, "a long, b long"))
    if BY_CELL in kinds:
        # a block's classes are dealt to parts; every pair of parts meets in a cell of its own
        cells = sets_of(sketched.filter(F.col("kind") == BY_CELL), F.col("block"))
        n = sizes.select("block", "parts")
        own = F.pmod(F.xxhash64("id"), F.col("parts"))
        cells = cells.join(n, "block").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cell = F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other"))
        cells = _gathered(cells.select(cell.alias("block"), "id", "sketch", "grams"), "block", 4 * parts)
        added(whole(cells.mapInArrow(verify, "a long, b long")))
    if BY_NODE in kinds:
        of_big = sets_of(sketched.filter(F.col("kind") == BY_NODE), F.col("block")).drop("block")
        by_node = _gathered(small.join(of_big, "id").select("node", "id", "sketch", "grams"), "node", 8 * parts)
        added(whole(by_node.mapInArrow(verify, "a long, b long")))
    found = stash(links.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("component")), "components")
    # class of each row, then its component, named by its least id
    rows = signed.drop("sig").join(least, ["ka", "kb"], "left")
    rows = rows.withColumn("class", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("class", "id")))
    rows = rows.join(found, "class", "left")
    rows = rows.select("id", "doc", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("component", "class")).alias("component"))
    rows = stash(rows, "components-of-rows")
    # a row alone names its component itself
    several = rows.filter("doc is not null").groupBy("component").agg(F.min(F.struct("doc", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(bounded_broadcast(stash(several, "component-names"), BROADCAST_SKETCHES), "component", "left")
    return rows.select("id", "doc", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("first", F.struct("doc", "id"))).alias("first"))


def deduplicated(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one document of each group, the one of least id; of its repeated rows, one; rows of null ids stay."""
    said = stash(_grouped(docs, percent, id_column, text).filter("doc is not null"), "near-duplicates")
    drop = bounded_broadcast(said.filter("id != first.id").select(F.col("id").alias("__drop")).distinct(), BROADCAST_IDS)
    key = _row_key(docs, id_column, text)
    kept = docs.join(drop, (key == drop["__drop"]) & docs[id_column].isNotNull(), "left_anti")
    if said.filter("id = first.id").groupBy("id").count().filter("count > 1").limit(1).count():
        named = kept.filter(kept[id_column].isNotNull())
        once = named.select(F.xxhash64(named[id_column], named[text]).alias("__key"), F.struct(*[named[c] for c in docs.columns]).alias("__row")).dropDuplicates(["__key"]).select("__row.*")
        kept = once.unionByName(kept.filter(kept[id_column].isNull()))
    return kept
