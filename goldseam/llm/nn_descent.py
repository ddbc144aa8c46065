"""Near-duplicate embeddings by NN-descent: a neighbour graph, refined through neighbours of neighbours.

Search. Vectors of one label are compared by cosine. The graph starts with the best neighbours inside short
windows of several orders (by signs and places of random projections), so a crowd of copies is cut into
windows like anything else. A round then gathers, for every vector, the neighbours that it has or that have it,
compares them with each other, and keeps the best of each. Rounds go on while they find new links.

Saturation. A list that is full of links may not hold all of them. Every link of a vector lies in its connected
component, so a saturated list is enlarged to the whole component: its vectors are laid into blocks,
and blocks that can hold a link (by the angle between their centres and their radii) are multiplied. They
give numbers of links, not rows of pairs.

Audit. A stated number of vectors, drawn by hash, is compared with all vectors, and the links found are set
against theirs. If too many are missing, further orders and longer lists follow, and rounds again. If
that was done WAVES times and does not suffice, each label is taken for one component and compared in blocks.

Links are decided by cosines in double precision; the search uses single precision and a margin.
Exact copies are one vector with a number of copies throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.llm.common import staged
from goldseam.llm.components import components

THRESHOLD = 0.93
#: Neighbours per list at first, orders per wave, and rows of a window.
NEIGHBOURS, ORDERS, WINDOW = 10, 8, 64
#: Rounds of a wave end when one adds less than this part of the links, or after so many.
GROWTH, ROUNDS = 0.001, 8
#: Vectors that are audited, the part of their links that has to be found, and waves before blocks.
AUDITED, RECALL, WAVES = 2048, 0.99, 4
#: Single precision decides nothing this close to the threshold.
MARGIN = 1e-3
BITS, SEED = 40, 93
#: Bytes of vectors in a block.
BLOCK_BYTES = 1 << 19

_FLOATS = "array<float>"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _edges(one: list, two: list, sims: list) -> pa.RecordBatch:
    arrays = [
        pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind))
        for parts, kind in ((one, np.int64), (two, np.int64), (sims, np.float32))
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["node", "other", "sim"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best edges of every node; Spark cuts the lists before it shuffles them."""
    once = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _ordered(nodes: DataFrame, size: int, numbers: list[int], *first: str) -> DataFrame:
    """``nodes`` once for each order, with the columns t, code and at, dealt and sorted by it."""
    own_types = [("t", T.IntegerType()), ("code", T.LongType()), ("at", T.DoubleType())]
    schema = T.StructType([*nodes.schema.fields, *[T.StructField(n, t) for n, t in own_types]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("unit"), size)
            for t in numbers:
                planes = np.random.default_rng([SEED, t]).standard_normal((size, BITS + 1)).astype(x.dtype)
                places = x @ planes
                code = (places[:, :BITS] > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1))
                own = [
                    pa.array(np.full(len(x), t, np.int32)),
                    pa.array(code.astype(np.int64)),
                    pa.array(places[:, BITS].astype(np.float64)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *own], names=[*batch.schema.names, "t", "code", "at"]
                )

    by = ["t", *first, "code", "at"]
    return nodes.mapInArrow(run, schema).repartitionByRange(*by).sortWithinPartitions(*by)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows that agree in all columns."""
    length = len(columns[0])
    if not length:
        return []
    change = np.zeros(length - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), length]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _window_edges(nodes: DataFrame, size: int, orders: list[int], k: int) -> DataFrame:
    """The best neighbours of every node in its window of each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, node = _matrix(batch.column("unit"), size), _numbers(batch.column("node"))
            one, two, sims = [], [], []
            for start, end in _runs(_numbers(batch.column("t")), _numbers(batch.column("grp"))):
                for at in range(start, end, WINDOW):
                    part = slice(at, min(at + WINDOW, end))
                    here, count = node[part], min(k, part.stop - at - 1)
                    if count < 1:
                        continue
                    cosine = x[part] @ x[part].T
                    np.fill_diagonal(cosine, -np.inf)
                    best = np.argpartition(-cosine, count - 1, axis=1)[:, :count]
                    one.append(np.repeat(here, count))
                    two.append(here[best].ravel())
                    sims.append(np.take_along_axis(cosine, best, 1).ravel())
            yield _edges(one, two, sims)

    search = nodes.select("node", "grp", F.col("unit").cast(_FLOATS).alias("unit"))
    return _ordered(search, size, orders, "grp").mapInArrow(run, "node long, other long, sim float")


def _round(graph: DataFrame, nodes: DataFrame, size: int, k: int) -> DataFrame:
    """Edges between neighbours of one node that are better than the last of a list."""
    ends = graph.select(F.col("node").alias("centre"), F.col("other").alias("member"), "sim", "fresh")
    back = graph.select(F.col("other").alias("centre"), F.col("node").alias("member"), "sim", "fresh")
    met = ends.union(back).groupBy("centre", "member").agg(
        F.max("sim").alias("sim"), F.max("fresh").alias("fresh")
    )
    order = Window.partitionBy("centre").orderBy(F.desc("sim"), "member")
    met = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * k)
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    known = nodes.join(worst, "node").select(
        F.col("node").alias("member"), "worst", F.col("unit").cast(_FLOATS).alias("unit")
    )
    gathered = (
        met.select("centre", "member", "fresh")
        .join(known, "member")
        .groupBy("centre")
        .agg(F.collect_list(F.struct("member", "fresh", "worst", "unit")).alias("m"))
        .where((F.size("m") > 1) & F.exists("m", lambda m: m["fresh"] == 1))
        .select(*[F.col(f"m.{c}").alias(c) for c in ("member", "fresh", "worst")], F.flatten("m.unit").alias("unit"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, sims = [], [], []
            columns = [batch.column(c) for c in ("member", "fresh", "worst", "unit")]
            for i in range(batch.num_rows):
                member, fresh, worst, unit = (_numbers(c[i].values) for c in columns)
                x = unit.reshape(-1, size)
                cosine = x @ x.T
                better = (cosine > worst[:, None]) & ((fresh[:, None] | fresh[None, :]) == 1)
                np.fill_diagonal(better, False)
                a, b = np.nonzero(better)
                one.append(member[a])
                two.append(member[b])
                sims.append(cosine[a, b])
            yield _edges(one, two, sims)

    return gathered.mapInArrow(run, "node long, other long, sim float")


def _refined(
    graph: DataFrame | None, nodes: DataFrame, size: int, orders: list[int], k: int, threshold: float
) -> DataFrame:
    """One wave: edges of new windows, then rounds while they add links."""
    seen = _window_edges(nodes, size, orders, k).withColumn("fresh", F.lit(1))
    graph = staged(_best(seen if graph is None else seen.union(graph), k), "neighbours")

    def links() -> int:
        return graph.where(F.col("sim") >= threshold - MARGIN).count()

    before = links()
    for _ in range(ROUNDS):
        found = _round(graph, nodes, size, k).withColumn("fresh", F.lit(1))
        graph = staged(_best(found.union(graph.withColumn("fresh", F.lit(0))), k), "neighbours")
        now = links()
        if now - before <= GROWTH * now:
            break
        before = now
    return graph


def _verified(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the edges of ``graph`` that are links by cosines in double precision."""
    close = graph.where(F.col("sim") >= threshold - MARGIN)
    pairs = close.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    one = nodes.select(F.col("node").alias("a"), F.col("unit").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    product = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)
    return pairs.join(one, "a").join(two, "b").where(product >= threshold).select("a", "b")


_BLOCK = "block long, root long, nodes array<long>, copies array<long>, x array<double>, centre array<double>, radius double"


def _blocks(dense: DataFrame, size: int) -> DataFrame:
    """``dense`` (node, root, copies, unit) as blocks of near vectors of one root, with a cap around each."""
    most = max(16, BLOCK_BYTES // (8 * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, root = _matrix(batch.column("unit"), size), _numbers(batch.column("root"))
            node, copies = _numbers(batch.column("node")), _numbers(batch.column("copies"))
            for start, end in _runs(root):
                for at in range(start, end, most):
                    part = slice(at, min(at + most, end))
                    centre = x[part].sum(0)
                    length = np.linalg.norm(centre)
                    # without a direction the cap is the whole sphere
                    centre = centre / length if length > 1e-9 else np.eye(size)[0]
                    cosine = np.clip((x[part] @ centre).min(), -1, 1)
                    radius = float(np.arccos(cosine)) if length > 1e-9 else np.pi
                    lists = [(node[part], pa.int64()), (copies[part], pa.int64())]
                    lists += [(x[part].ravel(), pa.float64()), (centre, pa.float64())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([node[at]], pa.int64()),
                            pa.array([root[at]], pa.int64()),
                            *[pa.array([values], pa.list_(kind)) for values, kind in lists],
                            pa.array([radius]),
                        ],
                        names=["block", "root", "nodes", "copies", "x", "centre", "radius"],
                    )

    rows = dense.select("node", "root", "copies", "unit")
    # the order's root comes first, so that a block's rows are neighbours in it
    return staged(_ordered(rows, size, [0], "root").mapInArrow(run, _BLOCK), "neighbour-blocks")


def _block_counts(dense: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, n): links of every vector of ``dense`` inside its root, copies counted, itself not."""
    blocks = _blocks(dense, size)
    caps = blocks.select("block", "root", "centre", "radius")
    one, two = caps.alias("one"), caps.alias("two")
    product = F.aggregate(
        F.zip_with("one.centre", "two.centre", lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p
    )
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product)))
    reach = F.col("one.radius") + F.col("two.radius") + float(np.arccos(threshold)) + 1e-6
    pairs = (
        one.join(two, F.col("one.root") == F.col("two.root"))
        .where((F.col("one.block") <= F.col("two.block")) & (apart <= reach))
        .select(F.col("one.block").alias("a"), F.col("two.block").alias("b"))
    )

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("block").alias(name), F.struct("nodes", "copies", "x").alias(f"of_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (n1, c1, x1), (n2, c2, x2) = (
                    [_numbers(batch.column(s).field(f)[i].values) for f in ("nodes", "copies", "x")]
                    for s in ("of_a", "of_b")
                )
                linked = x1.reshape(-1, size) @ x2.reshape(-1, size).T >= threshold
                same = n1[0] == n2[0]
                if same:
                    np.fill_diagonal(linked, False)
                counted = [(n1, linked @ c2)] if same else [(n1, linked @ c2), (n2, c1 @ linked)]
                for nodes, n in counted:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n)], names=["node", "n"])

    counts = pairs.join(side("a"), "a").join(side("b"), "b").select("of_a", "of_b")
    counts = counts.mapInArrow(run, "node long, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n"))


def _counted(graph: DataFrame, nodes: DataFrame, size: int, k: int, threshold: float) -> DataFrame:
    """(node, root, n) of every node with links, saturated lists enlarged to their component."""
    links = staged(_verified(graph, nodes, threshold), "neighbour-links")
    roots = staged(components(links, "neighbour-components"), "neighbour-roots")
    full = graph.groupBy("node").agg(F.count("*").alias("c"), F.min("sim").alias("last"))
    full = full.where((F.col("c") >= k) & (F.col("last") >= threshold - MARGIN)).select("node")
    dense = staged(roots.join(full, "node", "left_semi").select("root").distinct(), "neighbour-dense")
    inside = roots.join(dense, "root", "left_semi").join(nodes, "node")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    copies = nodes.select(F.col("node").alias("other"), "copies")
    thin = ends.join(roots.join(dense, "root", "left_anti"), "node", "left_semi").join(copies, "other")
    counts = thin.groupBy("node").agg(F.sum("copies").alias("n"))
    if not dense.isEmpty():
        counts = counts.union(_block_counts(inside, size, threshold))
    return staged(roots.join(counts, "node").select("node", "root", "n"), "neighbour-counts")


def _exactly(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, root, n) with every label taken for one component; only for what no search settles."""
    first = nodes.groupBy("grp").agg(F.min("node").alias("label_root"))
    whole = staged(nodes.join(first, "grp").withColumnRenamed("label_root", "root"), "neighbour-labels")
    counts = _block_counts(whole, size, threshold).where("n > 0")
    # links that connect: within a block and between blocks each vector names its first partner
    linked = staged(_block_links(whole, size, threshold), "neighbour-links")
    roots = components(linked, "neighbour-components")
    return staged(roots.join(counts, "node").select("node", "root", "n"), "neighbour-counts")


def _block_links(whole: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b): for every vector and block its first partner, after joining partners of one vector in a chain.

    Enough to connect whatever is linked: the partners that a vector has in one block are chained, so a
    vector of n partners in a block gives n links at most, and blocks no rows of all pairs for dense groups.
    """
    blocks = _blocks(whole, size)
    a = blocks.select(F.col("block").alias("a"), "root", F.struct("nodes", "x").alias("of_a"))
    b = blocks.select(F.col("block").alias("b"), "root", F.struct("nodes", "x").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (n1, x1), (n2, x2) = (
                    [_numbers(batch.column(s).field(f)[i].values) for f in ("nodes", "x")] for s in ("of_a", "of_b")
                )
                linked = x1.reshape(-1, size) @ x2.reshape(-1, size).T >= threshold
                one, two = _spanning(linked)
                yield pa.RecordBatch.from_arrays([pa.array(n1[one]), pa.array(n2[two])], names=["a", "b"])

    both = a.join(b, "root").where("a <= b").select("of_a", "of_b")
    return both.mapInArrow(run, "a long, b long").where("a != b")


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of links (row, column) that connect all rows and columns which ``linked`` connects."""
    rows, columns = linked.shape
    row_open, column_open = linked.any(1), np.ones(columns, bool)
    one, two = [], []
    while row_open.any():
        start = int(row_open.argmax())
        frontier, row_open[start] = [start], False
        while frontier:
            row = frontier.pop()
            reached = np.flatnonzero(linked[row] & column_open)
            column_open[reached] = False
            one.append(np.full(len(reached), row))
            two.append(reached)
            for column in reached:
                rows_now = np.flatnonzero(linked[:, column] & row_open)
                row_open[rows_now] = False
                one.append(rows_now)
                two.append(np.full(len(rows_now), column))
                frontier.extend(rows_now.tolist())
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *one]).astype(np.int64), np.concatenate([empty, *two]).astype(np.int64)


def _audited(counts: DataFrame, nodes: DataFrame, size: int, threshold: float) -> float | None:
    """Mean part of the links found of AUDITED vectors that have links; null if none has any."""
    drawn = nodes.orderBy("k1", "k2").limit(AUDITED).select("node", "grp", "unit").collect()
    own, groups = np.array([r.node for r in drawn]), np.array([r.grp for r in drawn], object)
    x = np.array([r.unit for r in drawn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                y, node = _matrix(batch.column("unit"), size), _numbers(batch.column("node"))
                linked = x @ y.T >= threshold
                linked &= groups[:, None] == _numbers(batch.column("grp"))[None, :]
                linked &= own[:, None] != node[None, :]
                n = linked @ _numbers(batch.column("copies"))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(n[some])], names=["node", "m"])

    true = nodes.select("node", "grp", "copies", "unit").mapInArrow(run, "node long, m long")
    true = true.groupBy("node").agg(F.sum("m").alias("m"))
    found = true.join(counts, "node", "left").select(F.coalesce("n", F.lit(0)) / F.col("m"))
    return found.agg(F.avg(found.columns[0])).first()[0]


def _linked_nodes(nodes: DataFrame, size: int, threshold: float) -> tuple[DataFrame, float | None]:
    """(node, root, n) of the linked nodes of one length, and the audited recall."""
    graph = None
    for wave in range(WAVES):
        k = NEIGHBOURS << wave
        orders = list(range(1 + wave * ORDERS, 1 + (wave + 1) * ORDERS))
        graph = _refined(graph, nodes, size, orders, k, threshold)
        counts = _counted(graph, nodes, size, k, threshold)
        recall = _audited(counts, nodes, size, threshold)
        if recall is None or recall >= RECALL:
            return counts, recall
    return _exactly(nodes, size, threshold), 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for every row of ``vectors``.

    ``vectors`` has vec_id, embedding and label; other columns are not read. Rows of one label (null labels:
    none) whose cosine is ``threshold`` or more are linked. n_links counts the other rows that a row is
    linked to; component_id is the smallest vec_id reached by links; rows with that vec_id are kept. A row
    whose vector is null, empty, zero or holds null or non-finite entries is alone. So are vectors of
    different lengths to each other. Copies and repeated rows are linked like any others. A null vec_id
    counts for component_id only where a component has no other; then its rows are kept. audited_recall is
    the part of the links found for the audited vectors of that length (null: they have none, or the row is
    alone). An empty table gives an empty table.
    """
    entry = F.col("embedding")
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = F.col("label").isNotNull() & entry.isNotNull() & ~bad & F.exists(entry, lambda c: c != 0)
    # adding zero makes one of the two zeros
    v = F.when(good, F.transform(entry, lambda c: c.cast("double") + F.lit(0.0)))
    grp = F.col("label").cast("string")
    rows = staged(
        vectors.select("vec_id", grp.alias("grp"), v.alias("v"))
        .withColumn("k1", F.when(F.col("v").isNotNull(), F.xxhash64("grp", "v")))
        .withColumn("k2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("2"), "v", "grp"))),
        "neighbour-rows",
    )
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    scaled = F.transform("v", lambda c: c / F.col("largest"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    nodes = staged(
        rows.where(F.col("v").isNotNull())
        .groupBy("k1", "k2")
        .agg(F.first("grp").alias("grp"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("largest", largest)
        .withColumn("v", scaled)
        .withColumn("norm", norm)
        .select(
            F.monotonically_increasing_id().alias("node"), "k1", "k2", "grp", "copies", "least",
            F.transform("v", lambda c: c / F.col("norm")).alias("unit"),
        ),
        "neighbour-nodes",
    )
    sizes = [r[0] for r in nodes.select(F.size("unit")).distinct().collect()]
    linked = None
    for size in sizes:
        same = nodes.where(F.size("unit") == size)
        counts, recall = _linked_nodes(same, size, threshold)
        counts = counts.withColumn("audited_recall", F.lit(recall).cast("double"))
        linked = counts if linked is None else linked.union(counts)
    if linked is None:
        alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
        return rows.select("vec_id", *alone, F.lit(True).alias("kept"), F.lit(None).cast("double").alias("audited_recall"))
    placed = nodes.drop("unit").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select(
        "k1", "k2", "component_id", "audited_recall",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("is_node"),
    )
    component = F.when(F.col("is_node"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.drop("v").join(placed, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
        "audited_recall",
    )
