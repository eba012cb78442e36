"""Near-duplicate embeddings by product quantisation, linked by exact cosine.

Vectors are scaled to length 1, so a cosine of at least c means a distance of
at most sqrt(2 - 2 c). Coarse centroids split them into inverted lists; what is
left after the centroid is coded by one of a few codewords in each subspace.

A query probes every list that can hold a partner: y lies nearer to its
own centroid c than to the query's c*, so |x - y| >= (d(x, c)^2 - d(x, c*)^2) / (2 |c - c*|)
for a query x, and lists beyond that are left out. Within a list, distances from
the query to coded vectors are sums of table entries, and a code is passed over
only if that distance exceeds the limit by more than the vector's own coding
error. Both tests are bounds, so every pair reaches the exact comparison in
double precision and recall is 1; the quantisers decide the work, not the result.

Lists are cut into blocks of bounded size, and queries meet a list block by
block, so a list that holds a third of all vectors is many tasks. Two blocks meet
once: partners probe each other's lists, so the smaller block asks and the task
counts for both. A task tells of each vector how many partners it found, and links
that keep the pairs of its blocks connected; pairs are never written out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallygrad.llm.components import connected_components
from tallygrad.llm.draws import drawn, drawn_order, not_empty
from tallygrad.llm.store import kept

LEAST_COSINE = 0.98
#: Vectors that quantisers may be fitted on; subspaces, codewords of each, and rounds of k-means.
SAMPLE_ROWS, SUBSPACES, CODEWORDS, ROUNDS = 4096, 8, 16, 8
#: Fewest and most lists; between them they grow with the square root of the vectors of a label, this many a list at 1.
LISTS, LIST_STEP = (2, 512), 12
#: Vectors of one block of a list.
BLOCK_ROWS = 2048
#: Slack for rounding in the bounds, far above the rounding of double precision.
SLACK = 1e-6


@dataclass
class Quantiser:
    centroids: np.ndarray  # list x dimension
    codewords: np.ndarray  # subspace x codeword x width

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.centroids).argmin(axis=1)

    def probes(self, x: np.ndarray, limit: float) -> np.ndarray:
        """Which lists (row x list) can hold a vector within ``limit`` of each row."""
        d = _distances(x, self.centroids)
        own = d.argmin(axis=1)
        apart = np.sqrt(np.maximum(_distances(self.centroids, self.centroids), 0))[own]
        return d - d[np.arange(len(x)), own][:, None] <= 2 * limit * apart + SLACK

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, coding error) of vectors in their lists."""
        rest = x - self.centroids[lists]
        codes = np.empty((len(x), len(self.codewords)), np.uint8)
        error = np.zeros(len(x))
        width = self.codewords.shape[2]
        for s, words in enumerate(self.codewords):
            d = _distances(rest[:, s * width : (s + 1) * width], words)
            codes[:, s] = d.argmin(axis=1)
            error += np.maximum(d.min(axis=1), 0)
        return codes, np.sqrt(error)

    def table_distances(self, x: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Distances (row x code) from vectors to the coded vectors of a list, by table look-up."""
        rest = x - self.centroids[list_id]
        width = self.codewords.shape[2]
        total = np.zeros((len(x), len(codes)))
        for s, words in enumerate(self.codewords):
            table = np.maximum(_distances(rest[:, s * width : (s + 1) * width], words), 0)
            total += table[:, codes[:, s]]
        return np.sqrt(total)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * (x @ y.T)


def _means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k-means; fewer distinct rows than k give repeated centroids, which do no harm."""
    centroids = x[random.choice(len(x), k, replace=len(x) < k)]
    for _ in range(ROUNDS):
        own = _distances(x, centroids).argmin(axis=1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def lists_for(vectors: int) -> int:
    """Lists for a label of so many vectors."""
    return min(LISTS[1], max(LISTS[0], round(vectors**0.5 / LIST_STEP)))


def train(x: np.ndarray, lists: int = 32, seed: int = 5) -> Quantiser:
    """Fit both quantisers to unit vectors; the dimension is split as evenly as it divides."""
    random = np.random.default_rng(seed)
    subspaces = next(s for s in range(min(SUBSPACES, x.shape[1]), 0, -1) if x.shape[1] % s == 0)
    centroids = _means(x, lists, random)
    rest = x - centroids[_distances(x, centroids).argmin(axis=1)]
    width = x.shape[1] // subspaces
    codewords = np.stack([_means(rest[:, s * width : (s + 1) * width], CODEWORDS, random) for s in range(subspaces)])
    return Quantiser(centroids, codewords)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): vectors that can link, in double precision and scaled to length 1.

    Without: null or empty vectors, null labels or ids, null or non-finite components, zero vectors.
    """
    values = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    largest = F.array_max(F.transform("values", F.abs))
    return (
        vectors.select("vec_id", "label", values.alias("values"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("values") > 0) & finite)
        .withColumn("largest", largest)
        .where(F.col("largest") > 0)
        .withColumn("values", F.transform("values", lambda v: v / F.col("largest")))
        .withColumn("norm", F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)))
        .select("vec_id", "label", F.transform("values", lambda v: v / F.col("norm")).alias("unit"))
    )


def _local_links(ids_a: np.ndarray, ids_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of links for the pairs (ids_a[a], ids_b[b]): (id, smallest id of its part)."""
    nodes, index = np.unique(np.concatenate((ids_a[a], ids_b[b])), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        np.minimum.at(least, u, least[v])
        np.minimum.at(least, v, least[u])
        least = least[least]
        if np.array_equal(before, least):
            break
    return [(int(nodes[i]), int(nodes[least[i]])) for i in np.flatnonzero(least != np.arange(len(nodes)))]


def near_duplicates(vectors: DataFrame, least_cosine: float = LEAST_COSINE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine in
    double precision is at least ``least_cosine``. Vectors that are null, empty,
    zero, of another dimension than their partner, or hold null or non-finite components link with nothing:
    no links, their own id as component. Rows with one vec_id count as vectors
    of their own that share a component. A null vec_id links nothing and keeps a null component.
    """
    limit = float(np.sqrt(2 - 2 * least_cosine)) + SLACK
    units = kept(usable_vectors(vectors).withColumn("size", F.size("unit")), "unit-vectors")
    models = {}
    per_label = units.groupBy("size", "label").agg(F.count("*").alias("n"))
    sizes = per_label.groupBy("size").agg(F.sum("n").alias("there"), F.max("n").alias("most")).collect()  # dimensions that occur
    for size, there, most in sizes:
        one = units.where(F.col("size") == size)
        sample = one.where(drawn(there, sample_rows, "vec_id")).orderBy(drawn_order("vec_id"), "vec_id").limit(sample_rows)
        rows = not_empty(sample.select("vec_id", "unit").collect(), there, "vectors")
        models[size] = train(np.array([r.unit for r in sorted(rows, key=lambda r: (r.vec_id, r.unit))]), lists_for(most))
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # centroids and codewords

    def assigned(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            out_list = np.zeros(len(size), np.int32)
            probes: list[list[int]] = [[]] * len(size)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                x = _matrix(batch.column("unit").take(pa.array(rows)))
                q = shared.value[int(s)]
                out_list[rows] = q.lists(x)
                for r, wanted in zip(rows.tolist(), q.probes(x, limit)):
                    probes[r] = np.flatnonzero(wanted).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out_list), pa.array(probes, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "list", "probes"],
            )

    schema = "vec_id bigint, label string, unit array<double>, size int, list int, probes array<int>"
    plain = units.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), "unit", "size")
    lists = plain.mapInArrow(assigned, schema)
    lists = kept(lists, "inverted-lists")
    per_list = lists.groupBy("label", "size", "list").agg(F.count("*").alias("rows"))
    per_list = per_list.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).drop("rows")
    place = F.broadcast(per_list)  # at most lists x labels x dimensions rows of a few numbers
    stored = lists.join(place, ["label", "size", "list"]).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    asking = (
        stored.select("label", "size", "vec_id", "unit", F.col("list").alias("home"), F.col("block").alias("home_block"), F.explode("probes").alias("list"))
        .where(F.col("list") >= F.col("home"))
        .join(place, ["label", "size", "list"])
        .withColumn("first", F.when(F.col("list") == F.col("home"), F.col("home_block")).otherwise(0))
        .withColumn("block", F.explode(F.sequence("first", F.col("blocks") - 1)))
    )
    # A query block is the queries of one home block that ask one stored block, so both sides of a comparison are bounded.
    sides = (
        asking.select("label", "size", "list", "block", "home", "home_block", "vec_id", "unit", F.lit(True).alias("asks"))
    )
    # A block that meets itself is one side.
    apart = (F.col("list") != F.col("home")) | (F.col("block") != F.col("home_block"))
    pairs_of_blocks = sides.where(apart).select("label", "size", "list", "block", "home", "home_block").distinct()
    offered = stored.select("label", "size", "list", "block", "vec_id", "unit").join(pairs_of_blocks, ["label", "size", "list", "block"])
    both = sides.unionByName(
        offered.select("label", "size", "list", "block", "home", "home_block", "vec_id", "unit", F.lit(False).alias("asks"))
    )

    def compared(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        queries, rows = table.filter(asks), table.filter(pc.invert(asks))
        itself = all(table.column(a)[0] == table.column(b)[0] for a, b in (("list", "home"), ("block", "home_block")))
        rows = queries if itself else rows
        found_id, found_n, link_a, link_b = [], [], [], []
        if queries.num_rows and rows.num_rows:
            ids, other = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
            x, y = _matrix(queries.column("unit").combine_chunks()), _matrix(rows.column("unit").combine_chunks())
            q, list_id = shared.value[x.shape[1]], int(table.column("list")[0].as_py())
            codes, error = q.encode(y, np.full(len(y), list_id))
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                near = q.table_distances(part, list_id, codes) <= limit + error[None, :]
                a, b = np.nonzero(near)
                cosine = np.einsum("ij,ij->i", part[a], y[b])
                hit = cosine >= least_cosine
                a, b = a[hit] + at, b[hit]
                apart = ids[a] != other[b]
                a, b = a[apart], b[apart]
                if len(a):
                    for side, which in ((a, ids), (b, other))[: 1 if itself else 2]:
                        n = np.bincount(side, minlength=len(which))
                        rows_with = np.flatnonzero(n)
                        found_id += which[rows_with].tolist()
                        found_n += n[rows_with].tolist()
                    for i, j in _local_links(ids, other, a, b):
                        link_a.append(i)
                        link_b.append(j)
        n_found, n_links = len(found_id), len(link_a)
        return pa.table(
            {
                "vec_id": pa.array(found_id + link_a, pa.int64()),
                "n": pa.array(found_n + [None] * n_links, pa.int64()),
                "linked": pa.array([None] * n_found + link_b, pa.int64()),
            }
        )

    found = both.groupBy("label", "size", "list", "block", "home", "home_block").applyInArrow(
        compared, "vec_id bigint, n bigint, linked bigint"
    )
    found = kept(found, "vector-links")
    counts = found.where(F.col("n").isNotNull()).groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    groups = connected_components(found.where(F.col("linked").isNotNull()).select(F.col("vec_id").alias("a"), F.col("linked").alias("b")))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
        .join(counts, "vec_id", "left")
        .join(groups.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
        )
    )
