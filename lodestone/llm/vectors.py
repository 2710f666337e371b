"""Near-duplicate vectors by an exact metric range join.

Vectors are scaled to length 1; two are near if their Euclidean distance is at
most ``EPS``. Pivots, vectors that are well apart, part the space: a vector's
home cell is that of its nearest pivot. If x and y are at most eps apart and at
home with p and q, their distances to the plane between p and q add up to eps at
most (each follows from the distances to the two pivots), so one of them is at
most eps / 2 from it. A vector is therefore copied to the cells of the pivots
to whose plane it has eps / 2 at most; then every near pair meets in a cell
where one of them is at home, and cells are joined independently, all pairs held
to the distance.

Groups of copies would make single cells heavy. So where groups are asked for, a
vector at most eps / 2 from its pivot is a member of the pivot's ball: by the
triangle inequality members are near each other, a link to the pivot stands for
all of that, and only vectors between eps and 1.5 eps from the pivot, its shell,
can be near to a member without being near to the pivot. Members meet the shell
of their ball and nothing else, and two vectors that are linked to the pivot of
a cell need no link of their own there.

A cell is cut into blocks of a bounded number of vectors by counts taken
beforehand, so no task grows with the table. Equal vectors are collapsed before,
and a block passes on a spanning forest of its near pairs, not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import batches, components, cut

EPS = 0.25
CELL = 1024
"""There is a pivot for so many vectors, about, and up to ``PIVOTS``."""
PIVOTS = 16_384
"""Pivots at most: they are held by the driver and sent to every task."""
BLOCK = 4096
"""Vectors of either side that a block holds, at most about."""
SLACK = 1e-6
"""More than rounding may change a distance by; what lies within is taken directly."""
OWN, COPY, MEMBER, SHELL, LINK = range(5)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of float64, scaled to length 1, from the bytes of equally long vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _kind(embeddings: DataFrame) -> str:
    """Vectors travel as the bytes of their numbers, of four bytes each where the table has these."""
    return "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def _usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the vector's bytes, null unless it has a length above 0 and finite numbers only."""
    kind = _kind(embeddings)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1)
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths().fill_null(0)), 0)
        x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind) + np.zeros(1, kind)  # a null is no number; no -0.0
        begin = np.r_[0, np.cumsum(size)]
        bad = np.r_[0, np.cumsum(~np.isfinite(x))]
        some = np.r_[0, np.cumsum(x != 0)]
        fine = (size > 0) & (bad[begin[1:]] == bad[begin[:-1]]) & (some[begin[1:]] > some[begin[:-1]])
        raw, width = x.tobytes(), x.itemsize
        v = [raw[i * width : j * width] if ok else None for i, j, ok in zip(begin[:-1].tolist(), begin[1:].tolist(), fine.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], ["vec_id", "v"])

    return embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")).mapInArrow(batches(f), "vec_id bigint, v binary")


def apart(x: np.ndarray, most: int, least: float) -> np.ndarray:
    """Indices of rows, in their order and ``most`` at most, none nearer than ``least`` to one before it."""
    chosen: list[int] = []
    free = np.ones(len(x), bool)
    for k in range(len(x)):
        if free[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            free &= distances(x[k : k + 1], x)[0] > least
    return np.array(chosen, np.int64)


def cell_entries(distinct: DataFrame, pivots: np.ndarray, names: np.ndarray, eps: float, kind: str, balls: bool) -> DataFrame:
    """(cell, role, linked, node, v, other): each vector in its home cell (``OWN``) and in those where it may meet a near one (``COPY``).

    With ``balls``, members and shells of pivots' balls, and links to the pivot's node, which stands in ``other``; ``linked`` says whether there is such a link.
    """

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 2048):
                yield part(b.slice(i, 2048))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(b.column(1), kind)
        node = b.column(0).to_numpy()
        d = distances(x, pivots)
        at = np.arange(len(x))
        home = d.argmin(axis=1)
        own = d[at, home][:, None]
        inside = d * d - own * own <= eps * distances(pivots[home], pivots) + 4 * SLACK
        inside[at, home] = False
        member = d[at, home] <= eps / 2 - SLACK if balls else np.zeros(len(x), bool)
        inside[member] = False
        r, c = np.nonzero(inside)
        out = [(home[~member], at[~member], OWN), (c, r, COPY)]
        other = np.full(sum(len(o[0]) for o in out), -1, np.int64)
        if balls:
            r, c = np.nonzero((d <= eps - SLACK) & (node[:, None] != names))
            shell = np.nonzero((d > eps - SLACK) & (d <= 1.5 * eps + SLACK))
            out += [(home[member], at[member], MEMBER), (shell[1], shell[0], SHELL), (c, r, LINK)]
            other = np.concatenate([other, np.full(int(member.sum()) + len(shell[0]), -1, np.int64), names[c]])
        cell, row = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        role = np.repeat([o[2] for o in out], [len(o[0]) for o in out])
        v = b.column(1).take(pa.array(row, mask=role == LINK))
        linked = d[row, cell] <= eps - SLACK if balls else np.zeros(len(row), bool)
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(role.astype(np.int32)), pa.array(linked), b.column(0).take(pa.array(row)), v, pa.array(other)], ["cell", "role", "linked", "node", "v", "other"])

    return distinct.select("node", "v").mapInArrow(f, "cell int, role int, linked boolean, node bigint, v binary, other bigint")


def _join_blocks(eps: float, kind: str, all_pairs: bool):
    def f(t: pa.Table) -> pa.Table:
        left, right = (np.flatnonzero(t.column("left").to_numpy() == s) for s in (True, False))
        node = t.column("node").to_numpy()
        home = t.column("home").to_numpy()
        linked = t.column("linked").to_numpy()
        x = _matrix(t.column("v"), kind)
        rough = x.astype(np.float32)
        most = np.float32(2 - (eps + 4 * SLACK) ** 2 - 8e-6) / 2  # of the cosine, less what single precision may add
        a, b, far = [], [], []
        for i in range(0, len(left), 1024):
            at = left[i : i + 1024]
            p, q = np.nonzero(rough[at] @ rough[right].T >= most)
            p, q = at[p], right[q]
            # a pair at home in the cell is taken once
            once = np.flatnonzero((~home[q] | (node[p] < node[q])) & ~(linked[p] & linked[q]))
            p, q = p[once], q[once]
            for k in range(0, len(p), 1 << 16):
                pk, qk = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                d = _exact(x[pk], x[qk])
                s = d <= eps
                a.append(node[pk[s]])
                b.append(node[qk[s]])
                far.append(d[s])
        a, b, far = (np.concatenate(z) if z else np.zeros(0) for z in (a, b, far))
        if not all_pairs and len(a):
            keep = _spanning(a, b)
            a, b, far = a[keep], b[keep], far[keep]
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "distance": pa.array(far.astype(np.float64))})

    return f


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges a spanning forest needs."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent.setdefault(p, p)
            v = p
        return v

    keep = []
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[ru] = rv
            keep.append(k)
    return np.array(keep, np.int64)


def _links(distinct: DataFrame, eps: float, pivots: int | None, all_pairs: bool, kind: str) -> DataFrame:
    """(a, b, distance) over nodes."""
    out = "a bigint, b bigint, distance double"
    n = distinct.count()
    if n < 2:
        return distinct.sparkSession.createDataFrame([], out)
    many = max(1, min(PIVOTS, n // CELL if pivots is None else pivots))
    drawn = distinct.select("v", "node").orderBy(F.xxhash64("v"), "v").limit(2 * many).toArrow()  # 2 * PIVOTS rows at most
    x = _matrix(drawn.column(0), kind)
    chosen = apart(x, many, 2 * eps)
    entries = cut(cell_entries(distinct, x[chosen], drawn.column(1).to_numpy()[chosen], eps, kind, not all_pairs))
    # either side of a cell: those at home against all there, members of a ball against its shell
    ball = F.col("role").isin(MEMBER, SHELL)
    e = entries.filter(F.col("role") != LINK).select("cell", ball.alias("ball"), F.col("role").isin(OWN, MEMBER).alias("home"), "linked", "node", "v")
    asks = F.col("home")
    asked = ~F.col("home") | ~F.col("ball")
    sizes = e.groupBy("cell", "ball").agg(F.ceil(F.count_if(asks) / BLOCK).cast("int").alias("rows"), F.ceil(F.count_if(asked) / BLOCK).cast("int").alias("cols"))
    e = e.join(F.broadcast(sizes.filter("rows > 0 AND cols > 0")), ["cell", "ball"])  # two rows a pivot at most
    spread = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))
    left = e.filter(asks).withColumns({"left": F.lit(True), "r": F.pmod(spread, F.col("rows")), "c": every("cols")})
    right = e.filter(asked).withColumns({"left": F.lit(False), "c": F.pmod(spread, F.col("cols")), "r": every("rows")}).select(left.columns)
    met = left.unionByName(right).groupBy("cell", "ball", "r", "c").applyInArrow(_join_blocks(eps, kind, all_pairs), out)
    return met.unionByName(entries.filter(F.col("role") == LINK).select(F.col("node").alias("a"), F.col("other").alias("b"), F.lit(None).cast("double").alias("distance")))


def _distinct(rows: DataFrame) -> DataFrame:
    """(node, v): the distinct vectors, named by their least vec_id."""
    return rows.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("node"))


def _by_dimension(distinct: DataFrame, eps: float, pivots: int | None, all_pairs: bool, kind: str) -> DataFrame:
    dims = [r[0] for r in distinct.select(F.octet_length("v")).distinct().collect()]  # a row a dimension: one in any sound table
    out = distinct.sparkSession.createDataFrame([], "a bigint, b bigint, distance double")
    for d in dims:
        out = out.unionByName(_links(distinct.filter(F.octet_length("v") == d), eps, pivots, all_pairs, kind))
    return out


def pairs(embeddings: DataFrame, eps: float = EPS, pivots: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: all pairs of vec_ids whose vectors are at most eps apart, equal vectors with distance 0 among them.

    Nulls, zeros and vectors with a number that isn't finite are near to
    nothing; vectors of different dimensions aren't compared; a null vec_id is
    left out; repeated rows of a vec_id make no pair with themselves. An empty
    table gives no pair. Columns other than vec_id and embedding are not read.
    """
    rows = _usable(embeddings)
    distinct = cut(_distinct(rows))
    linked = _by_dimension(distinct, eps, pivots, True, _kind(embeddings))
    members = rows.filter("v IS NOT NULL AND vec_id IS NOT NULL").join(distinct, "v").select("node", "vec_id").distinct()
    one = members.select(F.col("node").alias("a"), F.col("vec_id").alias("x"))
    two = members.select(F.col("node").alias("b"), F.col("vec_id").alias("y"))
    across = linked.join(one, "a").join(two, "b").select("x", "y", "distance")
    equal = one.join(two, F.col("a") == F.col("b")).filter("x < y").select("x", "y", F.lit(0.0).alias("distance"))
    both = across.unionByName(equal).filter("x <> y")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("distance").alias("distance"))


def groups(embeddings: DataFrame, eps: float = EPS, pivots: int | None = None) -> DataFrame:
    """(vec_id, group_id, kept) for each row: groups are the connected components of near pairs, named by their least vec_id, which is kept.

    Vectors that are near to nothing (see ``pairs``) are groups of their own; of
    repeated rows of a kept vec_id one is kept; a null vec_id has a null group
    and is kept. An empty table gives no row. Columns other than vec_id and
    embedding are neither read nor carried, so their names can't clash.
    """
    rows = _usable(embeddings)
    distinct = cut(_distinct(rows))
    roots = components(_by_dimension(distinct, eps, pivots, False, _kind(embeddings)))
    fine = rows.filter("v IS NOT NULL AND vec_id IS NOT NULL").join(distinct, "v").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    fine = fine.select("vec_id", F.coalesce("root", "node").alias("group_id"))
    other = rows.filter("v IS NULL OR vec_id IS NULL").select("vec_id", F.col("vec_id").alias("group_id"))
    every = fine.unionByName(other)
    nth = F.row_number().over(Window.partitionBy("vec_id", "group_id").orderBy("vec_id"))
    return every.select("vec_id", "group_id", (F.col("vec_id").isNull() | ((F.col("vec_id") == F.col("group_id")) & (nth == 1))).alias("kept"))


def oracle(embeddings: str = "embeddings", eps: float = EPS) -> str:
    """DuckDB SQL for ``groups`` over sound vectors with distinct ids."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM {embeddings}),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b WHERE sqrt(greatest(0, 2 - 2 * list_inner_product(a.e, b.e))) <= {eps}),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x)
SELECT x AS vec_id, min(y) AS group_id, x = min(y) AS kept FROM reach GROUP BY x"""
