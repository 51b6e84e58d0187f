"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Exact copies are one class first. The index is fitted on a bounded sample: coarse
centroids (spherical k-means) and, for the residuals, one codebook per subspace. Every
class is indexed: its list (the nearest centroid), its angle to that centroid, its residual
codes and the length of what the codes leave out.

A class queries every list that two exact bounds leave open, however many these are: a link
turns by at most the angle of the least cosine, so (1) the query's angle to the list's
centroid is within that of the angles of the list's members, and (2) the query lies no
further than that behind the plane that parts the list from any centroid nearer to the
query. An asymmetric distance comes from table look-ups per subspace; it is off by no more
than the length left out (Cauchy-Schwarz), so pruning with that margin loses nothing, and
what remains is reranked by the exact cosine in double precision. No link is lost at any
size. Lists have an order and a class queries its own list and earlier ones only, so each
pair is seen once and credited to both.

Neighbouring lists are put together into cells of about a tile. Work units are tiles (cell,
block of members, slice of queries) of bounded size, so a list that holds a third of all
vectors is spread over many tasks. A unit reports sums of links per vector and a spanning
forest, never all pairs of a group.

Defined cases: a vector that is null, zero, or holds null or non-finite components links
with nothing; vectors shorter than the longest are padded with zeros; rows without an id
link with nothing and get a null component; repeated rows count as other vectors and share
their id's component; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import saved, spread_join, table
from tallyforge.llm.components import components
from tallyforge.llm.simhash import _forest

LEAST_COSINE = 0.95
#: Vectors that fit the index, or PER_CENTROID for each list if these are more; all are indexed.
SAMPLE, PER_CENTROID = 20_000, 16
#: Classes for each list, about, and lists at most.
PER_LIST, MOST_LISTS = 256, 4096
#: Nearest centroids of a query whose planes are tried against each list.
PLANES = 8
SUBSPACES = 8
CODES = 256
#: Members and queries in a tile at most, as aimed at.
TILE = 4096
SEED = 9


def _dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision, padded to dim with zeros, and which of them are whole: no null
    and no component that is null or not finite."""
    n = len(column)
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and len(flat) == n * dim and pc.all(pc.equal(pc.list_value_length(column), dim)).as_py():
        x = flat.to_numpy().astype(np.float64).reshape(n, dim)
        ok = np.isfinite(x).all(axis=1)
    else:
        x, ok = np.zeros((n, dim)), np.zeros(n, dtype=bool)
        for i, row in enumerate(column.to_pylist()):
            if row is not None and None not in row:
                x[i, : len(row)] = row
                ok[i] = np.isfinite(x[i]).all()
    x[~ok] = 0
    return x, ok


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    most = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / np.where(most > 0, most, 1)  # no square overflows or vanishes
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1) + 0.0


class Packed:
    """Vectors as bytes: in the precision in which they came, half the size for floats; at unit
    length in double precision when they are read."""

    def __init__(self, dim: int, single: bool):
        self.dim, self.kind = dim, "<f4" if single else "<f8"

    def bytes_of(self, x: np.ndarray) -> list[bytes]:
        return [row.tobytes() for row in x.astype(self.kind)]

    def units(self, column: pa.Array) -> np.ndarray:
        return _unit(np.frombuffer(b"".join(column.to_pylist()), dtype=self.kind).astype(np.float64).reshape(len(column), self.dim))


def _vectors(rows: DataFrame, form: Packed) -> DataFrame:
    """(vec_id, key, vec): key is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (x, ok) = batch.column(0), _dense(batch.column(1), form.dim)
            units = _unit(x)
            ok &= x.any(axis=1) & ~np.asarray(ids.is_null())
            raw = [r if good else None for r, good in zip(form.bytes_of(x), ok)]
            keys = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() if good else None for u, good in zip(units, ok)]
            yield pa.record_batch([ids, pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "vec"])

    return rows.mapInArrow(run, "vec_id long, key binary, vec binary")


def _kmeans(x: np.ndarray, k: int, spherical: bool, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        half = 0 if spherical else 0.5 * (centres**2).sum(axis=1)
        near = np.concatenate([np.argmax(x[at : at + 4096] @ centres.T - half, axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
        if spherical:
            centres /= np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-12)
    return centres


class Index:
    """Coarse centroids and residual codebooks, fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim, self._gaps = sample.shape[1], None
        self.coarse = _kmeans(sample, lists, spherical=True)
        self.width = -(-self.dim // SUBSPACES)
        residual = self._padded(sample - self.coarse[self.home(sample)[0]])
        self.books = [_kmeans(np.ascontiguousarray(residual[:, m]), CODES, spherical=False) for m in range(SUBSPACES)]

    def _padded(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.width * SUBSPACES))
        wide[:, : self.dim] = x
        return wide.reshape(len(x), SUBSPACES, self.width)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and the angle to its centroid."""
        home, angle = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for at in range(0, len(x), 4096):
            near = x[at : at + 4096] @ self.coarse.T
            home[at : at + 4096] = np.argmax(near, axis=1)
            angle[at : at + 4096] = np.arccos(np.clip(near.max(axis=1), -1, 1))
        return home, angle

    def gaps(self) -> np.ndarray:
        """Distances between centroids, made once for each worker."""
        if self._gaps is None:
            squares = (self.coarse**2).sum(axis=1)
            self._gaps = np.sqrt(np.maximum(squares[:, None] + squares - 2 * self.coarse @ self.coarse.T, 0)).astype(np.float32)
        return self._gaps

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, angle to its centroid, codes, length left out."""
        home, angle = self.home(x)
        residual = self._padded(x - self.coarse[home])
        codes = np.empty((len(x), SUBSPACES), dtype=np.uint8)
        left = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = residual[:, m]
            codes[:, m] = np.argmax(part @ book.T - 0.5 * (book**2).sum(axis=1), axis=1)
            left += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return home, angle, codes, np.sqrt(left)

    def reach(self, x: np.ndarray, lists: np.ndarray, low: np.ndarray, high: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``lists``, with members at angles low to high, may hold a link of each
        vector, and the vectors' angles to their centroids."""
        turn = np.arccos(np.clip(least, -1, 1)) + 1e-6
        near = x @ self.coarse.T
        at = near[:, lists]
        angle = np.arccos(np.clip(at, -1, 1))
        open_ = (angle <= high + turn) & (angle >= low - turn)
        gaps, steep = self.gaps(), np.sin(min(turn, np.pi / 2))
        planes = min(PLANES, len(self.coarse))
        for by in np.argpartition(-near, planes - 1, axis=1)[:, :planes].T:
            open_ &= near[np.arange(len(x)), by][:, None] - at <= steep * gaps[by[:, None], lists] + 2e-6
        return open_, angle

    def estimates(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric estimates of the cosines of queries with coded members of one list."""
        parts = self._padded(queries)
        out = np.repeat((queries @ self.coarse[of])[:, None], len(codes), axis=1)
        for m, book in enumerate(self.books):
            out += np.take(parts[:, m] @ book.T, codes[:, m], axis=1)
        return out


INDEXED = "rep long, n long, vec binary, home int, angle double, codes binary, left double, cells array<int>"


class Lists:
    """Sizes and angles of the lists, their order, and the cells that they are put into."""

    def __init__(self, index: Index, sizes: list, tile: int):
        """``sizes`` has (list, members, least angle, largest angle) of every list in use."""
        self.used = np.array([r[0] for r in sizes], dtype=np.int64)
        count = np.array([r[1] for r in sizes], dtype=np.int64)
        near = index.coarse[self.used]
        centres = _kmeans(near, max(1, min(len(near), -(-int(count.sum()) // tile))), spherical=True)
        order = np.lexsort((self.used, np.argmax(near @ centres.T, axis=1)))
        self.used, count = self.used[order], count[order]
        self.low, self.high = (np.array([r[c] for r in sizes])[order] for c in (2, 3))
        self.rank = np.full(len(index.coarse), -1)
        self.rank[self.used] = np.arange(len(order))
        self.cell = np.zeros(len(order), dtype=np.int64)
        held = cell = 0
        for k, members in enumerate(count):
            if held and held + members > tile:
                held, cell = 0, cell + 1
            self.cell[k] = cell
            held += members


def _homes(classes: DataFrame, index: Index, form: Packed) -> list:
    """(list, members, least angle, largest angle) of every list in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, angle = index.home(form.units(batch.column("vec")))
                yield pa.record_batch([pa.array(home.astype(np.int32)), pa.array(angle)], names=["home", "angle"])

    found = classes.select("vec").mapInArrow(run, "home int, angle double")
    return found.groupBy("home").agg(F.count("*"), F.min("angle"), F.max("angle")).collect()


def _indexed(classes: DataFrame, index: Index, lists: Lists, form: Packed, least: float) -> DataFrame:
    """The classes' places in the index and the cells that each one queries."""

    def cells(x: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        found = []
        for at in range(0, len(x), 1024):
            open_, _ = index.reach(x[at : at + 1024], lists.used, lists.low, lists.high, least)
            open_ &= np.arange(len(lists.used)) <= lists.rank[home[at : at + 1024]][:, None]
            found += [np.unique(lists.cell[row]).astype(np.int32) for row in open_]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = form.units(batch.column("vec"))
            home, angle, codes, left = index.place(x)
            yield pa.record_batch(
                [batch.column("rep"), batch.column("n"), batch.column("vec"), pa.array(home.astype(np.int32)), pa.array(angle),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), pa.array(cells(x, home), pa.list_(pa.int32()))],
                names=[f.split()[0] for f in INDEXED.split(", ")],
            )

    return classes.select("rep", "n", "vec").mapInArrow(run, INDEXED)


def _search(index: Index, lists: Lists, form: Packed, least: float):
    """Links between the queries and the members of one tile: rows (a, b, n) - the links of
    vector a to add (b null), or a link of the spanning forest (n null)."""
    turn = np.arccos(np.clip(least, -1, 1)) + 1e-6

    def columns(rows: pa.Table) -> tuple:
        return form.units(rows.column("vec")), *(rows.column(c).to_numpy() for c in ("rep", "n", "home"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kinds = [("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]
        member = rows.column("member").to_numpy(zero_copy_only=False).astype(bool)
        members, queries = rows.filter(pa.array(member)), rows.filter(pa.array(~member))
        if not members.num_rows or not queries.num_rows:
            return pa.schema(kinds).empty_table()
        members = members.sort_by([("home", "ascending"), ("angle", "ascending")])
        v, v_rep, v_n, v_home = columns(members)
        q, q_rep, q_n, q_home = columns(queries)
        angle = members.column("angle").to_numpy()
        codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, SUBSPACES)
        bound = least - 1e-9 - members.column("left").to_numpy()
        q_links, v_links = np.zeros(len(q), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
        names = np.concatenate((q_rep, v_rep))
        tree_a, tree_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        starts = np.append(np.flatnonzero(np.append(True, v_home[1:] != v_home[:-1])), len(v))
        of = v_home[starts[:-1]]
        open_, turned = index.reach(q, of, angle[starts[:-1]], angle[starts[1:] - 1], least)
        open_ &= lists.rank[of] <= lists.rank[q_home][:, None]
        for k, (first, end) in enumerate(zip(starts, starts[1:])):
            for lo in range(first, end, 256):  # members at like angles
                hi = min(lo + 256, end)
                asks = np.flatnonzero(open_[:, k] & (turned[:, k] <= angle[hi - 1] + turn) & (turned[:, k] >= angle[lo] - turn))
                for at in range(0, len(asks), 1024):
                    some = asks[at : at + 1024]
                    near = index.estimates(q[some], of[k], codes[lo:hi]) >= bound[lo:hi]
                    if near.mean() > 0.05:  # dense: all exact cosines of the block at once
                        i, j = np.nonzero(near & (q[some] @ v[lo:hi].T >= least))
                    else:
                        i, j = np.nonzero(near)
                        exact = np.einsum("ij,ij->i", q[some[i]], v[lo + j]) >= least
                        i, j = i[exact], j[exact]
                    # In one list both ask; the larger id's question counts.
                    once = (q_home[some[i]] != of[k]) | (q_rep[some[i]] > v_rep[lo + j])
                    i, j = i[once], j[once]
                    if not len(i):
                        continue
                    np.add.at(q_links, some[i], v_n[lo + j])
                    np.add.at(v_links, lo + j, q_n[some[i]])
                    low = _forest(len(some) + hi - lo, i, j + len(some))
                    moved = np.flatnonzero(low != np.arange(len(low)))
                    nodes = np.concatenate((some, len(q) + np.arange(lo, hi)))
                    tree_a.append(nodes[moved])
                    tree_b.append(nodes[low[moved]])
        low = _forest(len(names), np.concatenate(tree_a), np.concatenate(tree_b))
        moved = np.flatnonzero(low != np.arange(len(low)))
        a, b = names[moved], names[low[moved]]
        q_has, v_has = np.flatnonzero(q_links), np.flatnonzero(v_links)
        sums = np.concatenate((q_rep[q_has], v_rep[v_has]))
        made = pa.table({
            "a": pa.array(np.concatenate((sums, a))),
            "b": pa.concat_arrays([pa.nulls(len(sums), pa.int64()), pa.array(b)]),
            "n": pa.concat_arrays([pa.array(np.concatenate((q_links[q_has], v_links[v_has]))), pa.nulls(len(a), pa.int64())]),
        })
        return made.cast(pa.schema(kinds))

    return run


def fit(classes: DataFrame, count: int, form: Packed) -> Index | None:
    """An index over ``count`` classes, fitted on those with the least hashes; None if there are
    no classes. The sample is at most about 65,536 vectors."""
    if not count:
        return None
    lists = max(1, min(MOST_LISTS, count // PER_LIST))
    wanted = max(SAMPLE, PER_CENTROID * lists)
    share = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.lit(min(1.0, wanted / count))  # never rounds to nothing
    picked = classes.where(F.xxhash64("rep", F.lit(SEED)).cast("double") <= share)
    rows = sorted(picked.select("rep", "vec").limit(2 * wanted).collect())
    if not rows:
        raise RuntimeError("no vector was picked to fit the index on")
    sample = form.units(pa.array([bytes(r.vec) for r in rows], pa.binary()))
    return Index(sample, lists)


def links(vectors: DataFrame, least: float = LEAST_COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0]
    element = getattr(rows.schema["embedding"].dataType, "elementType", None)
    form = Packed(max(1, dim or 1), isinstance(element, T.FloatType))
    made = saved(_vectors(rows, form), "vectors")
    valid = made.where("key IS NOT NULL")
    classes = saved(
        valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vector-classes"
    )
    count = classes.count()
    index = fit(classes, count, form)
    if index is None:
        return made.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    lists = Lists(index, _homes(classes, index, form), tile)
    cell_of = F.element_at(F.array(*[F.lit(int(lists.cell[r]) if r >= 0 else -1) for r in lists.rank]), F.col("home") + 1)
    indexed = saved(_indexed(classes, index, lists, form, least).withColumn("own", cell_of), "vector-index")
    # At most MOST_LISTS rows each: how many blocks of members and slices of queries a cell has.
    asks = indexed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    holds = indexed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("m"))
    sizes = saved(
        holds.join(asks, "cell").select("cell", F.ceil(F.col("m") / tile).cast("int").alias("blocks"), F.ceil(F.col("q") / tile).cast("int").alias("slices")),
        "vector-cells",
    )
    sizes = F.broadcast(sizes)
    part = F.xxhash64("rep", F.lit(SEED))

    def spread(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    members = indexed.withColumn("cell", F.col("own")).join(sizes, "cell").withColumn("block", F.pmod(part, "blocks").cast("int")).withColumn("slice", spread("slices")).withColumn("member", F.lit(True))
    queries = indexed.withColumn("cell", F.explode("cells")).join(sizes, "cell").withColumn("slice", F.pmod(part, "slices").cast("int")).withColumn("block", spread("blocks")).withColumn("member", F.lit(False))
    shared = ["cell", "block", "slice", "member", "rep", "n", "vec", "home"]
    # Queries carry no codes.
    tiles = members.select(*shared, "angle", "codes", "left").unionByName(queries.select(shared), allowMissingColumns=True)
    found = saved(tiles.groupBy("cell", "block", "slice").applyInArrow(_search(index, lists, form, least), "a long, b long, n long"), "vector-links")
    sums = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    named = components(found.where("b IS NOT NULL").select("a", "b"), "vector-components")
    of_class = (
        classes.select("key", "rep", "n").join(sums, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
        .select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = spread_join(made.select("vec_id", "key"), of_class, "key", "vector-classes")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))
