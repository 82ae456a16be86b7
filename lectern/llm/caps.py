"""Near-duplicate embeddings found by spherical-cap filters.

Filters are directions; a vector goes to each filter whose inner product with it exceeds a bound, so two vectors meet where
they lie in a cap together.  Directions are the words of random product codes under random rotations: a word is one piece from each
of a few small codebooks, so all words over the bound are decoded from sorted partial products, without trying all of them.  Bound and number
of words follow from the number of vectors: some ``LOAD`` unrelated vectors a cap, and ``EXPECTED`` caps shared by a pair at the threshold.
Vectors are joined on filters and compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, hot_joined, read, shuffle_partitions, whole_id
from lectern.llm.components import connected_components

THRESHOLD = 0.93
LOAD, EXPECTED, CODES = 64, 12, 8
#: Pieces a codebook has at most, and dimensions that vectors are padded to at least.
BOOK, LEAST_DIM = 2048, 16
#: Vectors of a filter that are compared at once; the rest of a more crowded one is dealt to pairs of parts.
CROWD = 2048
#: Up to so many crowded filters are broadcast, beyond they are joined by a shuffle.
MANY = 100_000
SEED = 20_240
_CODE = 1 << 56
_KEY = ["label", "dim", "f"]


def cap(bound: float, dim: int) -> float:
    """The share of the unit sphere whose inner product with a direction is ``bound`` (0 or more) or greater."""
    t = np.linspace(bound, 1, 4001)
    return float(np.trapezoid((1 - t * t) ** ((dim - 3) / 2), t) * math.exp(math.lgamma(dim / 2) - math.lgamma((dim - 1) / 2)) / math.sqrt(math.pi))


def wedge(bound: float, cosine: float, dim: int) -> float:
    """The share of directions that two vectors of a cosine both lie in the cap of."""
    t = np.linspace(bound, 1, 402)[:-1]
    weight = (1 - t * t) ** ((dim - 3) / 2) * math.exp(math.lgamma(dim / 2) - math.lgamma((dim - 1) / 2)) / math.sqrt(math.pi)
    need = np.clip((bound - cosine * t) / np.sqrt((1 - cosine**2) * (1 - t * t)), -1, 1)
    return float(np.trapezoid(weight * [cap(u, dim - 1) if u >= 0 else 1 - cap(-u, dim - 1) for u in need], t))


@lru_cache(maxsize=64)
def design(n: int, dim: int, cosine: float = THRESHOLD) -> tuple[float, list[list[np.ndarray]]]:
    """(bound, codes) for ``n`` vectors: of each code its codebooks, rotated, as rows."""
    share, low, high = min(0.05, LOAD / n), 0.0, 0.99
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if cap(mid, dim) > share else (low, mid)
    words = EXPECTED / wedge(low, cosine, dim) / CODES
    blocks = 2
    while words ** (1 / blocks) > BOOK and dim // (blocks + 1) >= 4:
        blocks += 1
    size, rng, codes = math.ceil(words ** (1 / blocks)), np.random.default_rng(SEED + dim), []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        books = []
        for part in np.array_split(rotation, blocks):
            pieces = rng.normal(size=(size, len(part)))
            books.append(pieces / np.linalg.norm(pieces, axis=1, keepdims=True) / math.sqrt(blocks) @ part)
        codes.append(books)
    return low, codes


def decoded(x: np.ndarray, bound: float, codes: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters over the bound of unit vectors ``x``, rows ascending."""
    rows, filters = [], []
    for number, books in enumerate(codes):
        products = [x @ b.T for b in books]
        row, word, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        best = [p.max(axis=1) for p in products]
        for i, p in enumerate(products):
            order = np.argsort(p, axis=1)
            # rows lie 4 apart on one line, so one search over all of them finds where each row's bound falls
            line = (np.take_along_axis(p, order, 1) + 4.0 * np.arange(len(x))[:, None]).ravel()
            need = bound - total - sum((b[row] for b in best[i + 1 :]), 0.0)
            first = np.searchsorted(line, np.clip(need, -2, 2) + 4.0 * row)
            count = (row + 1) * p.shape[1] - first
            at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, word, total = np.repeat(row, count), np.repeat(word, count), np.repeat(total, count)
            piece = order.ravel()[at]
            word, total = word * p.shape[1] + piece, total + p[row, piece]
        rows.append(row)
        filters.append(word + number * _CODE)
    row, f = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((f, row))
    return row[order], f[order]


def unit(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of one dimension at length one, in double precision, padded with zeros to ``LEAST_DIM``."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, max(0, LEAST_DIM - x.shape[1]))))


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    left, edges = np.ones(len(near), bool), []
    for start in range(len(near)):
        if left[start]:
            left[start], found = False, [start]
            while found:
                i = found.pop()
                new = np.flatnonzero(near[i] & left)
                left[new] = False
                edges += [(i, j) for j in new.tolist()]
                found += new.tolist()
    return edges


def _filtered(points: DataFrame, n: int, cosine: float, whole: bool) -> DataFrame:
    """One row for each filter of each point (pid, label, embedding): its key, and with ``whole`` the point, its vector and its filters."""
    more = ["w", "ball"] if whole and "ball" in points.columns else ["w"] if whole else []

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dims = pdf["embedding"].map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                some = pdf[dims == dim]
                for i in range(0, len(some), 1000):
                    part = some.iloc[i : i + 1000]
                    x = unit(part["embedding"].tolist())
                    row, f = decoded(x, *design(n, x.shape[1], cosine))
                    out = {"label": part["label"].to_numpy()[row], "dim": np.int32(dim), "f": f}
                    if whole:
                        ends = np.searchsorted(row, np.arange(len(x) + 1))
                        lists = np.array([f[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], object)
                        vectors = np.array([v.tobytes() for v in x], object)
                        out |= {"pid": part["pid"].to_numpy()[row], "x": vectors[row], "fs": lists[row]} | {c: part[c].to_numpy()[row] for c in more}
                    yield pd.DataFrame(out)

    schema = f"label {points.schema['label'].dataType.simpleString()}, dim int, f long" + (", pid long, x binary, fs binary" + "".join(f", {c} long" for c in more)) * whole
    return points.select(*(["pid", *more] if whole else []), "label", "embedding").mapInPandas(work, schema)


def _centres(rows: DataFrame) -> DataFrame:
    """(label, dim, f, n, centre): the sum of the vectors of each crowded filter; tasks add up their own rows first."""
    label = rows.schema["label"].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for key, x, n in zip(zip(pdf["label"], pdf["dim"], pdf["f"], strict=True), pdf["x"], pdf["n"], strict=True):
                v = np.frombuffer(x)
                total, so_far = sums.get(key, (0.0, 0))
                sums[key] = total + v, so_far + n
            if len(sums) > 20_000:
                yield frame(sums)
                sums = {}
        yield frame(sums)

    def frame(sums: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, n, v.tobytes()) for k, (v, n) in sums.items()], columns=["label", "dim", "f", "n", "x"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(iter(add(iter([pdf]))))

    schema = f"label {label}, dim int, f long, n long, x binary"
    parts = rows.withColumn("n", F.lit(1).cast("long")).select(*_KEY, "n", "x").mapInPandas(add, schema)
    return parts.groupBy(*_KEY).applyInPandas(final, schema).withColumnRenamed("x", "centre")


def balls(points: DataFrame, crowded: DataFrame, n: int, cosine: float) -> DataFrame:
    """(pid, ball): for points within half the threshold's angle of the centre of a crowded filter of theirs, that of the fullest such filter.

    Any two points of one ball (and label and dimension) link, by the triangle inequality, and need no comparison.
    """
    rows = checkpointed(_filtered(points, n, cosine, True).join(crowded.select(*_KEY), _KEY, "left_semi").select(*_KEY, "pid", "x"))
    centres = _centres(rows)
    reach = math.cos(math.acos(cosine) / 2) + 1e-9

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [float(x @ c) >= reach * float(np.linalg.norm(c)) for x, c in zip(map(np.frombuffer, pdf["x"]), map(np.frombuffer, pdf["centre"]), strict=True)]
            yield pdf.loc[keep, ["pid", "f", "n"]] if any(keep) else pdf.iloc[:0][["pid", "f", "n"]]

    found = hot_joined(rows, checkpointed(centres), _KEY, "n", rows.count()).mapInPandas(near, "pid long, f long, n long")
    return found.groupBy("pid").agg(F.max_by("f", F.struct("n", "f")).alias("ball"))


def _dealt(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows with part, a, b: those of crowded filters go to all pairs of parts that their own part makes, but to none of one ball alone."""
    plain = rows.join(crowded.select(*_KEY), _KEY, "left_anti").withColumns({c: F.lit(0) for c in ("part", "a", "b")})
    hot = checkpointed(rows.join(crowded.select(*_KEY), _KEY, "left_semi"))
    held = hot.groupBy(*_KEY, "ball").agg(F.count("*").alias("n")).withColumn("class", F.when(F.col("n") > CROWD / 2, F.col("ball")).otherwise(-1))
    parts = held.groupBy(*_KEY, "class").agg(F.sum("n").alias("m")).withColumn("p", F.ceil(F.col("m") / CROWD).cast("int"))
    key = Window.partitionBy(*_KEY)
    upto = key.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"lo": F.coalesce(F.sum("p").over(upto), F.lit(0)).cast("int"), "all": F.sum("p").over(key).cast("int")})
    table = held.join(parts.select(*_KEY, "class", "p", "lo", "all"), [*_KEY, "class"])
    told = hot_joined(hot, checkpointed(table), [*_KEY, "ball"], "n", hot.count())
    told = told.withColumn("part", (F.col("lo") + F.pmod(F.xxhash64("pid"), F.col("p"))).cast("int"))
    other = F.explode(F.expr("filter(sequence(0, `all` - 1), j -> class = -1 or j < lo or j >= lo + p)"))
    told = told.withColumn("j", other)
    return plain.unionByName(told.select(*rows.columns, "part", F.least("part", "j").alias("a"), F.greatest("part", "j").alias("b")))


def compared(left: pd.DataFrame, right: pd.DataFrame | None, f: int, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(pids, links, edges) of one filter: links that no lower filter shows, between two parts or (``right`` None) within one."""
    both = left if right is None else pd.concat([left, right])
    x = np.frombuffer(b"".join(left["x"])).reshape(len(left), -1)
    y = x if right is None else np.frombuffer(b"".join(right["x"])).reshape(len(right), -1)
    near = x @ y.T >= cosine
    if right is None:
        near = np.triu(near, 1)
    ball, other = left["ball"].to_numpy(), (left if right is None else right)["ball"].to_numpy()
    near &= (ball[:, None] != other) | (ball[:, None] < 0)
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    near = near[np.ix_(i, j)]
    lists = [np.frombuffer(v, np.int64) for v in (*left["fs"].to_numpy()[i], *(left if right is None else right)["fs"].to_numpy()[j])]
    owner = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    values = np.concatenate(lists)
    lower = values < f
    names, at = np.unique(values[lower], return_inverse=True)
    holds = np.zeros((len(lists), len(names)), np.float32)
    holds[owner[lower], at] = 1
    near &= holds[: len(i)] @ holds[len(i) :].T == 0
    nodes = np.concatenate([i, j + (0 if right is None else len(left))])
    ids, w = both["pid"].to_numpy(), both["w"].to_numpy()
    links = np.zeros(len(both), np.int64)
    np.add.at(links, nodes[: len(i)], near @ w[nodes[len(i) :]])
    np.add.at(links, nodes[len(i) :], near.T @ w[nodes[: len(i)]])
    known, where = np.unique(nodes, return_inverse=True)
    matrix = np.zeros((len(known), len(known)), bool)
    matrix[np.ix_(where[: len(i)], where[len(i) :])] |= near
    edges = [(int(ids[known[a]]), int(ids[known[b]])) for a, b in forest(matrix | matrix.T)]
    hit = np.flatnonzero(links)
    return ids[hit], links[hit], edges


def links(points: DataFrame, n: int, cosine: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((pid, links), (u, v)): how much weight each point (pid, w, label, embedding) is linked to, and edges that keep all links."""
    spark = points.sparkSession
    crowded = checkpointed(_filtered(points, n, cosine, False).groupBy(*_KEY).count().where(F.col("count") > CROWD))
    many = crowded.count()
    crowded = F.broadcast(crowded) if many <= MANY else crowded
    inner = []
    if many:
        of = checkpointed(points.select("pid", "label", "w", F.size("embedding").alias("dim")).join(balls(points, crowded, n, cosine), "pid"))
        size = of.groupBy("label", "dim", "ball").agg(F.sum("w").alias("weight"), F.min("pid").alias("least"), F.count("*").alias("n"))
        told = hot_joined(of, checkpointed(size), ["label", "dim", "ball"], "n", of.count())
        inner = [told.select("pid", (F.col("weight") - F.col("w")).alias("links"), F.col("least").alias("other"))]
        points = points.join(of.select("pid", "ball"), "pid", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long")))
        points = checkpointed(points)
    else:
        points = points.withColumn("ball", F.lit(-1).cast("long"))
    rows = _filtered(points, n, cosine, True)
    rows = _dealt(rows, crowded) if many else rows.withColumns({c: F.lit(0) for c in ("part", "a", "b")})
    at = [*_KEY, "a", "b"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by filter, pair of parts and part; a group may span batches."""
        open_: list[pd.DataFrame] = []

        def closed() -> Iterator[pd.DataFrame]:
            group = pd.concat(open_) if len(open_) > 1 else open_[0]
            if len(group) > 1:
                first = group.iloc[0]
                left = group if first["a"] == first["b"] else group[group["part"] == first["a"]]
                pids, found, edges = compared(left, None if first["a"] == first["b"] else group[group["part"] == first["b"]], int(first["f"]), cosine)
                if len(pids):
                    yield pd.DataFrame({"pid": pids, "links": found, "other": pd.array([None] * len(pids), "Int64")})
                    yield pd.DataFrame({"pid": [a for a, _ in edges], "links": 0, "other": pd.array([b for _, b in edges], "Int64")})

        for pdf in batches:
            keys = pdf[at].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(pdf)], strict=True):
                if open_ and (open_[0][at].iloc[0].to_numpy() != keys[lo]).any():
                    yield from closed()
                    open_ = []
                open_.append(pdf.iloc[lo:hi])
        if open_:
            yield from closed()

    met = rows.repartition(shuffle_partitions(spark), *at).sortWithinPartitions(*at, "part")
    out = met.mapInPandas(compare, "pid long, links long, other long")
    out = checkpointed(out.unionByName(inner[0]) if inner else out)
    return out.groupBy("pid").agg(F.sum("links").alias("links")), out.where("other is not null and other <> pid").select(F.col("pid").alias("u"), F.col("other").alias("v"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", cosine: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (``id_col``, embedding, label), whatever other columns it has.

    Rows link where their labels and dimensions are equal and their cosine is ``cosine`` or more.  Those whose label is null or whose embedding is null, empty,
    zero or holds a null or non-finite component link with nothing.  Equal embeddings are one point with a weight and link with each
    other.  component_id is the smallest id reached; rows with a null id link as others do and count for no component's smallest id, so all-null components have
    none.  kept is whether the id is that of the component (null equals null, so rows that repeat are kept together).
    """
    x = F.col("embedding")
    rows = vectors.select(whole_id(vectors, id_col).alias("vec_id"), F.col("label"), x.cast("array<double>" if vectors.schema["embedding"].dataType.elementType.simpleString() != "float" else "array<float>").alias("embedding"))
    fine = F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    valid, rest = rows.where(fine), rows.where(~fine)
    points = checkpointed(valid.groupBy("label", "embedding").agg(F.count("*").alias("w"), F.min("vec_id").alias("least")).withColumn("pid", F.monotonically_increasing_id()))
    n = points.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    found, edges = links(points, n, cosine)
    roots = connected_components(edges).withColumnRenamed("node", "pid")
    told = points.join(found, "pid", "left").join(roots, "pid", "left").select("label", "embedding", "w", "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "pid").alias("root"))
    told = checkpointed(told)
    smallest = told.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    told = checkpointed(hot_joined(told, smallest, ["root"], "m", told.count()))
    columns = ("vec_id", "n_links", "component_id")
    out = told.where("w = 1").select(F.col("least").alias("vec_id"), *columns[1:])
    copies = told.where("w > 1")
    if not copies.isEmpty():
        out = out.unionByName(hot_joined(valid, copies, ["label", "embedding"], "w", valid.count()).select(*columns))
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
component AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(counted.n, 0) AS n_links, least(e.vec_id, coalesce(component.least, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(component.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN component ON component.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
"""
