"""Embedding near-dedup: inverted lists with product-quantised residuals.

Coarse centroids and the codebooks of residual subspaces are fitted on a bounded sample; every
vector is indexed. A vector goes to the list of its nearest centroid with one code a subspace and
its quantisation error; as a query it probes the lists of its PROBES nearest centroids. In a list
the distances from query to codes are sums of looked-up entries (asymmetric: the query itself is
not quantised). By the triangle inequality a vector within distance r of the query has its code
within r plus its own error, so no neighbour in a probed list is lost here; what remains is
reranked by exact cosine in double precision.

Equal vectors are one class from the start. Lists are cut into pieces, and so are their queries:
a task never holds a list or its queries whole, however many vectors crowd there. Tasks send no
pairs, only sums of links for each vector and the edges of a spanning forest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm import common as c

THRESHOLD = 0.9
#: The index is fitted on at most so many vectors (those of the least hash) and so many floats.
SAMPLE, SAMPLE_FLOATS = 32_768, 8_000_000
PROBES = 12
SUBSPACE, CODES = 4, 64
#: Vectors of a list, and queries to it, that meet in one task.
PIECE, QUERIES = 2048, 8192
MAX_LISTS = 4096


# ---------------------------------------------------------------- index
def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from k rows of x; an empty cell takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near, gap = nearest(x, centres, 1)
        near, gap = near[:, 0], gap[:, 0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        sums[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        centres[full] = sums[full] / n[full, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-gap)[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int):
    """The k nearest centres of each row, nearest first, and the squared distances."""
    k = min(k, len(centres))
    norms = (centres**2).sum(axis=1)
    found, gaps = [], []
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        d = norms - 2 * part @ centres.T
        pick = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(part), 1))
        g = np.take_along_axis(d, pick, axis=1)
        order = np.argsort(g, axis=1, kind="stable")
        found.append(np.take_along_axis(pick, order, axis=1))
        gaps.append(np.take_along_axis(g, order, axis=1) + (part**2).sum(axis=1)[:, None])
    if not found:
        return np.zeros((0, k), np.int64), np.zeros((0, k))
    return np.concatenate(found), np.concatenate(gaps)


class Index:
    """Centroids and codebooks; small, of a size that does not depend on the number of vectors
    beyond MAX_LISTS."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        self.dim = sample.shape[1]
        self.centres = kmeans(sample, n_lists, 6, 1)
        own, _ = nearest(sample, self.centres, 1)
        rest = sample - self.centres[own[:, 0]]
        self.cuts = list(range(0, self.dim, SUBSPACE))
        self.books = [kmeans(np.ascontiguousarray(rest[:, a : a + SUBSPACE]), CODES, 6, 2 + a) for a in self.cuts]

    def encode(self, x: np.ndarray, lists: np.ndarray):
        """Codes of the residuals and the distances between vectors and what their codes stand for."""
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        error = np.zeros(len(x))
        for j, a in enumerate(self.cuts):
            near, gap = nearest(np.ascontiguousarray(rest[:, a : a + SUBSPACE]), self.books[j], 1)
            codes[:, j] = near[:, 0]
            error += np.maximum(gap[:, 0], 0)
        return codes, np.sqrt(error)

    def distances(self, queries: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances by table look-up, queries by codes."""
        rest = queries - self.centres[list_id]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for j, a in enumerate(self.cuts):
            table = ((rest[:, None, a : a + SUBSPACE] - self.books[j][None]) ** 2).sum(axis=2)
            out += table[:, codes[:, j]]
        return out


def fit(classes: DataFrame, n: int) -> Index | None:
    first = classes.select("vec").first()
    if first is None:
        return None
    dim = len(first["vec"]) // 8
    size = max(256, min(SAMPLE, SAMPLE_FLOATS // dim))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(size).select("vec").collect()
    sample = np.frombuffer(b"".join(bytes(r["vec"]) for r in rows)).reshape(len(rows), dim).astype(np.float32)
    return Index(sample, int(min(MAX_LISTS, max(1, 4 * n**0.5), max(1, len(rows) // 8))))


# ---------------------------------------------------------------- operator
def units(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, key (digest of the numbers; null: links with nothing),
    vec (unit vector, doubles)."""

    def run(batches):
        for batch in batches:
            keys, vecs = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                norm = float(np.sqrt((x / s) @ (x / s))) * s if len(x) and np.isfinite(x).all() and (s := float(np.abs(x).max())) > 0 else 0.0
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if norm else None)
                vecs.append((x / s / (norm / s)).tobytes() if norm else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "key", "vec"])

    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").mapInArrow(run, "vec_id long, key binary, vec binary")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """vectors (vec_id, embedding, more) -> vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do
    those without a vec_id (their component is their own vec_id). Vectors of different lengths do not
    link; each length has an index of its own. Rows repeated with their vec_id count as one vector and keep their rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0, at most 1")
    own = c.materialize(units(vectors))
    usable = own.where("key is not null and vec_id is not null")
    classes = c.materialize(usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.min("vec").alias("vec")))
    found = None
    for length, n in sorted(tuple(r) for r in classes.groupBy(F.length("vec")).count().collect()):  # a row a length
        links = _linked(classes.where(F.length("vec") == length), n, threshold, probes)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = c.components(found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("key", "rep", "n").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = own.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _linked(classes: DataFrame, n: int, threshold: float, probes: int) -> DataFrame:
    """The n classes (rep, n, vec) of one length -> rows rep, links, root: links found, and by root the
    edges of a forest that joins what is linked."""
    spark = classes.sparkSession
    index = fit(classes, n)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def place(batches):
        for batch in batches:
            reps, ns, vecs = (batch.column(k) for k in range(3))
            raw = vecs.to_pylist()
            if not raw:
                continue
            x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
            near, _ = nearest(x.astype(np.float32), index.centres, probes)
            codes, error = index.encode(x, near[:, 0])
            packed = [near[k].astype(np.int32).tobytes() for k in range(len(raw))]
            yield pa.RecordBatch.from_arrays(
                [reps, ns, vecs, pa.array(near[:, 0].astype(np.int32)), pa.array(packed, pa.binary()), pa.array([codes[k].tobytes() for k in range(len(raw))], pa.binary()), pa.array(error), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))],
                ["rep", "n", "vec", "list", "probes", "code", "error", "probed"],
            )

    placed = c.materialize(classes.select("rep", "n", "vec").mapInArrow(place, "rep long, n long, vec binary, list int, probes binary, code binary, error double, probed array<int>"))
    # at most MAX_LISTS rows each
    held = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    asked = {r["p"]: r["count"] for r in placed.select(F.explode("probed").alias("p")).groupBy("p").count().collect()}
    rows = [(k, max(1, -(-held.get(k, 0) // PIECE)), max(1, -(-asked.get(k, 0) // QUERIES))) for k in sorted({*held, *asked}) if held.get(k)]
    cut = F.broadcast(spark.createDataFrame(rows, "list int, pieces int, turns int"))
    deal = F.pmod(F.xxhash64("rep"), F.lit(1 << 40))
    base = placed.join(cut, "list").select("list", (deal % F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "rep", "n", "vec", "probes", "code", "error")
    asks = placed.select("rep", "n", "vec", F.col("list").alias("home"), F.explode("probed").alias("list")).join(cut, "list")
    asks = asks.select(
        F.col("list").alias("q_list"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("q_piece"), (deal % F.col("turns")).cast("int").alias("q_turn"),
        F.col("rep").alias("q_rep"), F.col("n").alias("q_n"), F.col("vec").alias("q_vec"), "home",
    )

    def meet(key, left, right):
        out = {"rep": [], "links": [], "root": []}
        if left.num_rows and right.num_rows:
            list_id = key[0].as_py()
            b_rep, b_n = left.column("rep").to_numpy(), left.column("n").to_numpy()
            q_rep, q_n = right.column("q_rep").to_numpy(), right.column("q_n").to_numpy()
            b_vec, q_vec = (np.frombuffer(b"".join(v.to_pylist())).reshape(len(v), -1) for v in (left.column("vec"), right.column("q_vec")))
            b_probes = np.frombuffer(b"".join(left.column("probes").to_pylist()), np.int32).reshape(left.num_rows, -1)
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            within = (reach + left.column("error").to_numpy()).astype(np.float32) ** 2 * np.float32(1 + 1e-5)
            home = right.column("home").to_numpy()
            b_links, q_links = np.zeros(len(b_rep), np.int64), np.zeros(len(q_rep), np.int64)
            edges = []
            for at in range(0, len(q_rep), 512):
                d = index.distances(q_vec[at : at + 512].astype(np.float32), list_id, codes)
                q, b = np.nonzero(d <= within)
                q += at
                # a pair that meets both ways counts where the query has the smaller id
                both = (b_probes[b] == home[q][:, None]).any(axis=1)
                ok = (q_rep[q] != b_rep[b]) & (~both | (q_rep[q] < b_rep[b]))
                q, b = q[ok], b[ok]
                for part in range(0, len(q), 1 << 16):
                    qq, bb = q[part : part + (1 << 16)], b[part : part + (1 << 16)]
                    ok = np.einsum("ij,ij->i", q_vec[qq], b_vec[bb]) >= threshold
                    qq, bb = qq[ok], bb[ok]
                    np.add.at(q_links, qq, b_n[bb])
                    np.add.at(b_links, bb, q_n[qq])
                    edges.append(np.stack([q_rep[qq], b_rep[bb]], axis=1))
            low, high = forest(np.concatenate(edges) if edges else np.zeros((0, 2), np.int64))
            out["rep"] = [*b_rep[b_links > 0], *q_rep[q_links > 0], *high]
            out["links"] = [*b_links[b_links > 0], *q_links[q_links > 0], *([0] * len(high))]
            out["root"] = [*([None] * int((b_links > 0).sum() + (q_links > 0).sum())), *low]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return c.materialize(base.groupBy("list", "piece", "turn").cogroup(asks.groupBy("q_list", "q_piece", "q_turn")).applyInArrow(meet, "rep long, links long, root long"))


def forest(edges: np.ndarray):
    """Each node of the edges (other than a smallest one) and the smallest node of its component."""
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        for side in (0, 1):
            np.minimum.at(new, label[at[:, side]], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.9 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
