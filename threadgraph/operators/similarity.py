"""Vector similarity joins, similarity-based connections and propagation.

Vector tables: graph_id, id, vec (array<double>).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadgraph.functions.lexicons import CONNECTION_TERMS
from threadgraph.functions.text import stable_id
from threadgraph.functions.vectors import dimension, vec_add, vec_cosine, vec_unit, weighted_sum
from threadgraph.operators.common import first_by, top_k
from threadgraph.operators.graph import simple_edges
from threadgraph.session import materialize

#: Rows of a block on either side, most leaves of a pivot tree (their vectors go to every task), rows sampled for a leaf, room for rounding in angles.
BLOCK_ROWS, MAX_LEAVES, SAMPLE, SLACK = 4096, 4096, 4, 1e-6
#: Numbers of a product that are held at once: rows are multiplied strip by strip.
STRIP = 2**20


def _unit_rows(vecs: pd.Series) -> np.ndarray:
    m = np.array(vecs.tolist(), dtype=np.float64)
    if m.ndim == 1:
        m = m.reshape(len(vecs), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _spread(m: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of a sample, each the one farthest from those before it; fewer if the others repeat them."""
    picked, near = [0], m @ m[0]
    while len(picked) < min(n, len(m)):
        nxt = int(np.argmin(near))
        if near[nxt] > 1 - 1e-12:
            break
        picked.append(nxt)
        near = np.maximum(near, m @ m[nxt])
    return m[picked]


def _strips(n: int, width: int) -> Iterator[slice]:
    """Consecutive rows whose products with ``width`` columns make a strip."""
    step = max(1, STRIP // max(1, width))
    return (slice(i, i + step) for i in range(0, n, step))


def _best(s: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """``ok``, cut to the ``k`` highest of each row; of equal ones the first."""
    n = ok.sum(axis=1)
    many = np.flatnonzero(n > k)
    if n.sum() * 8 < ok.size:  # few: ordered one by one
        i, j = np.nonzero(ok)
        order = np.lexsort((j, -s[i, j], i))
        over = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) >= k]
        ok[i[over], j[over]] = False
    elif len(many):
        x = np.where(ok[many], -np.nan_to_num(s[many], nan=-3.0), 2.0)
        last = np.partition(x, k - 1, axis=1)[:, k - 1:k]
        above, same = x < last, x == last
        same &= np.cumsum(same, axis=1) <= k - above.sum(axis=1, keepdims=True)
        ok[many] &= above | same
    return ok


class PivotTree:
    """Two levels of pivots over the right side of a similarity join.

    About sqrt(n) leaves, each with the range of angles of its rows to its pivot, hang under
    n / ``BLOCK_ROWS`` cells. Pivots are rows of a bounded sample, each as far as can be from
    those before; they decide speed, not results. Rows are joined cell by cell, leaves decide which cells a row must
    visit: by the triangle inequality on angles a row at angle b to a leaf's pivot has no
    row there nearer than max(b - hi, lo - b). A visit copies a row once per cell, never
    once per leaf, so rows that cannot be excluded anywhere cost n / ``BLOCK_ROWS`` copies.
    """

    def __init__(self, pivots: np.ndarray, n_cells: int):
        self.pivots, self.n_cells = pivots, n_cells
        self.cell_of = np.argmax(np.round(pivots @ pivots[:n_cells].T, 12), axis=1)
        self.lo, self.hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    @classmethod
    def fit(cls, right: DataFrame) -> tuple[PivotTree | None, DataFrame]:
        """The tree, and ``right`` with its ``cell``. None where the right side is empty. Runs Spark jobs."""
        n = right.groupBy("graph_id").count().agg(F.max("count")).first()[0]
        if not n:
            return None, right
        cells = -(-n // BLOCK_ROWS)
        leaves = min(MAX_LEAVES, max(cells, math.isqrt(n))) if cells > 1 else 1
        # written first: a collected limit would send every task's candidates to the driver
        sample = materialize(right.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * leaves).select("vec")).collect()
        pivots = _spread(_unit_rows(pd.Series([r["vec"] for r in sample])), leaves)
        tree = cls(pivots, min(cells, len(pivots)))
        if tree.n_cells == 1:
            return tree, right.withColumn("cell", F.lit(0))
        placed = right.withColumn("_at", tree.leaf()("vec")).withColumn("cell", F.col("_at.cell"))
        placed = materialize(placed)
        for r in placed.groupBy("_at.leaf").agg(F.min("_at.angle").alias("lo"), F.max("_at.angle").alias("hi")).collect():
            tree.lo[r["leaf"]], tree.hi[r["leaf"]] = r["lo"], r["hi"]
        return tree, placed.drop("_at")

    def leaf(self):
        """Column function: leaf, cell and angle to the leaf's pivot of a vector."""
        tree = self

        @F.pandas_udf("leaf int, cell int, angle double")
        def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vecs in parts:
                if len(vecs) == 0:
                    yield pd.DataFrame({"leaf": [], "cell": [], "angle": []})
                    continue
                m = _unit_rows(vecs)
                at = np.concatenate([np.argmax(m[x] @ tree.pivots.T, axis=1) for x in _strips(len(m), len(tree.pivots))])
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", m, tree.pivots[at]), -1.0, 1.0))
                yield pd.DataFrame({"leaf": at, "cell": tree.cell_of[at], "angle": angle})
        return place

    def visits(self):
        """Column function: cells that may hold a row with at least the given cosine (null: any)."""
        tree = self
        by_cell = np.argsort(tree.cell_of, kind="stable")
        named, begin = np.unique(tree.cell_of[by_cell], return_index=True)
        named = named.astype(np.int32)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def cells(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for vecs, least in parts:
                if len(vecs) == 0:
                    yield pd.Series([], dtype=object)
                    continue
                m, out = _unit_rows(vecs), []
                reach = np.arccos(np.clip(least.fillna(-1.0).to_numpy(np.float64), -1.0, 1.0))
                for x in _strips(len(m), len(tree.pivots)):
                    b = np.arccos(np.clip(m[x] @ tree.pivots.T, -1.0, 1.0))
                    near = np.maximum(0.0, np.maximum(b - tree.hi, tree.lo - b)) <= reach[x, None] + SLACK
                    out += [named[c] for c in np.logical_or.reduceat(near[:, by_cell], begin, axis=1)]
                yield pd.Series(out)
        return cells


PAIR_SCHEMA = "graph_id string, left_id string, right_id string, similarity double"


def _joined_cells(left: DataFrame, right: DataFrame, threshold: float | None, k: int | None, keep_self: bool) -> DataFrame:
    """Pairs of rows of one graph and cell; cells larger than a block, on either side, are split by hash. Runs Spark jobs."""
    def block(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"graph_id": [], "left_id": [], "right_id": [], "similarity": []})
        b = b.sort_values("id", kind="stable")
        m, right_t = _unit_rows(a["vec"]), _unit_rows(b["vec"]).T
        aid, bid = a["id"].to_numpy(), b["id"].to_numpy()
        found = []
        for x in _strips(len(m), len(bid)):
            s = m[x] @ right_t
            if threshold is None:
                s = np.round(s, 9)
                ok = np.ones_like(s, dtype=bool)
            else:  # the few that may reach the threshold are rounded
                i, j = np.nonzero(s >= threshold - SLACK)
                v = np.round(s[i, j], 9)
                s, ok = np.full(s.shape, -2.0), np.zeros(s.shape, dtype=bool)
                s[i, j], ok[i, j] = v, v >= threshold
            if not keep_self:
                ok &= aid[x, None] != bid[None, :]
            if k is not None:
                ok = _best(s, ok, k)
            i, j = np.nonzero(ok)
            found.append((i + x.start, j, s[i, j]))
        i, j, s = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"graph_id": key[0], "left_id": aid[i], "right_id": bid[j], "similarity": s})

    on = ["graph_id", "cell"]
    n = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    # written, so that its known size makes it the side that is broadcast, not the vectors
    parts = materialize(n(left, "nl").join(n(right, "nr"), on))
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keys = [*on, "lc", "rc"]
    lb = left.join(parts, on).withColumn("lc", mine("nl")).withColumn("rc", every("nr")).select(*keys, "id", "vec")
    rb = right.join(parts, on).withColumn("rc", mine("nr")).withColumn("lc", every("nl")).select(*keys, "id", "vec")
    # fresh column identities: both sides may stem from one table
    lb, rb = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (lb, rb))
    return lb.groupBy(*keys).cogroup(rb.groupBy(*keys)).applyInPandas(block, PAIR_SCHEMA)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float | None, k: int | None = None, keep_self: bool = False) -> DataFrame:
    """Exact pairs with cosine >= threshold, at most the ``k`` best per left row.

    With ``k`` there are two passes: a row first meets the cell it would itself belong to, and its k-th
    best there is the bound with which leaves rule out further cells, so calls without a
    threshold prune as well. A block keeps its own k best per left row, which always contain
    the overall k best. Similarities are rounded to 9 digits and ties go to the smaller
    right id. Fitting the tree runs Spark jobs while the plan is built.
    """
    left = left.select("graph_id", "id", "vec")
    tree, right = PivotTree.fit(right.select("graph_id", "id", "vec"))
    if tree is None:
        return left.limit(0).select("graph_id", F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(0.0).alias("similarity"))
    best = lambda pairs: pairs if k is None else top_k(pairs, ["graph_id", "left_id"], [F.col("similarity").desc(), F.col("right_id")], k)
    if tree.n_cells == 1:
        return best(_joined_cells(left.withColumn("cell", F.lit(0)), right, threshold, k, keep_self))
    least = F.lit(threshold).cast("double")
    if k is None:
        return _joined_cells(left.withColumn("cell", F.explode(tree.visits()("vec", least))), right, threshold, k, keep_self)
    home = materialize(left.withColumn("cell", tree.leaf()("vec")["cell"]))
    first = materialize(best(_joined_cells(home, right, threshold, k, keep_self)))
    bound = first.groupBy("graph_id", F.col("left_id").alias("id")).agg(F.min("similarity").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    more = home.join(bound, ["graph_id", "id"], "left").withColumn("seen", F.col("cell"))
    more = more.withColumn("cell", F.explode(tree.visits()("vec", F.greatest("kth", least)))).filter("cell <> seen")
    return best(first.unionByName(_joined_cells(more.select("graph_id", "id", "vec", "cell"), right, threshold, k, keep_self)))


def max_similarity(users: DataFrame, nodes: DataFrame) -> DataFrame:
    """Highest cosine of every node to any user vector: the node's nearest user."""
    return similar_pairs(nodes, users, None, 1, keep_self=True).select("graph_id", F.col("left_id").alias("id"), "similarity")


# --- connections ---------------------------------------------------------------------------

def similarity_connections(user: DataFrame, domain: DataFrame, threshold: float = 0.7, k: int = 15) -> DataFrame:
    """The ``k`` most similar user-domain pairs per graph as connection triples."""
    pairs = similar_pairs(user, domain, threshold, k, keep_self=True)
    best = top_k(pairs, ["graph_id"], [F.col("similarity").desc(), F.col("left_id"), F.col("right_id")], k, "rank")
    return best.select("graph_id", F.col("left_id").alias("subject_id"), F.lit("ns0__Is_similar_to").alias("predicate"),
                       F.col("right_id").alias("object_id"), F.lit("connection").alias("origin"), "similarity", F.col("rank").cast("long").alias("rank"))


def topk_similar(users: DataFrame, entities: DataFrame, k: int = 50, threshold: float = 0.6) -> DataFrame:
    """Nearest entities per user; the user itself takes one of the ``k`` places and is dropped."""
    near = similar_pairs(users, entities, threshold, k, keep_self=True).filter("left_id <> right_id")
    predicate = F.when(F.col("similarity") > 0.8, "ns0__Is_strongly_related_to").otherwise("ns0__Is_semantically_related_to")
    return near.select("graph_id", F.col("left_id").alias("subject_id"), predicate.alias("predicate"), F.col("right_id").alias("object_id"), "similarity")


def topk_per_level(users: DataFrame, entities: DataFrame, k: int = 2, threshold: float = 0.5, levels=("business", "system", "data", "technology")) -> DataFrame:
    """Nearest ``k`` entities per user and layer. Each (graph, layer) is joined as its own graph."""
    key = lambda layer: F.concat_ws("\u0001", F.col("graph_id"), layer)
    l = users.select("graph_id", "id", "vec", F.explode(F.array(*[F.lit(x) for x in levels])).alias("layer"))
    l = l.select(key(F.col("layer")).alias("graph_id"), "id", "vec")
    r = entities.filter(F.col("layer").isin(*levels)).select(key(F.col("layer")).alias("graph_id"), "id", "vec")
    pairs = similar_pairs(l, r, threshold, k)
    part = F.split("graph_id", "\u0001")
    return pairs.select(part[0].alias("graph_id"), F.col("left_id").alias("subject_id"), part[1].alias("layer"),
                        F.concat(F.lit("ns0__Is_implemented_by_"), part[1]).alias("predicate"), F.col("right_id").alias("object_id"), "similarity")


def topk_global(users: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    return top_k(max_similarity(users, nodes), ["graph_id"], [F.col("similarity").desc(), F.col("id")], n)


def prioritize(connections: DataFrame, n: int = 20, terms=CONNECTION_TERMS, order=("seq",), label: str = "object_label") -> DataFrame:
    """Connections to objects with a technical term first, then the others, first ``n`` per graph."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(label, F.lit(""))).contains(t) for t in terms])
    cols: list[Column] = [c if isinstance(c, Column) else F.col(c) for c in order]
    return top_k(connections, ["graph_id"], [F.when(hit, 0).otherwise(1), *cols], n)


def semantic_seeds(users: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities named like a user entity, else the best word overlap, else the first three, per graph.

    Words carry their graph, so user and entity only meet inside it.
    """
    from threadgraph.operators.joins import word_overlap_match

    exact = entities.join(users.select("graph_id", "label").distinct(), ["graph_id", "label"], "left_semi").withColumn("_o", F.lit(0))
    key = lambda c: F.concat_ws("\u0001", "graph_id", c)
    own = F.array_join(F.transform(F.filter(F.split("label", r"\s+"), lambda w: w != ""), lambda w: F.concat_ws("\u0001", "graph_id", w)), " ")
    overlap = word_overlap_match(users.select(key("label").alias("user_id"), own.alias("label")), entities.select(key("id").alias("entity_id"), own.alias("label")))
    near = overlap.select(F.split("entity_id", "\u0001")[0].alias("graph_id"), F.split("entity_id", "\u0001")[1].alias("id")).distinct()
    near = entities.join(near, ["graph_id", "id"], "left_semi").withColumn("_o", F.lit(1))
    first = top_k(entities, ["graph_id"], [F.col("id")], 3).withColumn("_o", F.lit(2))
    pool = exact.unionByName(near).unionByName(first)
    level = pool.groupBy("graph_id").agg(F.min("_o").alias("_o"))
    return pool.join(level, ["graph_id", "_o"]).drop("_o")


def semantic_connections(users: DataFrame, entities: DataFrame, threshold: float = 0.5, hops: int = 2, limit: int = 20, hop_k: int = 10) -> DataFrame:
    """First-hop neighbours of the users and, below them, neighbours of those neighbours.

    A second-hop row keeps the similarity of its closest first-hop parent; users and pairs
    already linked are skipped. Priority terms come first, ``limit`` rows per graph.
    """
    first = materialize(topk_similar(users, entities, 50, threshold).withColumn("hop", F.lit(1)))  # read by each step below
    out = first
    if hops > 1:
        targets = first.select("graph_id", F.col("object_id").alias("id")).distinct()
        t_vec = entities.join(targets, ["graph_id", "id"], "left_semi")
        second = similar_pairs(t_vec, entities, threshold - 0.2, hop_k, keep_self=True).filter("left_id <> right_id")
        via = first.select("graph_id", "subject_id", F.col("object_id").alias("left_id"), F.col("similarity").alias("s1"))
        far = second.join(via, ["graph_id", "left_id"]).groupBy("graph_id", "subject_id", F.col("right_id").alias("object_id")).agg(
            F.min_by("similarity", F.struct(-F.col("s1"), F.col("left_id"))).alias("similarity"))
        far = far.join(users.select("graph_id", F.col("id").alias("object_id")), ["graph_id", "object_id"], "left_anti")
        far = far.join(first.select("graph_id", "subject_id", "object_id"), ["graph_id", "subject_id", "object_id"], "left_anti")
        far = far.select("graph_id", "subject_id", F.lit("ns0__Is_indirectly_related_to").alias("predicate"), "object_id", "similarity", F.lit(2).alias("hop"))
        out = first.unionByName(far)
    labels = entities.select("graph_id", F.col("id").alias("object_id"), F.col("label").alias("object_label"))
    named = out.join(labels, ["graph_id", "object_id"])
    order = [F.col("hop"), F.col("subject_id"), F.col("similarity").desc(), F.col("object_id")]
    return prioritize(named, limit, order=order).withColumn("origin", F.lit("gnn"))


def ring_fallback(seeds: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """Graphs without connections and with more than three entities: the first three seeds
    point to their next three entities in id order, wrapping around."""
    side = lambda df, entity: df.select("graph_id", "id", F.lit(entity).alias("entity"), F.lit(1 - entity).alias("seed"))
    rows = side(entities, 1).unionByName(side(seeds, 0)).groupBy("graph_id", "id").agg(F.max("entity").alias("entity"), F.max("seed").alias("seed"))
    rows = rows.filter(F.col("graph_id").isNotNull()).join(found.select("graph_id").distinct(), "graph_id", "left_anti")
    # one pass in id order: places among entities and among seeds, and the three entities after a row
    w = Window.partitionBy("graph_id").orderBy("id")
    place = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = [F.expr(f"lead(CASE WHEN entity = 1 THEN id END, {i}) IGNORE NULLS OVER (PARTITION BY graph_id ORDER BY id)") for i in (1, 2, 3)]
    rows = rows.withColumns({"at": place("entity"), "nth": place("seed"), "next": F.filter(F.array(*after), lambda c: c.isNotNull())})
    head = F.when((F.col("entity") == 1) & (F.col("at") <= 4), F.struct((F.col("at") + 3).alias("o"), F.col("id").alias("cand")))
    first = F.when((F.col("seed") == 1) & (F.col("nth") <= 3) & F.col("id").isNotNull(), F.struct("id", "next"))
    both = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(head)).alias("head"), F.collect_list(first).alias("first")).filter(F.size("head") > 3)
    both = both.select("graph_id", "head", F.explode("first").alias("s")).select("graph_id", F.col("s.id").alias("seed"), F.col("s.next").alias("next"), "head")
    wrap = F.filter(F.transform("head", lambda h: h["cand"]), lambda c: (c != F.col("seed")) & ~F.array_contains("next", c))
    pick = both.select("graph_id", "seed", F.explode(F.slice(F.concat("next", wrap), 1, 3)).alias("cand"))
    return pick.select("graph_id", F.col("seed").alias("subject_id"), F.lit("ns0__Is_related_to").alias("predicate"), F.col("cand").alias("object_id"),
                       F.lit("gnn").alias("origin"), F.lit(0.7).alias("similarity"))


def seed_community_links(seeds: DataFrame, entities: DataFrame, links: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` entities nearest to the mean seed vector, linked pairwise.

    An existing link gives its predicate, otherwise the pair is "related".
    """
    dim = dimension(entities)
    mean = weighted_sum(seeds, ["graph_id"], dim).withColumnRenamed("vec", "center")
    near = entities.join(mean, "graph_id").withColumn("similarity", F.round(vec_cosine(F.col("vec"), F.col("center")), 9))
    best = top_k(near, ["graph_id"], [F.col("similarity").desc(), F.col("id")], n, "rn").select("graph_id", "id", "rn")
    listed = best.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("b"))
    i = listed.select("graph_id", "b", F.explode("b").alias("x"))
    pairs = i.select("graph_id", "x", F.explode("b").alias("y")).filter("x.rn < y.rn").select(
        "graph_id", F.col("x.id").alias("source"), F.col("y.id").alias("target"))
    known = first_by(links.select("graph_id", "source", "target", F.col("label").alias("known")), ["graph_id", "source", "target"], ["known"])
    return pairs.join(known, ["graph_id", "source", "target"], "left").select(
        "graph_id", F.col("source").alias("subject_id"), F.coalesce("known", F.lit("ns0__Is_related_to")).alias("predicate"),
        F.col("target").alias("object_id"), F.lit("gnn").alias("origin"))


# --- layers by prototype -------------------------------------------------------------------

def layer_prototypes(vectors: DataFrame, layer: str = "layer") -> DataFrame:
    """Mean vector per layer; a handful of rows per graph."""
    return weighted_sum(vectors, ["graph_id", layer], dimension(vectors))


def layer_by_prototype(entities: DataFrame, prototypes: DataFrame, layer: str = "layer") -> DataFrame:
    """Layer with the most similar prototype; "other" for entities without a vector."""
    protos = prototypes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col(layer).alias("name"), F.col("vec").alias("pvec")))).alias("ps"))
    scored = entities.join(protos, "graph_id", "left").withColumn("best", F.array_max(F.transform(
        F.reverse("ps"), lambda p: F.struct(F.round(vec_cosine(F.col("vec"), p["pvec"]), 9).alias("s"), p["name"].alias("n")))))
    return scored.withColumn("layer_found", F.when(F.col("vec").isNull() | F.col("best").isNull(), "other").otherwise(F.col("best.n"))).drop("ps", "best")


# --- propagation ---------------------------------------------------------------------------

def propagate(vectors: DataFrame, links: DataFrame, rounds: int = 3) -> DataFrame:
    """h <- unit(h + mean of out-neighbours), ``rounds`` times."""
    dim = dimension(vectors)
    pairs = links.select("graph_id", "source", "target").distinct()
    h = vectors.select("graph_id", "id", "vec")
    for _ in range(rounds):
        near = pairs.join(h.select("graph_id", F.col("id").alias("target"), "vec"), ["graph_id", "target"])
        mean = weighted_sum(near, ["graph_id", "source"], dim).select("graph_id", F.col("source").alias("id"), F.col("vec").alias("m"))
        zero = F.array_repeat(F.lit(0.0), dim)
        h = h.join(mean, ["graph_id", "id"], "left").select("graph_id", "id", vec_unit(vec_add(F.col("vec"), F.coalesce("m", zero))).alias("vec"))
        h = materialize(h)  # each round reads the last one twice
    return h


def graph_conv_embed(vectors: DataFrame, links: DataFrame, rounds: int = 1) -> DataFrame:
    """Parameter-free graph convolution: D^-1/2 (A + I) D^-1/2 h plus residual, unit length."""
    dim = dimension(vectors)
    edges = simple_edges(links).filter("a <> b")
    loops = vectors.select("graph_id", F.col("id").alias("node"), F.col("id").alias("nbr"))
    adj = edges.select("graph_id", F.col("a").alias("node"), F.col("b").alias("nbr")).unionByName(
        edges.select("graph_id", F.col("b").alias("node"), F.col("a").alias("nbr"))).unionByName(loops)
    deg = adj.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("k"))
    adj = adj.join(deg, ["graph_id", "node"]).join(deg.select("graph_id", F.col("node").alias("nbr"), F.col("k").alias("kn")), ["graph_id", "nbr"])
    adj = adj.select("graph_id", "node", "nbr", (1.0 / F.sqrt((F.col("k") * F.col("kn")).cast("double"))).alias("w"))
    h = vectors.select("graph_id", "id", "vec")
    for _ in range(rounds):
        near = adj.join(h.select("graph_id", F.col("id").alias("nbr"), "vec"), ["graph_id", "nbr"])
        agg = weighted_sum(near, ["graph_id", "node"], dim, weight=F.col("w"), mean=False).select("graph_id", F.col("node").alias("id"), F.col("vec").alias("m"))
        h = h.join(agg, ["graph_id", "id"]).select("graph_id", "id", vec_unit(vec_add(F.col("vec"), F.col("m"))).alias("vec"))
    return h


def connection_ids(connections: DataFrame) -> DataFrame:
    """Stable ids from labels for both ends of a connection."""
    return connections.withColumns({
        "subject_id": stable_id(F.col("subject_label"), "user"), "object_id": stable_id(F.col("object_label"), "entity")})
