"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors with equal label, dimension and components are one node with a multiplicity.
Each label's nodes are dealt to overlapping cluster shards: a node lives at its nearest
pivot and also joins every pivot that is nearly as near. A shard of more than BLOCK_ROWS
nodes falls into row blocks by hash. A block builds a flat graph: each node keeps
robust-pruned links to its nearest block members, and a hub's list is thinned to WIDTH.
The adjacency lists of a node from all its shards are united. Every node is then searched
in each block of its home shard: a greedy beam search over the united lists from the
block's medoid and, in its own block, the node itself, which widens to every node within
the threshold of the query and to their neighbours until no further one is found. Where
the next widening would read more vectors than the block holds, the query is compared
with the whole block instead. Every link is verified by its cosine in double precision.

A sampled recall audit compares each label's link counts with brute force over its rows;
where it falls short, shards overlap more and beams widen. Labels that still fall short
after the last effort are compared exactly: with twice the threshold distance as margin a
node's home shard holds all its neighbours, so each node is compared with its whole shard.
A label that the audit accepts may still lack up to 1 % of its links.

Links are counted in the task, and counts of a node are summed over blocks; only stars of
linked nodes leave a task, so a large group never emits its pairs. A task holds one block
and at most about QUERY_ROWS queries, whatever the size of a cluster. A cluster of n nodes
that are all alike still costs n x n / (BLOCK_ROWS x QUERY_ROWS) tasks: the count of each
node's links asks for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm.common import connected_components, hash_bucket, table
from evalspark.llm.vectors import as_doubles, matrix, unit
from evalspark.session import cut_lineage

THRESHOLD = 0.98
#: Nodes of a block, and queries that one task searches in it.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Nodes per pivot (a shard fills a block: more and smaller shards would copy a node to more of them),
#: and pivots per label at most; pivots more alike than APART are one.
PER_PIVOT, MAX_PIVOTS, APART = BLOCK_ROWS, 512, 0.9
#: Vectors that one task deals out.
DEAL_ROWS = 8192
#: Out-links of a node, candidates for them, pruning factor, and the longest adjacency list in a block.
DEGREE, CANDIDATES, ALPHA, WIDTH = 16, 32, 1.2, 64
#: (overlap as a share of the threshold distance, beam width), tried until the audit is content, and the exact way after them.
EFFORTS = ((0.75, 32), (1.25, 64), (2.0, 128))
EXACT = (2.0, None)
#: Nodes that each label's audit draws, and as many of its linked nodes.
AUDIT_ROWS, AUDIT_RECALL = 256, 0.99

GROUP = ["label", "dim"]


def with_group(nodes: DataFrame, columns: str) -> str:
    """Schema of the group's columns, the label in its own type, and ``columns``."""
    return f"label {nodes.schema['label'].dataType.simpleString()}, dim int, {columns}"


def collapse(vectors: DataFrame) -> DataFrame:
    """One node per distinct usable vector of a label: smallest vec_id, copies."""
    return (vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()).groupBy("label", "dim", "vec")
            .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
            .select("label", "dim", "vec_id", "vec", "copies"))


def choose_pivots(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(label, dim, pivot, vec)``: hash-sampled nodes of each label, at most MAX_PIVOTS on average, thinned to differ."""
    chance = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = nodes.join(sizes, GROUP).withColumn("u", chance)
    first = drawn.groupBy(*GROUP).agg(F.min("u").alias("u0"))
    wanted = F.least(F.ceil(F.col("n") / PER_PIVOT), F.lit(MAX_PIVOTS)) / F.col("n")
    drawn = drawn.join(first, GROUP).where((F.col("u") < wanted) | (F.col("u") == F.col("u0")))

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "vec_id"])
        x = unit(matrix(pdf["vec"]))
        near, keep = x @ x.T >= APART, []
        for i in range(len(x)):
            if not near[i, keep].any():
                keep.append(i)
        out = pdf.iloc[keep]
        return pd.DataFrame({"label": out["label"], "dim": out["dim"], "pivot": range(len(keep)), "vec": out["vec"]})

    return drawn.select("label", "dim", "vec_id", "vec", "u").groupBy(*GROUP).applyInPandas(
        thin, with_group(nodes, "pivot int, vec array<double>"))


def deal(nodes: DataFrame, sizes: DataFrame, pivots: DataFrame, overlap: float, threshold: float) -> DataFrame:
    """Nodes per shard: ``(label, dim, pivot, home, vec_id, vec, copies)``."""
    margin = overlap * float(np.sqrt(2 - 2 * threshold))
    salts = F.ceil(F.col("n") / DEAL_ROWS)
    left = nodes.join(sizes, GROUP).withColumn("salt", hash_bucket(salts, F.lit(9), F.col("vec_id"))).drop("n")
    right = pivots.join(sizes, GROUP).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")

    def place(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(points):
            return pd.DataFrame(columns=["label", "dim", "pivot", "home", "vec_id", "vec", "copies"])
        pivots = pivots.sort_values("pivot")
        sims = unit(matrix(points["vec"])) @ unit(matrix(pivots["vec"])).T
        home = sims.argmax(axis=1)
        row, col = np.nonzero(sims >= sims.max(axis=1, keepdims=True) - margin)
        out = points.iloc[row][["label", "dim", "vec_id", "vec", "copies"]].copy()
        out["pivot"], out["home"] = pivots["pivot"].to_numpy()[col], home[row] == col
        return out[["label", "dim", "pivot", "home", "vec_id", "vec", "copies"]]

    return (left.groupBy(*GROUP, "salt").cogroup(right.groupBy(*GROUP, "salt"))
            .applyInPandas(place, with_group(nodes, "pivot int, home boolean, vec_id long, vec array<double>, copies long")))


def robust_prune(x: np.ndarray) -> np.ndarray:
    """Out-links of every row of unit vectors ``x``: indices [rows, DEGREE], -1 where fewer.

    The nearest candidate is kept; candidates that are ALPHA times nearer to a kept one
    than to the node are dropped; and so on.
    """
    n = len(x)
    k = min(CANDIDATES, n - 1)
    links = np.full((n, DEGREE), -1, np.int64)
    for a in range(0, n, 256) if k > 0 else ():
        sims = x[a:a + 256] @ x.T
        rows = np.arange(len(sims))
        sims[rows, a + rows] = -np.inf
        cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, cand, 1)))
        among = x[cand]
        mutual = np.sqrt(np.maximum(0, 2 - 2 * (among @ among.transpose(0, 2, 1))))
        alive = np.ones(cand.shape, bool)
        for slot in range(DEGREE):
            left = alive.any(axis=1)
            if not left.any():
                break
            pick = alive.argmax(axis=1)
            links[a + rows[left], slot] = cand[rows, pick][left]
            alive &= ALPHA * mutual[rows, pick] > far
            alive[rows, pick] = False
    return links


def thinned(x: np.ndarray, node: int, nbrs: np.ndarray) -> np.ndarray:
    """At most WIDTH of a node's neighbours: the nearest, and further ones evenly over the rest."""
    if len(nbrs) <= WIDTH:
        return nbrs
    order = nbrs[np.argsort(-(x[nbrs] @ x[node]), kind="stable")]
    far = order[WIDTH // 2:]
    return np.r_[order[:WIDTH // 2], far[np.linspace(0, len(far) - 1, WIDTH - WIDTH // 2).astype(np.int64)]]


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of one block's graph: out-links and their reverse, a row a node."""
    ids, x = pdf["vec_id"].to_numpy(), unit(matrix(pdf["vec"]))
    links = robust_prune(x)
    row, col = np.nonzero(links >= 0)
    to = links[row, col]
    key = np.unique(np.r_[row * len(x) + to, to * len(x) + row])
    node, nbr = key // len(x), key % len(x)
    lists = np.split(nbr, np.searchsorted(node, np.arange(1, len(x))))
    return pd.DataFrame({"node": ids, "nbrs": [ids[thinned(x, i, v)] for i, v in enumerate(lists)]})


def search(x: np.ndarray, adjacency: np.ndarray, member: np.ndarray, queries: np.ndarray, start: int, beam: int,
           threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, members found within the threshold and itself) by range-expanding greedy search.

    ``x`` unit vectors, ``adjacency`` [rows, width] padded with -1, ``member`` whether a row
    belongs to the block or is a guest, a query from elsewhere that no list names.
    """
    n, width = adjacency.shape
    block = max(1, min(256, (64 << 20) // max(1, n)))
    for a in range(0, len(queries), block):
        q = queries[a:a + block]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        seen[rows, q] = seen[rows, start] = True
        inside = np.zeros((len(q), n), bool)
        nodes = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf)
        open_ = np.zeros((len(q), beam), bool)
        nodes[:, 0], sims[:, 0], open_[:, 0] = q, (x[q] * x[q]).sum(axis=1), True
        if beam > 1:
            other = q != start
            nodes[other, 1], sims[other, 1] = start, (x[q] @ x[start])[other]
            open_[other, 1] = True
        inside[rows, q] = True
        inside[rows, start] |= x[q] @ x[start] >= threshold
        done = np.zeros((len(q), n), bool)
        while True:  # greedy: the nearest node of the beam whose neighbours are unseen
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                break
            at = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
            node = nodes[live, at]
            open_[live, at] = False
            done[live, node] = True
            near = adjacency[node]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(fresh, near, q[live][:, None])] = True
            got = np.where(fresh, np.einsum("ij,ikj->ik", x[q[live]], x[near]), -np.inf)
            r, c = np.nonzero(got >= threshold)
            inside[live[r], near[r, c]] = True
            all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], got], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            nodes[live], sims[live] = np.take_along_axis(all_nodes, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)
        while True:  # range expansion: every node inside the threshold opens its neighbours
            r, c = np.nonzero(inside & ~done)
            if not len(r):
                break
            done[r, c] = True
            wide = np.bincount(r, minlength=len(q)) * width >= n  # reading on costs more than the whole block
            if wide.any():
                inside[wide] |= (x[q[wide]] @ x.T >= threshold) & member
                done[wide] = True
                r, c = r[~wide[r]], c[~wide[r]]
            for b in range(0, len(r), 20_000):
                near = adjacency[c[b:b + 20_000]]
                who = np.broadcast_to(r[b:b + 20_000, None], near.shape)
                fresh = (near >= 0) & ~seen[who, near]
                key = np.unique(who[fresh] * n + near[fresh])
                who, near = key // n, key % n
                seen[who, near] = True
                hit = np.einsum("ij,ij->i", x[q[who]], x[near]) >= threshold
                inside[who[hit], near[hit]] = True
        for k in rows:
            yield int(q[k]), np.flatnonzero(inside[k])


def compare_all(x: np.ndarray, member: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """As ``search``, by comparing every query with every member."""
    block = max(1, min(256, (8 << 20) // max(1, len(x))))
    for a in range(0, len(queries), block):
        q = queries[a:a + block]
        near = (x[q] @ x.T >= threshold) & member
        near[np.arange(len(q)), q] = True
        for k in range(len(q)):
            yield int(q[k]), np.flatnonzero(near[k])


def adjacency_of(x: np.ndarray, ids: np.ndarray, lists: pd.Series) -> np.ndarray:
    """Neighbours of every row within the rows, thinned to WIDTH and padded with -1; ``ids`` ascend."""
    rows = []
    for i, v in enumerate(lists):
        v = np.asarray(v if v is not None else [], np.int64)
        at = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
        rows.append(thinned(x, i, at[ids[at] == v]))
    adjacency = np.full((len(ids), max(1, max(map(len, rows)))), -1, np.int64)
    for i, v in enumerate(rows):
        adjacency[i, :len(v)] = v
    return adjacency


def link_nodes(nodes: DataFrame, overlap: float, beam: int | None, threshold: float) -> DataFrame:
    """``(label, dim, vec_id, n_links, other)``: searched nodes with their link count, and star edges with a null count.

    Without a beam nodes are compared with all of their home shard.
    """
    sizes = cut_lineage(nodes.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")))
    pivots = choose_pivots(nodes, sizes)
    members = cut_lineage(deal(nodes, sizes, pivots, overlap, threshold))
    shard = [*GROUP, "pivot"]
    shards = cut_lineage(members.groupBy(*shard).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"), F.ceil(F.count_if("home") / QUERY_ROWS).alias("turns")))
    placed = (members.join(shards, shard).withColumn("block", hash_bucket(F.col("blocks"), F.lit(7), F.col("vec_id")))
              .withColumn("own_turn", hash_bucket(F.greatest("turns", F.lit(1)), F.lit(3), F.col("vec_id"))))
    if beam is None:
        linked = placed.withColumn("nbrs", F.lit(None).cast("array<long>"))
    else:
        united = (placed.select(*shard, "block", "vec_id", "vec").groupBy(*shard, "block")
                  .applyInPandas(block_links, "node long, nbrs array<long>")
                  .groupBy("node").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs")))  # shards x WIDTH
        linked = placed.join(united, placed["vec_id"] == united["node"], "left")
    columns = [*shard, "block", "turn", "member", "asked", "vec_id", "vec", "copies", "nbrs"]
    held = (linked.where(F.col("turns") > 0).withColumn("member", F.lit(True))
            .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
            .withColumn("asked", F.col("home") & (F.col("own_turn") == F.col("turn"))).select(*columns))
    guests = (placed.where(F.col("home") & (F.col("blocks") > 1)).withColumn("member", F.lit(False)).withColumn("asked", F.lit(True))
              .withColumn("nbrs", F.lit(None).cast("array<long>")).withColumn("turn", F.col("own_turn")).withColumn("own", F.col("block"))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .where(F.col("block") != F.col("own")).select(*columns))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        ids, copies, member = pdf["vec_id"].to_numpy(), pdf["copies"].to_numpy(), pdf["member"].to_numpy(bool)
        asked = np.flatnonzero(pdf["asked"].to_numpy(bool))
        if not len(asked) or not member.any():
            return pd.DataFrame({"label": [], "dim": [], "vec_id": [], "n": [], "other": []})
        x = unit(matrix(pdf["vec"]))
        if beam is None:
            found = compare_all(x, member, asked, threshold)
        else:
            inner = np.flatnonzero(member)
            medoid = int(inner[(x[inner] @ x[inner].mean(axis=0)).argmax()])
            found = search(x, adjacency_of(x, ids, pdf["nbrs"]), member, asked, medoid, beam, threshold)
        root, searched, counts = ids.copy(), [], []  # root: smallest id of the links found so far
        for q, near in found:
            searched.append(ids[q])
            counts.append(int(copies[near[member[near]]].sum()))
            roots = np.unique(root[near])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        star = root != ids
        out = pd.DataFrame({"vec_id": np.r_[np.array(searched, np.int64), ids[star]],
                            "n": pd.array(counts + [None] * int(star.sum()), "Int64"),
                            "other": pd.array([None] * len(counts) + root[star].tolist(), "Int64")})
        return out.assign(label=pdf["label"].iloc[0], dim=pdf["dim"].iloc[0])[["label", "dim", "vec_id", "n", "other"]]

    found = held.unionByName(guests).groupBy(*shard, "block", "turn").applyInPandas(run, with_group(nodes, "vec_id long, n long, other long"))
    # a node's own copies are counted once, in its own block
    return found.groupBy(*GROUP, "vec_id", "other").agg((F.sum("n") - 1).alias("n_links")).select(*GROUP, "vec_id", "n_links", "other")


def short_labels(nodes: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """``(label, dim)`` where less than AUDIT_RECALL of the true links of hash-sampled nodes was counted.

    About AUDIT_ROWS nodes of every label are drawn, and as many of those that have links.
    """
    counts = linked.where(F.col("n_links").isNotNull()).select("vec_id", "n_links")
    known = (nodes.join(counts, "vec_id", "left")
             .withColumn("got", F.coalesce("n_links", F.col("copies") - 1)).withColumn("has", F.col("got") >= F.col("copies")))
    sizes = known.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.count_if("has").alias("n_has"))
    chance = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 40)) / float(1 << 40)
    salts = F.ceil(F.col("n") / DEAL_ROWS)
    asked = cut_lineage(known.join(sizes, GROUP).withColumn("u", chance)
                        .where((F.col("u") * F.col("n") < AUDIT_ROWS) | F.col("has") & (F.col("u") * F.col("n_has") < AUDIT_ROWS))
                        .select(*GROUP, "vec_id", "vec", "got", salts.alias("salts")))
    left = nodes.join(sizes, GROUP).withColumn("salt", hash_bucket(salts, F.lit(9), F.col("vec_id"))).drop("n", "n_has")
    right = asked.toDF(*asked.columns).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts", "got")

    def count(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return pd.DataFrame({"vec_id": [], "truth": []}).astype("int64")
        hits = unit(matrix(asked["vec"])) @ unit(matrix(points["vec"])).T >= threshold
        return pd.DataFrame({"vec_id": asked["vec_id"].to_numpy(), "truth": hits @ points["copies"].to_numpy()})

    truth = (left.groupBy(*GROUP, "salt").cogroup(right.groupBy(*GROUP, "salt")).applyInPandas(count, "vec_id long, truth long")
             .groupBy("vec_id").agg((F.sum("truth") - 1).alias("truth")))
    return (asked.select(*GROUP, "vec_id", "got").join(truth, "vec_id").groupBy(*GROUP)
            .agg(F.sum("truth").alias("t"), F.sum(F.least("truth", "got")).alias("g"))
            .where(F.col("g") < AUDIT_RECALL * F.col("t")).select(*GROUP))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, efforts=EFFORTS) -> DataFrame:
    """One row per row of ``df(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label (and dimension) link. Vectors that are null,
    zero or hold null or non-finite components, and rows without a label or vec_id, link
    with nothing: n_links 0, a component of their own. Exact copies and repeated rows
    link with each other.
    """
    df = df.select("vec_id", "embedding", "label")
    vectors = as_doubles(df)
    nodes = cut_lineage(collapse(vectors))
    linked, todo = None, nodes
    for overlap, beam in (*efforts, EXACT):
        again = cut_lineage(link_nodes(todo, overlap, beam, threshold))
        linked = again if linked is None else linked.unionByName(again)
        short = cut_lineage(short_labels(todo, again, threshold)) if beam is not None else None
        if short is None or short.isEmpty():
            break
        linked, todo = linked.join(short, GROUP, "left_anti"), cut_lineage(todo.join(short, GROUP, "left_semi"))
    parts = connected_components(linked.where(F.col("other").isNotNull()).select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    counts = linked.where(F.col("n_links").isNotNull()).select("vec_id", "n_links")
    known = (nodes.join(counts, "vec_id", "left").join(parts, F.col("vec_id") == F.col("node"), "left")
             .select("label", "dim", "vec", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "vec_id").alias("component")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size("embedding").alias("dim"),
                     F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(),
                            F.col("embedding").cast("array<double>")).alias("vec"))
    return (rows.join(known, [*GROUP, "vec"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near-duplicate components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the same result, by comparing all rows of a label."""
    return f"""
WITH RECURSIVE
v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
good AS MATERIALIZED (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN e IF x <> 0]) > 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON v.vec_id = low.a LEFT JOIN n ON v.vec_id = n.a
"""
