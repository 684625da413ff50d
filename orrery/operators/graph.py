"""Centralities of a directed graph of (src, dst) edges over nodes (id).

Iterations join and aggregate edges in the cluster. Lineage is cut by tables in
the shared folder (spark.checkpoint.dir), never by local checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orrery.functions import text as tx
from orrery.plans.store import kept


def edges_of(contracts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst) of contracts of which both ends are nodes."""
    ids = nodes.select("id")
    e = contracts.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of distinct neighbours: one aggregation of both ends."""
    ends = edges.distinct().select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    agg = ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return nodes.select("id").join(agg, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")])


def _turns(state: DataFrame, links: DataFrame, turn: list[Column], n: int) -> DataFrame:
    """`n` turns of (id, values): values go along `links` (id, to, ...), which have a link from each node to itself, and are
    summed where they arrive. A turn refers to the last one once, so plans grow with n; one exchange a turn."""
    for _ in range(n):
        state = state.join(links, "id").groupBy(F.col("to").alias("id")).agg(*turn)
    return state


def _with_loops(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`links` (id, to, ...) between nodes, and one from each node to itself, on which the other columns are null."""
    return kept(links.unionByName(nodes.select("id", F.col("id").alias("to")), allowMissingColumns=True), "links")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6, step: int = 10) -> DataFrame:
    """id, pagerank. Mass of nodes without successors isn't dealt out again; the ranks are scaled to 1 at the end.

    Every `step` turns the ranks are written and the last turn's change is looked at. No node gives no row.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    links = _with_loops(nodes, edges.join(out, "src").select(F.col("src").alias("id"), F.col("dst").alias("to"), (F.lit(1.0) / F.col("k")).alias("w")))
    got = F.coalesce(F.sum(F.col("r") * F.col("w")), F.lit(0.0))
    turn = [(F.lit((1 - damping) / n) + F.lit(damping) * got).alias("r"), F.max(F.when(F.col("w").isNull(), F.col("r"))).alias("old")]
    rank, done = nodes.select("id", F.lit(1.0 / n).alias("r"), F.lit(None).cast("double").alias("old")), 0
    while done < most:
        now = min(step, most - done)
        rank, done = kept(_turns(rank, links, turn, now), "rank"), done + now
        change = rank.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
        if change < tolerance or change == 0:
            break
    total = rank.agg(F.sum("r").alias("t"))
    return rank.crossJoin(F.broadcast(total)).select("id", (F.col("r") / F.col("t")).alias("pagerank"))  # one row


def hits(nodes: DataFrame, edges: DataFrame, most: int = 100, tolerance: float = 1e-6, step: int = 10) -> DataFrame:
    """id, hub_score, authority_score: both are updated from the last turn's values and have unit length.

    Scaling a score scales all later ones alike, so lengths are set every `step` turns only, when the
    scores are written and the last turn's change is looked at.
    """
    along = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(True).alias("ahead"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(False).alias("ahead"))
    links = _with_loops(nodes, along.unionByName(back))
    arrives = lambda c, ahead: F.coalesce(F.sum(F.when(F.col("ahead") == ahead, F.col(c))), F.lit(0.0))
    stays = lambda c: F.max(F.when(F.col("ahead").isNull(), F.col(c)))
    turn = [arrives("a", False).alias("h"), arrives("h", True).alias("a"), stays("h").alias("oh"), stays("a").alias("oa")]
    size = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    unit = lambda c: F.when(F.col(f"n_{c}") > 0, F.col(c) / F.col(f"n_{c}")).otherwise(F.lit(0.0))
    names, done = ("h", "a", "oh", "oa"), 0
    state = nodes.select("id", F.lit(1.0).alias("h"), F.lit(1.0).alias("a"))
    while done < most:
        now = min(step, most - done)
        new, done = kept(_turns(state, links, turn, now), "hits"), done + now
        norms = new.agg(*[size(c).alias(f"n_{c}") for c in names])
        scaled = new.crossJoin(F.broadcast(norms)).select("id", *[unit(c).alias(c) for c in names])  # one row
        change = scaled.agg(F.sum(F.abs(F.col("h") - F.col("oh")) + F.abs(F.col("a") - F.col("oa")))).first()[0] or 0.0
        state = scaled.select("id", "h", "a")
        if change < tolerance or change == 0:
            break
    return state.select("id", F.col("h").alias("hub_score"), F.col("a").alias("authority_score"))


#: Rows of (source, node) that a batch of sources may have at most; places of sources by their hash; growth of a batch at most.
ROWS, PLACES, GROWTH = 50_000_000, 1 << 40, 32


def betweenness(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """id, betweenness: shares of shortest paths (directed, unweighted) by accumulation from each source.

    Sources go in batches, so that no more than about `rows` pairs of a source and a node are written at once: the first one as if each
    source reached all nodes, the next ones by twice what the sources of the last one did reach. The levels of
    all sources of a batch are found together, by one join a level, and what their nodes owe goes back the same way.
    """
    nodes, edges = kept(nodes.select("id"), "nodes"), kept(edges.select("src", "dst"), "edges")
    n, total = nodes.count(), None
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    place, done, span = F.pmod(F.xxhash64("id"), F.lit(PLACES)), 0, max(1, min(PLACES, PLACES * rows // max(1, n * n)))
    while done < PLACES:
        part, sources, reached = _from_sources(nodes.where((place >= done) & (place < done + span)), edges)
        total = part if total is None else kept(total.unionByName(part).groupBy("id").agg(F.sum("b").alias("b")), "betweenness")
        done += span
        fits = PLACES * rows * sources // (2 * reached * n) if reached else span
        span = max(1, min(fits, span * GROWTH))
    return nodes.join(total, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A written table and its rows, counted while it is written."""
    seen = Observation()
    return kept(df.observe(seen, F.count("*").alias("n")), name), seen.get["n"]


def _from_sources(sources: DataFrame, edges: DataFrame) -> tuple[DataFrame, int, int]:
    """(id, b) summed over `sources`, their number, and that of the pairs of them and what they reach: a frontier of (source, node, paths) for each level, then back from the last one."""
    start, n = _counted(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels, visited, many, reached = [start], start.select("s", "v"), n, n
    while n:
        nxt = levels[-1].join(edges, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        nxt, n = _counted(nxt.join(visited, ["s", "v"], "left_anti"), "level")
        levels.append(nxt)
        reached += n
        visited = visited.unionByName(nxt.select("s", "v"))
    owed, total = None, None
    for here in reversed(levels):
        if owed is None:  # the last level is empty
            owed = here.withColumn("owed", F.lit(0.0))
            total = owed.select(F.col("v").alias("id"), F.col("owed").alias("b"))
            continue
        w = owed.select("s", F.col("v").alias("dst"), F.col("paths").alias("wp"), "owed")
        back = here.join(edges, F.col("v") == F.col("src")).join(w, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("wp") * (1.0 + F.col("owed"))).alias("o"))
        owed = kept(here.join(back, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("o", F.lit(0.0)).alias("owed")), "owed")
        total = total.unionByName(owed.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("owed").alias("b")))
    return kept(total.groupBy("id").agg(F.sum("b").alias("b")), "betweenness"), many, reached


def centralities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` with degrees, pagerank, hub_score, authority_score and betweenness."""
    e = kept(edges.distinct(), "edges")
    out = nodes.join(degrees(nodes, e), "id")
    for part in (pagerank(nodes, e), hits(nodes, e), betweenness(nodes, e)):
        out = out.join(part, "id")
    return out


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree and density."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.distinct().agg(F.count("*").alias("n_edges"))
    k = F.col("n_nodes")
    return n.crossJoin(m).select(
        "n_nodes",
        "n_edges",
        F.when(k > 0, F.col("n_edges") / k).otherwise(F.lit(0.0)).alias("avg_degree"),
        F.when(k > 1, F.col("n_edges") / (k * (k - 1))).otherwise(F.lit(0.0)).alias("density"),
    )


METRICS = ("pagerank", "hub_score", "authority_score", "betweenness")


def top(measured: DataFrame, n: int = 10) -> DataFrame:
    """(metric, rank, id, score) of the n best nodes by each metric: one pass, ranks limited before the shuffle."""
    from pyspark.sql import Window

    long = measured.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])).alias("x")).select("id", "x.*")
    best = Window.partitionBy("metric").orderBy(F.desc("score"), "id")
    return long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("metric", "rank", "id", "score")


def interpretation() -> Column:
    """The limits that a node's measures pass, with its numbers."""
    rules = [
        F.coalesce(tx.beyond("pagerank", F.col("pagerank"), over=0.1), tx.beyond("pagerank", F.col("pagerank"), over=0.05)),
        *[tx.beyond(m, F.col(m), over=limit) for m, limit in (("hub_score", 0.3), ("authority_score", 0.3), ("betweenness", 0.1))],
        *[tx.beyond(m, F.col(m), over=limit, under=1, whole=True) for m, limit in (("in_degree", 5), ("out_degree", 10))],
    ]
    return tx.notes(rules, "no limit passed")


def simple_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees over the largest ones: hub_score (out), authority_score (in), importance (their mean)."""
    d = degrees(nodes, edges)
    most = d.agg(F.greatest(F.max("out_degree"), F.lit(1)).alias("mo"), F.greatest(F.max("in_degree"), F.lit(1)).alias("mi"))
    hub, auth = F.col("out_degree") / F.col("mo"), F.col("in_degree") / F.col("mi")
    return d.crossJoin(F.broadcast(most)).select("id", "in_degree", "out_degree", hub.alias("hub_score"), auth.alias("authority_score"), ((hub + auth) / 2).alias("importance"))
